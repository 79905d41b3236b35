"""Language ID by Bayesian evidence fusion.

The posterior of a language is the product of a text likelihood (hashed byte
trigrams, tempered because they overlap), the likelihood of the declared markup
language, and a prior of the host, smoothed towards its address suffix and that
towards the whole. One more class, ``und``, gives all trigrams the same
probability and takes what reads like no language.

The trigram models are fitted on a bounded sample of distinct declared texts, as many
of each language (``most_labelled``); priors and the reliability of declarations are
grouped sums of text posteriors over all rows. Every text is scored once: its log
likelihoods are written with the row, and the tables of priors are joined to that.
Where they are small, Spark measures that and broadcasts them; beyond that its skew
join splits hosts that have many rows.

Defined results: a text without letters (null and empty ones too) is ``und`` and
rejected; a null host, suffix or declaration is a value of its own; ties go to the
language named first; repeated rows are judged alike and each counts; texts of any length
are judged whole, and in the fit a text counts for 3,000 trigrams at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import Scratch, as_bytes, bounded_sample, slices
from strata.llm.html_tree import BLOCK, parse, squeeze, unescape

BUCKETS, CHUNK, SUMS = 1 << 14, 1 << 22, 8
UNKNOWN = "und"
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class TextModel:
    """Log probabilities (classes, buckets); the last class is und."""

    languages: tuple[str, ...]
    log: np.ndarray
    temper: float

    def evidence(self, text: bytes) -> tuple[np.ndarray, bool]:
        """(tempered log likelihood by class, whether there is a letter)."""
        counts, letters = counted(text)
        at = np.flatnonzero(counts)
        return self.log[:, at] @ counts[at] * self.temper, letters


def trigrams(text: bytes) -> tuple[np.ndarray, bool]:
    """Counts of the hashed trigrams of the lower-cased words, which are what stands between bytes that are no letters; whether there is one."""
    words = text.lower().translate(LETTERS).split()
    letters = bool(words)
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    if not letters:
        return np.zeros(BUCKETS, np.int64), False
    y = x.astype(np.uint32)
    h = (y[:-2] * np.uint32(0x9E3779B1)) ^ (y[1:-1] * np.uint32(0x85EBCA77)) ^ (y[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(18), minlength=BUCKETS), letters


def counted(text: bytes) -> tuple[np.ndarray, bool]:
    """trigrams() of a text of any length, by chunks."""
    counts, letters = trigrams(text[: CHUNK + 2])
    for k in range(CHUNK, len(text), CHUNK):
        more, some = trigrams(text[k : k + CHUNK + 2])
        counts, letters = counts + more, letters | some
    return counts, letters


def fit(docs: DataFrame, text: str, declared: Column, languages: tuple[str, ...], most_labelled: int, temper: float) -> TextModel:
    """Trigram models of the languages from at most so many distinct texts that declare one, sampled by their hashes."""
    named = docs.select(declared.alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    sample = bounded_sample(named, F.col("text"), most_labelled, F.col("lang"), languages).repartition(SUMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS))
        for batch in slices(batches, 1):
            for lang, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                c = counted(t)[0]
                sums[languages.index(lang)] += c / max(1.0, c.sum() / 3000)  # a very long text counts as a long one
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = sum((np.frombuffer(r.sums, np.float64).reshape(len(languages), BUCKETS) for r in sample.mapInArrow(count, "sums binary").collect()), np.zeros((len(languages), BUCKETS)))  # SUMS rows
    log = np.log((sums + 0.05) / (sums + 0.05).sum(1, keepdims=True))
    return TextModel(languages, np.vstack([log, np.full(BUCKETS, -np.log(BUCKETS))]), temper)


def _with_evidence(rows: DataFrame, model: TextModel, keep_text: bool) -> DataFrame:
    """rows with ll (log likelihood by class) and letters; the last column is the text."""
    schema = T.StructType(list(rows.schema.fields)[: None if keep_text else -1]).add("ll", T.ArrayType(T.DoubleType())).add("letters", "boolean")
    given = len(schema) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_text):
            found = [model.evidence(t) for t in as_bytes(batch.column(batch_text))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:given], pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.bool_())], names=schema.names)

    batch_text = len(rows.columns) - 1
    return rows.mapInArrow(run, schema)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _normal(logs: Column) -> Column:
    """Probabilities from logarithms."""
    exps = lambda x: _let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return _let(logs, lambda x: _let(exps(x), lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda t: F.transform(e, lambda v: v / t))))


def identify(
    docs: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, languages: tuple[str, ...] = ("en", "fr", "de", "es"),
    most_labelled: int = 4_000, temper: float = 0.3, strength: float = 20.0, unknown: float = 0.01, least: float = 0.5, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all if None) with __language, __posterior and __keep (a language, and its posterior at least ``least``); columns of these names give way."""
    lower = lambda c: F.lower(c.cast("string")) if c is not None else F.lit(None).cast("string")
    scratch = Scratch(docs.sparkSession, "language")
    model = fit(docs, text, lower(declared), languages, most_labelled, temper)
    m, classes = len(languages), [*languages, UNKNOWN]
    kept = [c for c in docs.columns if keep is None or c in keep]
    given = [*(c for c in kept if c != text), text]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)]
    held = docs.select(*named[:-1], lower(declared).alias("declared"), lower(host).alias("host"), lower(suffix).alias("suffix"), named[-1])
    seen = scratch.put(_with_evidence(held, model, text in kept))  # every text is scored once

    # Grouped sums of text posteriors over all rows, from the finest level up.
    flat = F.array(*(F.lit((1 - unknown) / m) for _ in languages), F.lit(unknown))
    soft = seen.where("letters").withColumn("p", _normal(F.zip_with("ll", flat, lambda a, b: a + F.log(b))))
    fine = scratch.put(soft.groupBy("suffix", "host", "declared").agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(m + 1))))
    up = lambda *by: fine.groupBy(*by).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(m + 1)))
    total = up().first()  # one row
    overall = np.array([total[i] or 0.0 for i in range(m + 1)]) + 1.0
    overall = overall / overall.sum()
    share = lambda parent: F.array(*((F.col(f"s{i}") + strength * parent[i]) / (sum(F.col(f"s{j}") for j in range(m + 1)) + strength) for i in range(m + 1)))
    suffixes = up("suffix").select(F.col("suffix").alias("x"), share([F.lit(float(v)) for v in overall]).alias("parent"))
    hosts = up("suffix", "host")
    hosts = hosts.join(suffixes, hosts["suffix"].eqNullSafe(suffixes["x"])).select(F.col("suffix").alias("x"), F.col("host").alias("h"), share([F.col("parent")[i] for i in range(m + 1)]).alias("prior"))
    totals = [max(1e-9, float(total[i] or 0.0)) for i in range(m + 1)]
    spoken = up("declared").select(F.col("declared").alias("d"), F.array(*((F.col(f"s{i}") + 1.0) / (totals[i] + 10.0) for i in range(m + 1))).alias("said"))
    hosts, spoken = scratch.put(hosts), scratch.put(spoken)  # so that Spark knows their sizes when it plans the joins

    own = seen.join(hosts, seen["suffix"].eqNullSafe(hosts["x"]) & seen["host"].eqNullSafe(hosts["h"]), "left")
    own = own.join(spoken, own["declared"].eqNullSafe(spoken["d"]), "left")
    prior = F.coalesce("prior", F.array(*(F.lit(float(x)) for x in overall)))
    said = F.coalesce("said", F.array(*(F.lit(1.0) for _ in classes)))
    own = own.withColumn("p", _normal(F.zip_with(F.zip_with("ll", prior, lambda a, b: a + F.log(b)), said, lambda a, b: a + F.log(b))))
    best = F.array_position("p", F.array_max("p")).cast("int")
    language = F.when(F.col("letters"), F.element_at(F.array(*(F.lit(c) for c in classes)), best)).otherwise(F.lit(UNKNOWN))
    own = own.withColumn("__language", language).withColumn("__posterior", F.when(F.col("letters"), F.array_max("p")).otherwise(F.lit(1.0)))
    own = own.withColumn("__keep", (F.col("__language") != UNKNOWN) & (F.col("__posterior") >= least))
    added = ("__language", "__posterior", "__keep")
    return own.select(*(F.col(f"c{given.index(c)}").alias(c) for c in kept if c not in added), *added)


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, declared, language, posterior, keep) of documents: the column lang declares, the source is the host."""
    own = identify(docs.select("doc_id", "text", F.col("lang").alias("declared"), "source"), declared=F.col("declared"), host=F.col("source"), keep=("doc_id", "declared"))
    return own.select("doc_id", "declared", F.col("__language").alias("language"), F.round("__posterior", 6).alias("posterior"), F.col("__keep").alias("keep"))


UNSEEN = frozenset("script style noscript template iframe head title".split())


def read_page(html: str) -> tuple[str | None, str]:
    """(base of the language that the html element declares, text of the page)."""
    declared, parts, stack = None, [], [parse(html)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in UNSEEN:
            if x.tag == "html" and declared is None:
                declared = (x.attrs.get("lang") or x.attrs.get("xml:lang") or "").split("-")[0].strip().lower() or None
            between = " " if x.tag in BLOCK else ""
            stack += [between, *reversed(x.items), between]
    return declared, squeeze(unescape("".join(parts)))


def page_languages(pages: DataFrame) -> DataFrame:
    """(page_id, declared, language, posterior, keep) of web pages: the html element declares, host and address suffix come from the url.

    A null page has no text and declares nothing; a null url, or one without ://, has a null host and suffix.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [read_page(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], names=["page_id", "host", "declared", "text"])

    host = F.nullif(F.lower(F.regexp_extract("url", r"^.*?://([^/?#:]*)", 1)), F.lit(""))
    read = pages.select("page_id", host.alias("host"), "html").mapInArrow(run, f"page_id {kind}, host string, declared string, text string")
    read = Scratch(pages.sparkSession, "pages").put(read)  # every page is read once
    own = identify(read, declared=F.col("declared"), host=F.col("host"), suffix=F.substring_index("host", ".", -1), keep=("page_id", "declared"))
    return own.select("page_id", "declared", F.col("__language").alias("language"), F.round("__posterior", 6).alias("posterior"), F.col("__keep").alias("keep"))
