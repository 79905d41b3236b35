"""Compression of vectors to codes: one codebook entry for each of their parts, found by VA-file filtering.

Components become whole numbers; a vector is cut into equal parts, and each part is
replaced by the index of the nearest entry of its position's codebook. To find it, entry
coordinates are quantised to a few bits: cells of each coordinate, with the least and greatest coordinate
that lies in them. Tables for a query hold by coordinate and cell what the squared
difference is at least and at most; summed over an entry's cells they bound its distance from
both sides. Only entries whose lower bound doesn't exceed the smallest upper bound are compared in whole numbers.

Codebooks are made by rounds of assignment and mean. Tasks hand on sums and counts by entry, not vectors; the
driver holds the codebooks alone, whose size depends on the entries and the vectors' length.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors of each
length are compressed among their own kind, with codebooks of their own (all together up to ``MOST_ENTRIES``
components, more are an error); a length that the parts don't divide is cut as evenly as can be; an
empty vector has codes of zero; the first entries are those of the smallest ids, null ids last, rows of one id in
order of their components; with fewer vectors than entries there are as many entries as vectors; repeated rows count each;
null labels form one group; columns beside id, vector and label are passed over. A component beyond 2^24 after scaling is an
error, as distances would leave long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch

BITS, LARGEST, MOST_ENTRIES = 4, 1 << 24, 16 << 20
ROWS_AT_ONCE, TOGETHER = 512, 16


def spans_of(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector of that length begin and end."""
    at = [length * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:]))


class Filter:
    """A codebook (entries x components, whole numbers) with its cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, cells = entries, 1 << bits
        low, high = entries.min(0), entries.max(0)
        self.cell = np.minimum((entries - low) * cells // np.maximum(high - low, 1), cells - 1)  # by entry and component
        self.least, self.most = np.full((entries.shape[1], cells), LARGEST * 4), np.full((entries.shape[1], cells), -LARGEST * 4)
        for j in range(entries.shape[1]):
            np.minimum.at(self.least[j], self.cell[:, j], entries[:, j])
            np.maximum.at(self.most[j], self.cell[:, j], entries[:, j])
        self.compared = 0

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the squared distances of the asked vectors to the entries are at least and at most."""
        lower, upper = (np.zeros((len(asked), len(self.entries)), np.int64) for _ in range(2))
        for j in range(asked.shape[1]):
            below, above = self.least[j] - asked[:, j : j + 1], asked[:, j : j + 1] - self.most[j]
            off, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += np.take(off * off, self.cell[:, j], axis=1)
            upper += np.take(far * far, self.cell[:, j], axis=1)
        return lower, upper

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry, ties to the lower index."""
        if not self.entries.shape[1]:
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        lower, upper = self.bounds(asked)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        self.compared += len(row)
        apart = asked[row] - self.entries[entry]
        distance = (apart * apart).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(distance, first)
        reached = np.flatnonzero(distance == least[row])
        return entry[reached[np.flatnonzero(np.diff(row[reached], prepend=-1))]], least


Codebooks = dict[int, list[np.ndarray]]


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of vectors of one length, some hundred at a time."""
    lists = batch.column(column)
    start, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(start)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        for k in range(0, len(own), ROWS_AT_ONCE):
            rows = own[k : k + ROWS_AT_ONCE]
            yield rows, flat[start[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0), np.int64)


def _filters(books: Codebooks) -> dict[int, list[Filter]]:
    return {n: [Filter(b) for b in own] for n, own in books.items()}


def moved(rows: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """The codebooks after one round: entries are the floors of the means of the parts that are assigned to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, sums, counts = _filters(books), {n: [np.zeros(b.shape, np.int64) for b in own] for n, own in books.items()}, {n: [np.zeros(len(b), np.int64) for b in own] for n, own in books.items()}
        for batch in batches:
            for _, x in _by_length(batch, "parts"):
                n = x.shape[1]
                for p, (i, j) in enumerate(spans_of(n, parts)):
                    entry, _ = filters[n][p].nearest(x[:, i:j])
                    np.add.at(sums[n][p], entry, x[:, i:j])
                    counts[n][p] += np.bincount(entry, minlength=len(counts[n][p]))
        found = [(n, p, e, k, int(counts[n][p][e]), sums[n][p][e, k : k + TOGETHER].tolist()) for n in sums for p in range(parts) for e in np.flatnonzero(counts[n][p]).tolist() for k in range(0, sums[n][p].shape[1], TOGETHER)]
        kinds = (*(pa.int32(),) * 4, pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["n", "part", "entry", "first", "rows", "sums"])

    partial = rows.select("parts").mapInArrow(run, "n int, part int, entry int, first int, rows long, sums array<long>")
    whole = partial.groupBy("n", "part", "entry", "first").agg(F.sum("rows").alias("rows"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(TOGETHER)))
    out = {n: [b.copy() for b in own] for n, own in books.items()}
    for r in whole.collect():  # some for each entry
        place = out[r["n"]][r["part"]][r["entry"], r["first"] : r["first"] + TOGETHER]
        place[:] = [r[f"s{k}"] // r["rows"] for k in range(len(place))]
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors of the smallest ids, for each length."""
    found: dict[int, list[list[int]]] = {}
    lengths = [r["n"] for r in rows.select(F.size("parts").alias("n")).distinct().orderBy("n").limit(MOST_ENTRIES // entries + 1).collect()]
    if sum(entries * n for n in lengths) > MOST_ENTRIES:
        raise ValueError(f"codebooks of {len(lengths)} vector lengths would have more than {MOST_ENTRIES} components")
    for n in lengths:
        first = rows.where(F.size("parts") == n).orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries)
        found[n] = [r["parts"] for r in first.select("parts").collect()]
    return {n: [np.array(v, np.int64).reshape(len(v), n)[:, i:j] for i, j in spans_of(n, parts)] for n, v in found.items()}


def whole_numbers(vector: Column, scale: int) -> Column:
    """Components as floors of their multiples; null where one is null or not finite; an error beyond LARGEST."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    checked = F.transform(scaled, lambda x: F.when(F.abs(x) <= float(LARGEST), F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large to be compressed")).cast("long")))
    return F.when(fine, checked)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def assigned(rows: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of rows."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, digests = _filters(books), {n: digest(own) for n, own in books.items()}
        for batch in batches:
            code, error, sha = np.empty(batch.num_rows, object), np.zeros(batch.num_rows, np.int64), np.empty(batch.num_rows, object)
            for at, x in _by_length(batch, "parts"):
                n = x.shape[1]
                entry, distance = zip(*(filters[n][p].nearest(x[:, i:j]) for p, (i, j) in enumerate(spans_of(n, parts))))
                code[at] = ["".join(f"{e:02x}" for e in row) for row in np.stack(entry, 1).tolist()]
                error[at], sha[at] = sum(distance), digests[n]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())], names=["id", "label", "code", "error", "codebooks_sha256"])

    return rows.select("id", "label", "parts").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error long, codebooks_sha256 string")


def fit_codebooks(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks by vector length of rows (id, parts: whole numbers)."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(rows, books, parts)
    return books


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per vector that takes part; at most 256 entries, two digits each."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), whole_numbers(F.col(vector), scale).alias("parts"))
    rows = scratch.put(rows.where("parts is not null"))
    found = scratch.put(assigned(rows, fit_codebooks(rows, parts, entries, rounds), parts))
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    found = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Plain distances to all entries, round by round."""
    assign = lambda r: f"""
a{r} AS MATERIALIZED (SELECT v, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM
  (SELECT x.v, x.p, c.e, list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x) AS d FROM x JOIN c{r} c ON x.p = c.p) GROUP BY v, p)"""  # noqa: E731
    steps = [assign(0)]
    for r in range(1, rounds + 1):
        steps.append(f"""
m{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS DOUBLE) AS m FROM
  (SELECT x.p, a.e, unnest(range(len(x.x))) AS i, unnest(x.x) AS y FROM x JOIN a{r - 1} a ON x.v = a.v AND x.p = a.p) GROUP BY p, e, i) GROUP BY p, e),
c{r} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e)""")
        steps.append(assign(r))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, list_transform(embedding, lambda y: floor({scale} * CAST(y AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT v, p, w[p * (len(w) // {parts}) + 1 : (p + 1) * (len(w) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
c0 AS (SELECT p, v AS e, x FROM x WHERE v < {entries}),{",".join(steps)},
s AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
f AS (SELECT v, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY v)
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM k JOIN f ON k.v = f.v, s
"""


#: For vectors of one length that the parts divide.
CODES_SQL = _codes_sql()
