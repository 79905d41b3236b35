"""URL filters: path rules, and gradient-boosted trees on lexical features for the rest.

The trees are fitted on the driver from a sample of labelled URLs whose size is
the parameter ``most_labelled``; every URL is then judged by rules and trees in
one pass. Features: lengths of the parts, path depth, digit ratios, character
entropies, parameter counts, and the smoothed share of blocked URLs by suffix (last
label, last two labels) in the sample. No feature sees a word, so the trees can't
read labels off the terms that a labelled list was made by.

Defined results: a null URL, or one without ://, has an empty host and path and is
judged by the trees; repeated rows are judged alike; without labelled URLs, or with
one label alone, that label (else allow) holds for all; a URL that is labelled both
ways counts both ways; URLs of any length are read whole; columns beside the id and the URL are passed over,
whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import bounded_sample, slices

SPLIT = re.compile(r"^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.S)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DIGITS = re.compile(r"[0-9]")


def parts(url: str | None) -> tuple[str, str, str]:
    """(host, path, query)."""
    m = SPLIT.match(url or "")
    return (m[2].translate(UPPER), m[3], (m[4] or "")[1:]) if m else ("", "", "")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Rules:
    """The longest rule whose host is the URL's or above it and whose path begins the URL's; the first of equals."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        best, labels = None, host.split(".")
        for k in range(len(labels)):
            for r in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
                    best = r
        return best


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


#: What lexical() measures, in its order, and the two shares by suffix.
FEATURES = ("length", "host length", "path length", "query length", "depth", "digit ratio", "host digit ratio", "path digit ratio", "entropy", "host entropy", "path entropy", "parameters", "suffix share", "domain share")


def lexical(url: str | None) -> list[float]:
    host, path, query = parts(url)
    u = url or ""
    digits = lambda s: len(DIGITS.findall(s)) / len(s) if s else 0.0
    depth, parameters = (len([x for x in s.split(c) if x]) for s, c in ((path, "/"), (query, "&")))
    return [len(u), len(host), len(path), len(query), depth, digits(u), digits(host), digits(path), entropy(u), entropy(host), entropy(path), parameters]


def suffixes(url: str | None) -> tuple[str, str]:
    labels = parts(url)[0].split(".")
    return labels[-1], ".".join(labels[-2:])


@dataclass
class Model:
    """Trees as flat arrays: at a node, go to 2i+1 if the feature is at most the cut, else to 2i+2."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    shares: list[dict[str, float]] = field(default_factory=list)
    prior: float = 0.0

    def used(self) -> list[str]:
        """The features that some tree asks for."""
        return [FEATURES[i] for i in sorted(set(self.feature[np.isfinite(self.cut)].astype(int).tolist()))] if len(self.feature) else []

    def matrix(self, urls: list[str | None]) -> np.ndarray:
        rows = [lexical(u) + [s.get(x, self.prior) for s, x in zip(self.shares, suffixes(u))] for u in urls]
        return np.array(rows, np.float64).reshape(len(urls), -1)

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Log odds of block."""
        if not len(self.feature):
            return np.full(len(urls), self.base)
        x, out, row = self.matrix(urls), np.full(len(urls), self.base), np.arange(len(urls))
        inner = (1 << self.depth) - 1
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(urls), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            out += v[at - inner]
        return out


def fit(urls: list[str], labels: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, shrink: float = 1.0) -> Model:
    """Gradient boosting with logistic loss; labels: 1 is block."""
    y = np.array(labels, np.float64)
    mean = float(y.mean()) if len(y) else 0.0
    if not 0 < mean < 1:
        return Model(10.0 if mean >= 1 else -10.0, depth, *(np.zeros((0, 1)),) * 3)
    model = Model(math.log(mean / (1 - mean)), depth, *(np.zeros((0, 1)),) * 3, prior=mean)
    for k in (0, 1):
        n, s = Counter(), Counter()
        for u, v in zip(urls, labels):
            n[suffixes(u)[k]] += 1
            s[suffixes(u)[k]] += v
        model.shares.append({x: (s[x] + 5 * mean) / (n[x] + 5) for x in n})
    x = model.matrix(urls)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    score = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            gain, where = 1e-9, None
            for j, cs in enumerate(cuts):
                if not len(cs) or not len(own):
                    continue
                gs, hs = (np.cumsum(np.bincount(binned[own, j], v[own], len(cs) + 1))for v in (g, h))
                left = gs[:-1] ** 2 / (hs[:-1] + shrink) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + shrink) - gs[-1] ** 2 / (hs[-1] + shrink)
                b = int(left.argmax())
                if left[b] > gain:
                    gain, where = left[b], (j, b)
            if where:
                f[node], c[node] = where[0], cuts[where[0]][where[1]]
            at[own] = 2 * node + 1 + (x[own, f[node]] > c[node])
        at -= inner
        v = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + shrink)
        score += v[at]
        feature.append(f), cut.append(c), leaf.append(v)
    model.feature, model.cut, model.leaf = map(np.array, (feature, cut, leaf))
    return model


def labelled_sample(labelled: DataFrame, most_labelled: int) -> tuple[list[str], list[int]]:
    """(URLs, labels) of at most so many labelled rows, sampled by the hashes of their URLs."""
    known = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label"))
    rows = sorted((r.url, r.label) for r in bounded_sample(known, F.struct("url", "label"), most_labelled).collect())
    return [u for u, _ in rows], [v for _, v in rows]


def site_fold(url: str | None, folds: int) -> int:
    """By the last two labels of the host, so that a site lies in one fold."""
    return zlib.crc32(suffixes(url)[1].encode("utf-8", "replace")) % folds


def fit_folds(urls: list[str], labels: list[int], folds: int) -> list[Model]:
    """A model for each fold, fitted on the others; for one fold, one on all."""
    own = [site_fold(u, folds) for u in urls]
    inside = [[i for i, f in enumerate(own) if folds == 1 or f != k] for k in range(folds)]
    return [fit([urls[i] for i in some], [labels[i] for i in some]) for some in inside]


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame, url: str = "url", id_column: str = "page_id", most_labelled: int = 20_000, threshold: float = 0.5, folds: int = 1) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row; labelled has url and label (1: block).

    With several ``folds`` each URL is judged by trees that have seen no label of its site: where the judged URLs are
    those that labels were drawn from, the verdicts then say what the trees know and not what they remember.
    """
    models = fit_folds(*labelled_sample(labelled, most_labelled), folds)
    book, least = Rules(rules), math.log(threshold / (1 - threshold))
    kind = pages.schema[id_column].dataType.simpleString()

    def scored(urls: list[str | None]) -> np.ndarray:
        out, fold = np.empty(len(urls)), np.array([site_fold(u, folds) for u in urls], np.int64)
        for k in np.unique(fold).tolist():
            own = np.flatnonzero(fold == k)
            out[own] = models[k].score([urls[i] for i in own])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            urls = batch.column(1).to_pylist()
            found = [parts(u) for u in urls]
            hits = [book.find(h, p) for h, p, _ in found]
            scores = scored(urls)
            verdict = [r.verdict if r else ("block" if s > least else "allow") for r, s in zip(hits, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _, _ in found], [p for _, p, _ in found], [r.text if r else None for r in hits], verdict)), pa.array(scores)],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return pages.select(F.col(id_column).alias("page_id"), F.col(url)).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]

#: Terms of a blocklist, fixed. The tables hold no labelled URLs, so the query's labels are weak ones: a URL is labelled 1 if
#: its host has a listed term between dots and hyphens, else 0. What the trees learn of them are the URLs' lexical statistics.
BLOCKLIST = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "viagra")


def blocklist_labels(pages: DataFrame, url: str = "url") -> DataFrame:
    """(url, label) by the blocklist."""
    host: Column = F.lower(F.regexp_extract(F.col(url), r"^.*?://([^/?#]*)", 1))
    return pages.select(F.col(url).alias("url"), F.arrays_overlap(F.split(host, "[.-]"), F.array(*(F.lit(w) for w in BLOCKLIST))).cast("int").alias("label"))
