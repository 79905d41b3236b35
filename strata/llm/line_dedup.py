"""Line dedup over a sharded minimal perfect hash.

Distinct line hashes are counted per document; those in enough documents are
dealt into shards by hash, and every shard is indexed by a minimal perfect
hash (levels of bit arrays, ranks by popcount) over compact fingerprint and
count arrays. Documents probe the arrays; lines are never joined.

An index of at most ``broadcast_bytes`` goes to every executor; a larger one
stays a table of shards, to which packed probes are routed by shard number.

Defined results: a null text is one empty line (and stays null as text); blank
lines are never dropped; rows count as documents, so repeated rows each count.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Renamed, Scratch, as_bytes, null_mask, slices, with_text, worker_cache

GAMMA, LEVELS = 2.0, 40
SHARD_KEYS = 1 << 16


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: levels of bit arrays in 64-bit words, and a rank for each word."""

    def __init__(self, levels: list[np.ndarray], last: np.ndarray):
        self.levels, self.last = levels, last  # words as uint64; keys that no level took
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append((np.cumsum(ones) - ones + base).astype(np.uint32))
            base += int(ones.sum())
        self.base = base

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while len(left) and len(levels) < LEVELS:
            m = 64 * (int(GAMMA * len(left)) // 64 + 1)
            at = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return PerfectHash(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Where each key would be; -1 for keys that are certainly absent."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for k, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(rest):
                break
            at = _mix(keys[rest], k) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            rest = rest[~hit]
        if len(rest) and len(self.last):
            i = np.minimum(np.searchsorted(self.last, keys[rest]), len(self.last) - 1)
            hit = self.last[i] == keys[rest]
            out[rest[hit]] = self.base + i[hit]
        return out


def pack_shard(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard's index as bytes: bit arrays, then fingerprints and counts in the order of the hash."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    h = PerfectHash.build(a)
    at = h.index(a)
    fingerprint, count = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint32)
    fingerprint[at], count[at] = b, np.minimum(counts, 0xFFFFFFFF)
    parts = [struct.pack("<IIII", len(h.levels), len(h.last), len(a), 0), np.array([len(x) for x in h.levels], "<u8").tobytes()]
    return b"".join([*parts, *(x.tobytes() for x in h.levels), h.last.tobytes(), fingerprint.tobytes(), count.tobytes()])


class Shard:
    """A packed index in place: its arrays are views of the bytes."""

    def __init__(self, blob: bytes):
        n_levels, n_last, n, _ = struct.unpack_from("<IIII", blob)
        at = 16 + 8 * n_levels
        levels = []
        for size in np.frombuffer(blob, "<u8", n_levels, 16):
            levels.append(np.frombuffer(blob, "<u8", int(size), at))
            at += 8 * int(size)
        self.hash = PerfectHash(levels, np.frombuffer(blob, np.uint64, n_last, at))
        self.fingerprint = np.frombuffer(blob, np.uint64, n, at + 8 * n_last)
        self.count = np.frombuffer(blob, np.uint32, n, at + 8 * n_last + 8 * n)

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many documents have the line, 0 if the index hasn't got it."""
        at = self.hash.index(a)
        ok = at >= 0
        ok[ok] = self.fingerprint[at[ok]] == b[ok]
        out = np.zeros(len(a), np.int64)
        out[ok] = self.count[at[ok]]
        return out


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: ASCII white space and A-Z only


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) 64-bit hashes of the keys."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, n): the hash of each distinct non-blank line key and its number of documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            keys: list[bytes] = []
            for t in as_bytes(batch.column(0)):
                own = set(map(line_key, t.split(b"\n")))
                own.discard(b"")
                keys += own
            h = hashes(keys).view(np.int64)
            for k in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 18), i]) for i in (0, 1)], names=["a", "b"])

    return docs.select(F.col(text)).mapInArrow(emit, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) over the keys (a, b, n)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        blob = pack_shard(*(group[c].to_numpy() for c in ("a", "b", "n")))
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "blob": [blob]})

    dealt = frequent.withColumn("shard", F.pmod(F.col("b"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(build, "shard long, blob binary")


def _dropper(find):
    """find: hashes (n, 2) -> bool array of lines to drop. Returns texts -> [(n_lines, n_dropped, kept bytes)]."""

    def run(texts: list[bytes]) -> list[tuple[int, int, bytes]]:
        lines = [t.split(b"\n") for t in texts]
        keys = [line_key(x) for own in lines for x in own]
        full = np.fromiter(map(len, keys), np.int64, len(keys)) > 0
        drop = np.zeros(len(keys), bool)
        if full.any():
            drop[full] = find(hashes([k for k in keys if k]))
        out, at = [], 0
        for t, own in zip(texts, lines):
            d = drop[at : at + len(own)]
            at += len(own)
            n = int(d.sum())
            out.append((len(own), n, b"\n".join([x for x, gone in zip(own, d) if not gone]) if n else t))
        return out

    return run


OUT = "n_lines long, n_dropped long, kept_sha256 string"


def _apply(docs: DataFrame, text: str, make_run, as_documents: bool, id_column: str) -> DataFrame:
    """Probe in place: make_run() gives the dropper inside the worker."""
    if as_documents:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = make_run()
            for batch in slices(batches, text):
                nulls = null_mask(batch.column(text))
                done = run(as_bytes(batch.column(text)))
                yield with_text(batch, text, [None if gone else kept for gone, (_, _, kept) in zip(nulls, done)])

        return docs.mapInArrow(whole, docs.schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make_run()
        for batch in slices(batches, 1):
            done = run(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text)).mapInArrow(digest, f"doc_id {kind}, {OUT}")


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_docs: int = 10, broadcast_bytes: int = 64 << 20, as_documents: bool = False) -> DataFrame:
    """Drop every line whose key is in at least ``min_docs`` documents.

    Returns (doc_id, n_lines, n_dropped, kept_sha256) per row, or with
    ``as_documents`` the rows themselves with the kept text. The broadcast is at most
    ``broadcast_bytes``, checked; each Python worker holds it once, with ranks of a
    sixteenth of the bit arrays beside it. A larger index is probed shard by shard.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    frequent = scratch.put(line_counts(docs, text).where(F.col("n") >= min_docs))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    index = scratch.put(build_index(frequent, shards))
    scratch.drop(frequent)
    size = index.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _routed(docs, text, id_column, index, shards, min_docs, as_documents, scratch)
    held = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.collect()})  # at most broadcast_bytes
    token = scratch.root

    def make_run():
        cache = worker_cache("line_index")
        if cache.get("token") != token:
            cache.update(token=token, shards={k: Shard(v) for k, v in held.value.items()})
        mine = cache["shards"]

        def find(h: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h), bool)
            for k, own in _by_shard(h, shards):
                if k in mine:
                    out[own] = mine[k].counts(h[own, 0], h[own, 1]) >= min_docs
            return out

        return _dropper(find)

    return _apply(docs, text, make_run, as_documents, id_column)


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, which of the hashes are its) for each shard that has some."""
    deal = np.mod(h[:, 1].view(np.int64), shards)
    order = np.argsort(deal, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(deal[order]) != 0, True]) if len(order) else []
    for s, e in zip(edges[:-1], edges[1:]):
        yield int(deal[order[s]]), order[s:e]


PROBES_AT_ONCE, PROBES_PER_TASK = 1 << 18, 1 << 20


def _routed(docs: DataFrame, text: str, id_column: str, index: DataFrame, shards: int, min_docs: int, as_documents: bool, scratch: Scratch) -> DataFrame:
    """Beyond the broadcast: packed probes go to the shards, hits come back by row key.

    A shard with many probes (a line that many documents share has all its probes in one) is copied
    for as many parts of them as keep a task at PROBES_PER_TASK or so.
    """
    key = F.xxhash64(F.col(id_column), F.col(text))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, rows = [], []

        def flush() -> pa.RecordBatch:
            h, r = hashes(probes), np.array(rows, np.int64).view(np.uint64)
            found = [(k, np.ascontiguousarray(np.column_stack([r[own], h[own]])).tobytes(), len(own)) for k, own in _by_shard(h, shards)]
            probes.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["shard", "probes", "n"])

        for batch in slices(batches, 1):
            for r, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own = set(map(line_key, t.split(b"\n"))) - {b""}
                probes += own
                rows += [r] * len(own)
                if len(probes) >= PROBES_AT_ONCE:
                    yield flush()
        if probes:
            yield flush()

    def probe(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({"__row": [], "__line": []}, dtype="int64")
        shard = Shard(held["blob"].iloc[0])
        p = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 3) for x in own["probes"]])
        hit = p[shard.counts(p[:, 1], p[:, 2]) >= min_docs]
        return pd.DataFrame({"__row": hit[:, 0].view(np.int64), "__line": hit[:, 1].view(np.int64)})

    packed = scratch.put(docs.select(key.alias("k"), F.col(text)).mapInArrow(pack, "shard long, probes binary, n long").withColumn("tag", F.monotonically_increasing_id()))  # written, so that a task that runs again deals alike
    parts = scratch.put(packed.groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(float(PROBES_PER_TASK))).alias("parts")))  # one row per shard
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("shard", "part", "blob")
    dealt = packed.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("tag"), "parts")).select("shard", "part", "probes")
    hits = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(probe, "__row long, __line long")
    per_row = hits.groupBy("__row").agg(F.collect_set("__line").alias("__lines"))  # bounded by a document's own lines
    named = Renamed(docs, __row=key)
    joined = named.df.join(per_row, "__row", "left").drop("__row")
    schema, text_at = docs.schema, docs.columns.index(text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            found, out = batch.column("__lines").to_pylist(), []
            batch = pa.RecordBatch.from_arrays(batch.columns[: len(schema)], names=schema.names)
            texts = as_bytes(batch.column(text))
            for t, lines in zip(texts, found):
                gone = np.array(lines or [], np.int64)
                out += _dropper(lambda h, gone=gone: np.isin(h[:, 0].view(np.int64), gone))([t])
            if as_documents:
                yield with_text(batch, text, [None if gone else kept for gone, (_, _, kept) in zip(null_mask(batch.column(text)), out)])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())],
                    names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
                )

    kind = schema[id_column].dataType.simpleString()
    return joined.mapInArrow(finish, schema if as_documents else f"doc_id {kind}, {OUT}")
