"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits share a variant within r bits of both (within 2r - 1,
one within r bits of one and r - 1 of the other), so every
distinct fingerprint stands for all its variants within half the radius, and
equal variants meet. Variants are dealt by a block of their bits: what is
shuffled is the fingerprint, once for each value that the block takes in its
ball, and the ball's part in that block is spelled out by the task that gets it.
Fingerprints that meet in a variant are all linked; a chain to the smallest says
as much as all pairs, and is verified bit by bit.

Defined results: a null or blank text has fingerprint zero and is linked like any
other; repeated rows share a fingerprint; a group without any id has a null one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Renamed, Scratch, as_bytes, row_hash, slices
from strata.llm.components import components

BITS = 64
CHUNK = 1 << 20
VARIANTS_PER_SHARD, FINER = 2_000_000, 12


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles, repeats included; 0 if there is no word."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - words_per_shingle + 1
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    ends = ends[words_per_shingle - 1 :]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list, text: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """The columns ``keep``, none of them named fp, and fp long (the fingerprint's bits)."""
    schema = docs.select(*keep).schema.add("fp", "long")
    last = len(schema) - 1
    chosen = docs.select(*keep, F.col(text)).toDF(*(f"c{i}" for i in range(last + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, last):
            fp = np.array([fingerprint(t, words_per_shingle) for t in as_bytes(batch.column(last))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(fp.view(np.int64))], names=schema.names)

    return chosen.mapInArrow(run, schema)


def flips(bits: range, most: int) -> list[int]:
    """All masks that flip at most so many of the bits."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(bits, k)]


def shard_links(fps: np.ndarray, value: int, block: int, half: int, radius: int | None = None) -> np.ndarray:
    """Links (n, 2) among the fingerprints whose balls reach into the block's value: smallest of a variant, other."""
    low = np.uint64((1 << block) - 1)
    fps = np.unique(fps)
    off = np.bitwise_count((fps & low) ^ np.uint64(value))
    base = (fps & ~low) | np.uint64(value)
    variants, origin = [], []
    for d in range(half + 1):
        own = np.flatnonzero(off == d)
        masks = np.array(flips(range(block, BITS), half - d), np.uint64)
        variants.append((base[own][:, None] ^ masks).ravel())
        origin.append((own, len(masks)))
    v = np.concatenate(variants)
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros((0, 2), np.uint64)
    at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == v)
    who, first = np.empty(len(hit), np.int64), 0
    done = 0
    for own, m in origin:
        end = first + len(own) * m
        k = np.searchsorted(hit, end) - done
        who[done : done + k] = own[(hit[done : done + k] - first) // m]
        first, done = end, done + k
    least = np.full(len(twice), len(fps), np.int64)
    radius = 2 * half if radius is None else radius
    near = np.bitwise_count(v[hit] ^ fps[who]) <= radius - half  # of an odd radius, only these are within it of all that meet here
    np.minimum.at(least, at[hit][near], who[near])
    pairs = np.unique(np.column_stack([least[at[hit]], who]), axis=0)
    pairs = pairs[pairs[:, 0] < len(fps)]
    a, b = fps[pairs[:, 0]], fps[pairs[:, 1]]
    ok = (a != b) & (np.bitwise_count(a ^ b) <= radius)
    return np.column_stack([a[ok], b[ok]])


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(a, b): links that connect every two fingerprints (column fp) within the radius, directly or through others that are linked.

    Where fingerprints crowd, so that a block's value would have too many variants, the block is longer by FINER bits.
    """
    half = -(-radius // 2)
    ball = sum(math.comb(BITS, k) for k in range(half + 1))
    block = min(32, max(4, math.ceil(math.log2(max(1, n * ball / VARIANTS_PER_SHARD)))))
    low = lambda bits: F.lit((1 << bits) - 1)
    masks = F.array(*(F.lit(m).cast("long") for m in flips(range(block), half)))
    dealt = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(low(block)).bitwiseXOR(m))).alias("shard"))
    dealt = dealt.withColumn("off", F.bit_count(F.col("fp").bitwiseAND(low(block)).bitwiseXOR(F.col("shard"))))
    inside = lambda off: sum(math.comb(BITS - block, k) for k in range(half - off + 1))  # noqa: E731  variants of a fingerprint so far from the block's value
    weight = F.element_at(F.array(*(F.lit(inside(k)) for k in range(half + 1))), (F.col("off") + 1).cast("int"))
    crowded = dealt.groupBy("shard").agg(F.sum(weight).alias("w")).where(F.col("w") > 4 * VARIANTS_PER_SHARD).select("shard", F.lit(True).alias("crowded"))
    more = F.array(*(F.array(*(F.lit(m).cast("long") for m in flips(range(block, block + FINER), half - k))) for k in range(half + 1)))
    longer = F.col("fp").bitwiseAND(F.lit(((1 << FINER) - 1) << block)).bitwiseOR(F.col("shard"))
    values = F.when(F.col("crowded"), F.transform(F.element_at(more, (F.col("off") + 1).cast("int")), lambda m: longer.bitwiseXOR(m))).otherwise(F.array("shard"))
    dealt = dealt.join(crowded, "shard", "left").select("fp", F.explode(values).alias("shard"), F.when(F.col("crowded"), block + FINER).otherwise(block).alias("block"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = shard_links(group["fp"].to_numpy().view(np.uint64), int(group["shard"].iloc[0]), int(group["block"].iloc[0]), half, radius)
        return pd.DataFrame({"a": found[:, 0].view(np.int64), "b": found[:, 1].view(np.int64)})

    return dealt.groupBy("shard", "block").applyInPandas(run, "a long, b long").distinct()


def near_groups(fps: DataFrame, scratch: Scratch, radius: int = 4) -> DataFrame:
    """(fp, comp) for every fingerprint in column fp: the smallest fingerprint (signed) reachable over links."""
    own = scratch.put(fps.select("fp").distinct())
    found = components(links(own, own.count(), radius), scratch)
    return own.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: fingerprints as 16 hex digits, and the smallest id reachable over links.

    Groups are found in about as many rounds as a chain's length has binary digits; after components.MAX_ROUNDS an error is raised.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, [F.col(id_column).alias("doc_id")], text, words_per_shingle))
    groups = scratch.put(near_groups(fps, scratch, radius))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(groups, "fp").groupBy("comp").agg(F.min("first").alias("component_id"))
    first = scratch.put(first)  # so that Spark can split the rows of a large component in the join
    return fps.join(groups.join(first, "comp").drop("comp"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id", radius: int = 4, words_per_shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """One row of each group, all columns kept: the one with the smallest id, nulls last.

    With ``similarity`` texts are linked if and only if their shingle sets have that Jaccard similarity: balls of the
    radius propose pairs, strata.llm.similar those beyond it, and whole sets decide.

    Where rows of a group tie on that id, the one with the smallest row hash
    stays; rows that are equal in every column become one.
    """
    if similarity is not None:
        from strata.llm.similar import keep_one_similar

        return keep_one_similar(docs, text, id_column, similarity, words_per_shingle)
    scratch = Scratch(docs.sparkSession, "simhash")
    whole = row_hash(docs)
    fps = scratch.put(fingerprints(docs, [F.col(id_column).alias("id"), whole.alias("hash")], text, words_per_shingle))
    return stay_one(docs, id_column, whole, fps, near_groups(fps, scratch, radius), scratch)


def stay_one(docs: DataFrame, id_column: str, whole: Column, fps: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that stay, by fps (id, hash, fp) and groups (fp, comp); ``whole`` is the row hash."""
    row = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    best = fps.groupBy("fp").agg(F.min(row).alias("best")).join(groups, "fp").groupBy("comp").agg(F.min("best").alias("best"))
    stay = scratch.put(best.select("best.id", "best.hash"))
    named = Renamed(docs, hash=whole)
    rows = named.df.join(stay, (named.df["hash"] == stay["hash"]) & named.df[named[id_column]].eqNullSafe(stay["id"]), "left_semi")
    repeated = fps.groupBy("id", "hash").count().where("count > 1").limit(1).count()
    scratch.keep_only(stay)
    return (rows.dropDuplicates(["hash", named[id_column]]) if repeated else rows).select(named.back())
