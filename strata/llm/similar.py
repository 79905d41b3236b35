"""Near-dedup by word-shingle Jaccard similarity: SimHash balls and MinHash bands propose pairs, the shingle sets decide.

Rows with equal sets of shingle hashes are one node. Nodes whose SimHash fingerprints lie
within RADIUS bits are proposed by ball hashing. Sets that are just similar enough differ in
about ten of 64 bits, where balls are out of reach; for these a set has BANDS keys of BAND minima each; sets of similarity s share no key with probability (1 - s^4)^40, which is
7e-10 at s = 0.8 and less above. Members of a key are compared with the one of them
whose keys are the most common; those that aren't all linked by that are compared
where their rarest shingles meet, which passes over no similar pair. Every link is a
pair whose whole sets reach the similarity.

Defined results: words are split at ASCII white space and A-Z lower-cased; fewer words
than a shingle has are one shingle; null and blank texts have the empty set and are
equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import Renamed, Scratch, as_bytes, row_hash, slices
from strata.llm.components import components
from strata.llm.simhash import BITS, links, stay_one

BANDS, BAND, RADIUS = 40, 4, 4
CHUNK = 1 << 13
ROUNDING = 1e-9  # of counts: a similarity of just 0.8 counts
_random = np.random.default_rng(8)
FACTORS = _random.integers(0, 1 << 63, BANDS * BAND).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 1 << 63, BANDS * BAND).astype(np.uint64) * np.uint64(2)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words_per_shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - words_per_shingle + 1
    if n <= 1:
        return np.array([digest(joined, seed)], np.uint64)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words_per_shingle - 1 :])], np.uint64))


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def band_keys(own: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[k : k + CHUNK, None] * FACTORS + ADDENDS).min(0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in least.reshape(BANDS, BAND).T:
        keys = (keys ^ column) * MIX
        keys ^= keys >> np.uint64(29)
    return keys


def simhash(own: np.ndarray) -> int:
    """The SimHash fingerprint of the set: a bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view("<u8")[0])


def marks(docs: DataFrame, keep: list, text: str, words_per_shingle: int) -> DataFrame:
    """The columns ``keep``, fp long (the key of the shingle set), size long, bits long (its fingerprint) and bands array<long>."""
    schema = docs.select(*keep).schema.add("fp", "long").add("size", "long").add("bits", "long").add("bands", T.ArrayType(T.LongType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            sets = [shingles(t, words_per_shingle) for t in as_bytes(batch.column("__text"))]
            fp = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            bands = [band_keys(s).view(np.int64) for s in sets]
            bits = np.array([simhash(s) for s in sets], np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names) - 4)), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits), listed], names=names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def sets_of(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """(fp, own): the shingle hashes of the texts in column text, once for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [shingles(t, words_per_shingle) for t in as_bytes(batch.column(0))]
            fp = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "own"])

    return rows.select("text").mapInArrow(run, "fp long, own binary").dropDuplicates(["fp"])


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= least * (len(x) + len(y) - common) - ROUNDING)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - F.lit(ROUNDING)


def rare_pairs(sets: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(a, b): all pairs of the sets (fp, comp, own) of different components that can have the similarity.

    Shingles are ordered by how many of the sets have them. Similar sets share one among
    the rarest of both, and their first common one leaves enough behind it in both.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, comp, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x, np.int64)) for x in (fp, comp, len(own))] + [pa.array(own)], names=["fp", "comp", "size", "shingle"])

    spelled = scratch.put(sets.select("fp", "comp", "own").mapInArrow(spell, "fp long, comp long, size long, shingle long"))
    counts = spelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("n", "shingle"))
    rare = spelled.join(counts, "shingle").withColumn("behind", F.col("size") - place + 1)  # itself and what follows
    rare = scratch.put(rare.where((F.col("n") > 1) & (F.col("behind") >= F.col("size") * F.lit(least) - F.lit(ROUNDING))).drop("n"))
    scratch.drop(spelled)
    other = rare.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("fp", "comp", "size", "behind")))
    enough = F.least("behind", "behind2") >= (F.col("size") + F.col("size2")) * F.lit(least / (1 + least)) - F.lit(ROUNDING)
    return rare.join(other, "shingle").where((F.col("fp") < F.col("fp2")) & (F.col("comp") != F.col("comp2")) & _alike("size", "size2", least) & enough).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()


def ball_pairs(nodes: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(a, b): pairs to compare of nodes (fp, size, bits) whose fingerprints lie within RADIUS bits, by ball hashing; of nodes with one fingerprint the first stands for all."""
    first = scratch.put(nodes.groupBy("bits").agg(F.min(F.struct("fp", "size")).alias("one")))
    met = links(first.select(F.col("bits").alias("fp")), first.count(), RADIUS)
    one = lambda c: first.select(F.col("bits").alias(c), F.col("one.fp").alias(f"{c}_fp"), F.col("one.size").alias(f"{c}_size"))
    across = met.join(one("a"), "a").join(one("b"), "b").where(_alike("a_size", "b_size", least)).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    within = nodes.join(first, "bits").where((F.col("fp") != F.col("one.fp")) & _alike("size", "one.size", least)).select(F.col("one.fp").alias("a"), F.col("fp").alias("b"))
    return scratch.put(across.unionByName(within))


def near_groups(docs: DataFrame, found: DataFrame, whole: Column, text: str, scratch: Scratch, least: float, words_per_shingle: int) -> DataFrame:
    """(fp, comp) for every set in ``found`` (marks with the row hash)."""
    nodes = scratch.put(found.groupBy("fp").agg(F.min_by(F.struct("hash", "size", "bits", "bands"), "hash").alias("one")).select("fp", "one.*"))
    members = nodes.select("fp", "size", F.explode("bands").alias("band"))
    shared = scratch.put(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    every = scratch.put(members.join(shared, "band"))
    weight = every.groupBy("fp").agg(F.sum("n").alias("weight"))
    lead = every.join(weight, "fp").groupBy("band").agg(F.max(F.struct("weight", "fp", "size")).alias("lead"))
    meet = scratch.put(every.join(lead, "band").where(F.col("fp") != F.col("lead.fp")))
    scratch.drop(shared, every)
    del members, shared, every, weight, lead
    scratch.sweep()
    able = _alike("size", "lead.size", least)
    near = ball_pairs(nodes.select("fp", "size", "bits"), scratch, least)
    pairs = scratch.put(meet.where(able).select(F.col("lead.fp").alias("a"), F.col("fp").alias("b")).unionByName(near).distinct())
    asked = meet.select("fp").union(meet.select("lead.fp")).union(near.select("a")).union(near.select("b")).distinct()
    wanted = nodes.join(asked, "fp", "left_semi").select("hash")
    named = Renamed(docs, hash=whole)
    hashes = scratch.put(wanted)
    sets = scratch.put(sets_of(named.df.join(hashes, "hash", "left_semi").select(F.col(named[text]).alias("text")), words_per_shingle))
    first = scratch.put(linked(pairs, sets, least))
    scratch.drop(near, pairs, hashes)
    del near, pairs, asked, wanted, hashes
    scratch.sweep()

    # What is left: other members of a key that aren't all linked yet.
    groups = scratch.put(components(first, scratch))
    held = meet.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("band", "fp", F.coalesce("comp", "fp").alias("comp"))
    open_bands = held.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    rest = held.join(open_bands, "band").select("fp", "comp").distinct()
    others = scratch.put(rest.join(sets, "fp"))
    pairs = scratch.put(rare_pairs(others, scratch, least))
    scratch.drop(others)
    scratch.sweep()
    groups = components(first.unionByName(linked(pairs, sets, least)), scratch)
    return nodes.select("fp").join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def keep_one_similar(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """One row of each group of texts linked by the similarity, as in simhash.keep_one."""
    scratch = Scratch(docs.sparkSession, "similar")
    whole = row_hash(docs)
    found = scratch.put(marks(docs, [F.col(id_column).alias("id"), whole.alias("hash")], text, words_per_shingle))
    return stay_one(docs, id_column, whole, found.select("id", "hash", "fp"), near_groups(docs, found, whole, text, scratch, least, words_per_shingle), scratch)
