"""Best-fit packing by sums of squares.

Documents become token pieces of at most one sequence; each piece goes where the
sum over residual gaps of the squared number of open sequences with that gap
becomes smallest. Pieces are dealt at random into shards of bounded size, packed
independently from the longest piece on; a shard leaves its last sequences short,
a fraction that its size bounds.

Defined results: a null text is an empty document, one piece with the end token
alone; repeated rows are packed each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Renamed, Scratch, as_bytes, slices, worker_cache

CACHE_WORDS = 400_000
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # one piece where it stands together; the apostrophe may begin another


class WordEncoder:
    """Token ids by the tokenizer, word by word.

    The vocabulary drops white space, and no token spans it, so the ids of a text
    are those of its words, one after another; words are what ASCII white space
    separates. Each distinct word is encoded once per worker, as long as the
    bounded cache holds it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), {}, {}
        self.one, self.bytes = self.tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _encode(self, word: bytes) -> bytes:
        """Words of Latin-1 letters, with punctuation at their end or without, take the model's direct way; others the tokenizer's."""
        bare = word.rstrip(PUNCTUATION)
        if not bare:
            return self._slow(word)
        letters = bare.decode("utf-8", "replace")
        if not letters.isalpha() or not bare.isascii() and max(letters) > "\u00ff":
            return self._slow(word)
        p = letters.lower()
        found = self.pieces.get(p)
        if found is None:
            ids = [t.id for t in self.one(p if p.isascii() else self.bytes(p)[0][0])]
            found = self.pieces[p] = struct.pack(f"<{len(ids)}I", *ids)
        return found if len(bare) == len(word) else found + self._mark(word[len(bare) :])

    def _mark(self, mark: bytes) -> bytes:
        found = self.pieces.get(mark)
        if found is None:
            found = self.pieces[mark] = self._slow(mark)
        return found

    def _slow(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words, known = text.split(), self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        for w in set(words).difference(known):
            known[w] = self._encode(w)
        return b"".join(map(known.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", id_column: str = "doc_id", capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut into pieces of the capacity."""
    kind = docs.schema[id_column].dataType.simpleString()
    tail, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches, 1):
            take, piece, start, length, crc = [], [], [], [], []
            for row, t in enumerate(as_bytes(batch.column(1))):
                ids = enc.encode(t) + tail
                for k in range(0, len(ids), step):
                    cut = ids[k : k + step]
                    take.append(row)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, taken in the given order.

    A piece opens a sequence only if it fits no open one. Among those it fits, it
    takes the gap that leaves the smallest sum of squares; the smallest such gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; index 0 stays 0: a full one is closed
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        cost = np.where(here > 0, 2 * (count[: capacity + 1 - s] - here) + 2, never)
        if here[0]:
            cost[0] = 1 - 2 * here[0]  # a closed sequence leaves no gap behind
        gap = int(cost.argmin()) + s
        if count[gap]:
            b = open_[gap].pop()
            count[gap] -= 1
        else:
            b, gap, made = made, capacity, made + 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(b)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = 50_000) -> DataFrame:
    """pieces (any columns, among them length) with sequence_id and offset, to which columns of these names give way; whole sequences need no partner."""
    scratch = Scratch(pieces.sparkSession, "packing")
    named = Renamed(pieces, tag=F.monotonically_increasing_id())
    size, given = named["length"], [f"c{i}" for i in range(len(named.names))]
    own = scratch.put(named.df)
    part = own.where(F.col(size) < capacity)
    shards = max(1, round(part.count() / shard_rows))
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("tag"), F.lit(shards)))
    schema = own.select(given).schema.add("sequence_id", "long").add("offset", "long")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([size, "tag"], ascending=[False, True], kind="stable")
        sequence, offset = sum_of_squares(group[size].to_numpy(), capacity)
        group["sequence_id"], group["offset"] = sequence + (group["shard"].to_numpy() << 32), offset
        return group[schema.names]

    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    full = own.where(F.col(size) >= capacity).withColumn("sequence_id", -1 - F.col("tag")).withColumn("offset", F.lit(0).cast("long")).select(schema.names)
    added = ("sequence_id", "offset")
    return packed.unionByName(full).select(*named.back(added), *added)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", id_column: str = "doc_id", capacity: int = 2048, end: int = 0, shard_rows: int = 50_000) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(token_pieces(docs, tokenizer, text, id_column, capacity, end), capacity, shard_rows)
