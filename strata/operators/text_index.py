"""Substring search through an index of character pairs.

For each pair of adjacent characters and each 32,768 ids, a bitmap tells which of those ids' normalised texts hold the pair. A query
intersects the bitmaps of its own pairs, and only rows that are left are read and compared, so results are those of
``search.text_hits``. The index may name too many rows, never too few: changed and new rows are added in
a folder of their own, and what a row held before is met by the comparison.

Defined results: a query of fewer than two normalised characters finds nothing; null texts and texts of one character are in no
bitmap; ids may be of any sign; repeated rows are found as often as the table has them; an index of no rows finds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import normalise
from strata.operators.filters import Filter, newest_first
from strata.operators.narrow import either, narrowed
from strata.sources.shared import written

PIECE = 65_536  # characters of a text that are cut into pairs at once
LISTED = 64  # pairs that the scan of an index is asked for one by one
POSTING = "pair string, bucket long, bits binary"


def pairs(text: Column) -> Column:
    """The distinct pairs of adjacent characters of a text that has two at least."""
    each = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(text, "")), each)))  # split once


def postings(files: DataFrame) -> DataFrame:
    """(pair, bucket, bits) of the rows; the bits of rows in one place are combined before they move."""
    long_enough = files.where(F.length("ocr_n") >= 2).select("id", "ocr_n", F.length("ocr_n").alias("n"))
    starts = F.sequence(F.lit(0), F.floor((F.col("n") - 2) / PIECE).cast("int"))
    pieces = long_enough.select("id", F.explode(F.transform(starts, lambda k: F.substring(F.col("ocr_n"), k * PIECE + 1, F.lit(PIECE + 1)))).alias("piece"))
    flat = pieces.select(F.explode(pairs(F.col("piece"))).alias("pair"), F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    return flat.groupBy("pair", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


#: Positions of the set bits of column bits: bytes that have any first, then their bits.
SET_BITS = """flatten(transform(filter(sequence(0, octet_length(bits) - 1), k -> hex(substring(bits, k + 1, 1)) <> '00'),
  k -> filter(sequence(8 * k, 8 * k + 7), p -> (cast(conv(hex(substring(bits, k + 1, 1)), 16, 10) AS int) & shiftleft(1, p - 8 * k)) > 0)))"""


def ids_of(found: DataFrame) -> DataFrame:
    """(q, id) of (q, bucket, bits)."""
    flat = found.select("q", "bucket", F.explode(F.expr(SET_BITS)).alias("p"))
    return flat.select("q", F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1 + F.col("p")).otherwise(F.col("bucket") * 32768 - F.col("p")).cast("long").alias("id"))


class TextIndex:
    """The bitmaps in a shared folder; every build or addition is a folder of its own, so a failed one leaves nothing half-written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def add(self, files: DataFrame) -> None:
        """New rows, or changed ones again. Rows should lie by id (as snapshots do), so that few tasks share a bitmap."""
        postings(files).sortWithinPartitions("pair", "bucket").write.parquet(f"{self.root}/part={uuid.uuid4().hex}")  # as grouping left them: no further shuffle

    def candidates(self, texts: list[str]) -> DataFrame:
        """(q, id): rows whose texts hold all pairs of the query of that position, and perhaps not in one piece."""
        asked = [(q, {w[i : i + 2] for i in range(len(w) - 1)}) for q, w in enumerate(normalise(t)[0] for t in texts)]
        each = [(q, p, len(held)) for q, held in asked for p in sorted(held)]
        if not each:
            return self.spark.createDataFrame([], "q int, id long")
        queries = self.spark.createDataFrame(each, "q int, pair string, n int")  # the request
        wanted = sorted({p for _, p, _ in each})
        held = self.spark.read.schema(POSTING).parquet(self.root)
        if len(wanted) <= LISTED:
            held = held.where(either([F.col("pair") == p for p in wanted]))
        else:
            held = held.where(F.col("pair").between(wanted[0], wanted[-1]))
        one = held.join(F.broadcast(queries.select("pair").distinct()), "pair", "left_semi").groupBy("pair", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        met = one.join(F.broadcast(queries), "pair").groupBy("q", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        return ids_of(met.where("k = n"))

    def hits(self, files: DataFrame, texts: list[str], chosen: Filter = Filter(), limit: int = 200) -> DataFrame:
        """files' rows with q, the query's position: for each query those that ``search.text_hits`` finds."""
        found = written(self.candidates(texts))
        asked = self.spark.createDataFrame([(q, normalise(t)[0]) for q, t in enumerate(texts)], "q int, wanted string")  # the request; dealt by q, all texts with a frequent word would meet in one task
        rows = narrowed(files, "id", found).where(chosen.column()).join(found, "id").join(F.broadcast(asked), "q").where(F.col("ocr_n").contains(F.col("wanted"))).drop("wanted")
        if len(texts) == 1:
            return newest_first(rows, limit)
        newest = Window.partitionBy("q").orderBy(F.coalesce("taken", F.lit("")).desc(), F.col("id").desc())
        return rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit).drop("__n")
