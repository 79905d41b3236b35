"""Rows of a table by many ids, so that the scan skips what none of them lies in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BLOCKS, SPANS = 1024, 10_000, 64  # ids in a block, blocks that the driver looks at, ranges in a filter


def spans(ids: DataFrame, key: str) -> list[tuple[int, int]] | None:
    """At most SPANS ranges that hold all ids, apart at the widest gaps; None if the ids lie in more than BLOCKS blocks, where a scan had better read all."""
    found = ids.where(F.col(key).isNotNull()).select(F.floor(F.col(key) / BLOCK).cast("long").alias("b")).distinct().limit(BLOCKS + 1).collect()
    if len(found) > BLOCKS:
        return None
    blocks = sorted(x.b for x in found)
    gaps = sorted(range(1, len(blocks)), key=lambda i: blocks[i - 1] - blocks[i])[: SPANS - 1]
    cuts = [0, *sorted(i for i in gaps if blocks[i] - blocks[i - 1] > 1), len(blocks)]
    return [(blocks[a] * BLOCK, blocks[b - 1] * BLOCK + BLOCK - 1) for a, b in zip(cuts, cuts[1:]) if b > a]


def either(parts: list[Column]) -> Column:
    """Any of the conditions, as a tree of little depth."""
    while len(parts) > 1:
        parts = [reduce(Column.__or__, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def narrowed(table: DataFrame, key: str, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """table's rows whose key is among ids, which are asked twice and so should be written; the ranges of the ids are filters that Parquet takes."""
    own, among = spans(ids, id_column), ids.select(F.col(id_column).alias(key)).distinct()
    if own is not None:
        table = table.where(either([F.col(key).between(a, b) for a, b in own]))
    return table.join(among, key, "left_semi")
