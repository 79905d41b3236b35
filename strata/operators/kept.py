"""Figures that are kept and follow changes: what the changed rows said before is taken away, what they say now is added.

``old`` and ``new`` are the rows of a change as they were and as they are; a row that came or went is in one of them alone. Counts
and sums are folded from these rows. Lists of the first few of a key can't be, so they are made again for
the keys that the rows touch, and stay for all others. What is kept equals a fresh run after every change.

Defined results: a change of no rows keeps all; a key whose count falls to nothing goes; null keys are keys; rows that are in
both and equal cancel out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import rollups
from strata.operators.filters import live

Rollup = Callable[[DataFrame], DataFrame]


def place_counts(files: DataFrame) -> DataFrame:
    """(p1, p2, n), from which ``rollups.places`` follows."""
    return live(files).where(F.col("place1").isNotNull()).groupBy(F.col("place1").alias("p1"), F.col("place2").alias("p2")).agg(F.count(F.lit(1)).alias("n"))


def month_place_counts(files: DataFrame) -> DataFrame:
    """(month, place, n), from which ``rollups.month_places`` follows."""
    return live(files).where(F.col("place1").isNotNull()).groupBy(F.coalesce("taken", F.lit("")).alias("month"), F.coalesce("place2", "place1").alias("place")).agg(F.count(F.lit(1)).alias("n"))


#: Figures by name: the roll-up, its keys, and how many rows a group has (a group of none goes; a figure without keys stays).
SUMS: dict[str, tuple[Rollup, list[str], str]] = {
    "category_counts": (rollups.category_counts, ["category"], "n"),
    "totals": (rollups.totals, [], "total"),
    "home_categories": (rollups.home_categories, ["category"], "n"),
    "place_counts": (place_counts, ["p1", "p2"], "n"),
    "without_place": (rollups.without_place, [], "none"),
    "month_counts": (rollups.month_counts, ["month"], "n"),
    "month_place_counts": (month_place_counts, ["month", "place"], "n"),
}

#: Lists by name: the roll-up, its key, and the key as a column of files.
LISTS = {
    "covers": (rollups.covers, "category", F.col),
    "month_files": (rollups.month_files, "month", lambda _: F.coalesce("taken", F.lit(""))),
}


def start(files: DataFrame) -> dict[str, DataFrame]:
    """All figures from all rows."""
    return {name: f(files) for name, (f, *_) in (SUMS | LISTS).items()}


def folded(kept: DataFrame, name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """A sum of ``SUMS`` after a change; only kept groups and changed rows are read."""
    rollup, keys, count = SUMS[name]
    figures = [c for c in kept.columns if c not in keys]
    less = rollup(old).select(*keys, *((-F.col(c)).alias(c) for c in figures))
    out = kept.unionByName(rollup(new)).unionByName(less).groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in figures))
    return out.where(F.col(count) != 0) if keys else out


def relisted(kept: DataFrame, name: str, files: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """A list of ``LISTS`` after a change: files are asked for the touched keys alone."""
    rollup, key, column = LISTS[name]
    touched = old.select(column(key).alias("__key")).unionByName(new.select(column(key).alias("__key"))).distinct()
    mine = files.withColumn("__of", column(key)).join(touched, F.col("__of").eqNullSafe(F.col("__key")), "left_semi").drop("__of")
    rest = kept.join(touched, kept[key].eqNullSafe(touched["__key"]), "left_anti")
    return rest.unionByName(rollup(mine))


def follow(kept: dict[str, DataFrame], files: DataFrame, old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """All figures after a change; files are the rows after it."""
    return {name: folded(rows, name, old, new) if name in SUMS else relisted(rows, name, files, old, new) for name, rows in kept.items()}
