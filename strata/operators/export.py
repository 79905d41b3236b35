"""Export plans: where each chosen file goes, with names that don't collide."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.constants import OTHER


def subfolder(by: str) -> Column:
    """The folder of a file by category, month or place; empty for any other ``by``."""
    if by == "category":
        name = F.when(F.col("mode") == "plain", "plain").when(F.col("duplicate_of").isNotNull(), "duplicates").when(F.col("category") == OTHER, "other")
        return name.otherwise(F.when(F.coalesce("category", F.lit("")) == "", "other").otherwise(F.col("category")))
    if by == "month":
        return F.when(F.coalesce("taken", F.lit("")) == "", "no date").otherwise(F.col("taken"))
    if by == "place":
        both = F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("place1", "place2")))
        return F.when(both == "", "no place").otherwise(both)
    return F.lit("")


def archive_names(rows: DataFrame) -> DataFrame:
    """rows (pos, folder, name) with target: names made unique regardless of case, in the order of pos.

    A name may only collide with others whose stem is the same but for a number in
    brackets, so each such family is named on its own, by one task: rows are those of
    a user's request.
    """
    schema = rows.schema.add("target", "string")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        targets = []
        for folder, name in group.sort_values("pos")[["folder", "name"]].itertuples(index=False):
            full = f"{folder}/{name}" if folder else name
            dot = name.rfind(".")
            cut = len(full) - len(name) + dot if dot > 0 else len(full)
            target, i = full, 1
            while target.lower() in used:
                target, i = f"{full[:cut]} ({i}){full[cut:]}", i + 1
            used.add(target.lower())
            targets.append(target)
        return group.sort_values("pos").assign(target=targets)[schema.names]

    family = F.lower(F.concat_ws("/", "folder", F.regexp_replace(F.lower("name"), r"( \(\d+\))+(?=(\.[^.]*)?$)", "")))
    return rows.withColumn("__family", family).groupBy("__family").applyInPandas(lambda g: run(g.drop(columns="__family")), schema)


def plan(files: DataFrame, ids: list[int], by: str = "") -> DataFrame:
    """(pos, id, src, target) for live files in the order of the request."""
    from strata.operators.filters import live, multi_get

    rows = multi_get(live(files), ids).select("pos", "id", F.col("path").alias("src"), subfolder(by).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return archive_names(rows).select("pos", "id", "src", "target")


def archive(moves: Iterator[tuple[str, str]], target: str) -> int:
    """Writes (src, name) pairs into a ZIP file, stored without compression; the file appears when it is whole."""
    import os
    import zipfile

    n = 0
    with zipfile.ZipFile(f"{target}.part", "w", zipfile.ZIP_STORED) as z:
        for src, name in moves:
            z.write(src, name)
            n += 1
    os.replace(f"{target}.part", target)
    return n


def copy(moves: Iterator[tuple[str, str]]) -> int:
    """Carries out (src, dst) pairs on the driver's file system, never overwriting."""
    import os
    import shutil

    n = 0
    for src, dst in moves:
        if os.path.exists(dst):
            raise FileExistsError(dst)
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.copy2(src, dst)
        n += 1
    return n
