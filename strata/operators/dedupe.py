"""Duplicates: exact matches, roots of chains, groups to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.vectors import dot
from strata.operators.filters import live
from strata.sources.shared import written


def exact_matches(new: DataFrame, files: DataFrame) -> DataFrame:
    """(id, original): for each new file, the live file with the smallest id and the same hash, earlier than itself."""
    old = live(files).where(F.coalesce("sha256", F.lit("")) != "").select(F.col("id").alias("old"), "sha256")
    first = old.groupBy("sha256").agg(F.min("old").alias("original"))
    return new.select("id", "sha256").join(first, "sha256").where("original < id").select("id", "original")


def duplicate_roots(files: DataFrame) -> DataFrame:
    """(id, root) of live duplicates: duplicate_of is followed to the last live row; in a cycle everyone is their own root, and a chain that runs into one ends where it meets it."""
    own = live(files).select("id", F.when(F.col("duplicate_of") != 0, F.col("duplicate_of")).alias("dup"))
    alive = own.select(F.col("id").alias("dup"), F.lit(True).alias("alive"))
    start = own.join(alive, "dup", "left").select("id", F.when(F.col("alive"), F.col("dup")).alias("to"), F.col("dup").isNotNull().alias("is_dup"))
    start = start.select("id", F.coalesce("to", "id").alias("to"), "is_dup", F.col("to").isNull().alias("ends"))
    start = written(start)
    rounds = max(1, start.where("is_dup").count()).bit_length()
    now = _follow(start, rounds)
    # walks without an end have come to rest on cycles, and those of a cycle's rows on all of its rows
    ring = now.where("not ends").select(F.col("to").alias("id"), F.lit(True).alias("ring")).distinct()
    if ring.limit(1).count():
        stop = start.join(ring, "id", "left").select("id", F.when(F.col("ring"), F.col("id")).otherwise(F.col("to")).alias("to"), "is_dup", (F.col("ends") | F.coalesce("ring", F.lit(False))).alias("ends"))
        now = _follow(written(stop), rounds)
    return now.where("is_dup").select("id", F.col("to").alias("root"))


def _follow(step: DataFrame, rounds: int) -> DataFrame:
    """Pointers (id, to, is_dup, ends) after 2^rounds steps: each round doubles their reach, and stops when all have come to an end."""
    now = step
    for _ in range(rounds):
        if not now.where("not ends").limit(1).count():
            break
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("ends").alias("done"))
        now = now.join(ahead, "to").select("id", F.col("next").alias("to"), "is_dup", F.col("done").alias("ends"))
        now = written(now)
    return now


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(root, id, is_root, exact, sim, latest): members of each group beside its root, and when the group last grew."""
    roots = duplicate_roots(files)
    members = roots.select("root", "id").unionByName(roots.select("root", F.col("root").alias("id"))).distinct()
    own = live(files).select("id", "sha256", "vec", F.coalesce("received_at", F.lit(0.0)).alias("received_at"))
    base = own.select(F.col("id").alias("root"), F.col("sha256").alias("root_sha"), F.col("vec").alias("root_vec"))
    rows = members.join(own, "id").join(base, "root")
    is_root = F.col("id") == F.col("root")
    exact = ~is_root & F.coalesce((F.col("sha256") != "") & (F.col("sha256") == F.col("root_sha")), F.lit(False))
    sim = F.when(is_root, None).when(F.col("sha256").eqNullSafe(F.col("root_sha")), F.lit(1.0)).when(F.size("vec") == F.size("root_vec"), F.round(dot(F.col("vec"), F.col("root_vec")), 6))
    latest = rows.groupBy("root").agg(F.max("received_at").alias("latest"))
    return rows.join(latest, "root").select("root", "id", is_root.alias("is_root"), exact.alias("exact"), sim.alias("sim"), "latest")


def first_near(pairs: DataFrame, existing: DataFrame, threshold: float, most: int = 20) -> DataFrame:
    """(id, other, sim): of each file's best candidates (id, other, sim) at the threshold or above, the first that exists."""
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    top = pairs.where(F.col("sim") >= threshold).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    held = top.join(existing.select(F.col("id").alias("other")), "other", "left_semi")
    return held.groupBy("id").agg(F.min(F.struct("r", "other", "sim")).alias("m")).select("id", F.col("m.other").alias("other"), F.col("m.sim").alias("sim"))
