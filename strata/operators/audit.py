"""Completeness of batches, verified copies, and what may be sent: joins with a table of file probes.

probe: path, exists, size, opens, sha256 (null where unknown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.constants import LEGACY_BATCH


def with_probe(files: DataFrame, probe: DataFrame) -> DataFrame:
    p = probe.select("path", F.col("exists").alias("p_exists"), F.col("size").alias("p_size"), F.col("opens").alias("p_opens"), F.col("sha256").alias("p_sha"))
    return files.join(p, "path", "left").withColumn("p_exists", F.coalesce("p_exists", F.lit(False)))


def verified(files: DataFrame, probe: DataFrame) -> DataFrame:
    """(id, sha256, size): live files that exist with the size and hash that the index knows."""
    same = lambda a, b: F.col(a).isNull() | F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return with_probe(files.where(~F.col("removed")), probe).where(F.col("p_exists") & same("size", "p_size") & same("sha256", "p_sha")).select("id", "sha256", "size")


def file_problems(files: DataFrame, probe: DataFrame) -> DataFrame:
    """(id, bid, name, why) of live files that are missing, of another size, or don't open."""
    own = with_probe(files.where(~F.col("removed")), probe).withColumn("bid", F.coalesce("batch", F.lit(LEGACY_BATCH)))
    why = F.when(~F.col("p_exists"), "not_found").when((F.col("size") != 0) & (F.col("p_size") != F.col("size")), "size").when(~F.coalesce("p_opens", F.lit(False)), "cant_open")
    return own.select("id", "bid", "name", why.alias("why")).where("why is not null")


def copy_missing(items: DataFrame, files: DataFrame, probe: DataFrame) -> DataFrame:
    """(batch, fid, why) of indexed items without a valid copy."""
    own = with_probe(files, probe).select(F.col("id").alias("file_id"), F.col("sha256").alias("f_sha"), F.col("removed").alias("f_removed"), F.col("duplicate_of").alias("f_dup"), F.col("size").alias("f_size"), "p_exists")
    rows = items.where("status = 'indexed'").select("batch", "fid", "file_id", "sha256", "got_size").join(own, "file_id", "left").withColumn("sha", F.coalesce("sha256", "f_sha")).withColumn("want", F.coalesce("got_size", "f_size"))
    good = verified(files, probe).where(F.coalesce("sha256", F.lit("")) != "").groupBy(F.col("sha256").alias("sha"), F.col("size").alias("want")).agg(F.lit(True).alias("copy"))
    rows = rows.join(good, ["sha", "want"], "left")
    known = F.col("f_removed").isNotNull()
    differs = F.coalesce((F.col("sha256") != F.col("f_sha")), F.lit(False))
    why = (
        F.when(known & differs, "index_mismatch").when(known & ~F.col("f_removed"), None).when(known & F.col("f_dup").isNull() & F.col("p_exists"), None)
        .when(F.coalesce("copy", F.lit(False)), None).when(~known, "gone").otherwise("kept_missing")
    )
    return rows.select("batch", "fid", why.alias("why")).where("why is not null")


def item_problems(items: DataFrame) -> DataFrame:
    """(batch, fid, why) of items that aren't indexed."""
    word = F.when(F.col("status") == "expected", "not_received").when(F.col("status") == "received", "processing").when(F.col("status") == "failed", "transfer_failed").when(F.col("status") == "error", "process_failed").otherwise("unknown")
    full = F.when(F.col("status").isin("failed", "error") & (F.coalesce("error", F.lit("")) != ""), F.concat(word, F.lit(":"), "error")).otherwise(word)
    return items.where("status <> 'indexed'").select("batch", "fid", full.alias("why"))


def batch_checks(files: DataFrame, batches: DataFrame, items: DataFrame, probe: DataFrame) -> DataFrame:
    """One row per batch: (batch, total, images, videos, others, bad, busy, ok); a batch is ok if nothing is bad and it holds anything."""
    own = files.where(~F.col("removed")).groupBy(F.coalesce("batch", F.lit(LEGACY_BATCH)).alias("bid")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(~F.col("kind").isin("image", "video")).alias("others")
    )
    listed = items.groupBy(F.col("batch").alias("bid")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "received").alias("busy"), F.count_if(F.col("status") == "indexed").alias("done"))
    bad = file_problems(files, probe).select("bid").unionByName(copy_missing(items, files, probe).select(F.col("batch").alias("bid"))).unionByName(item_problems(items).select(F.col("batch").alias("bid")))
    bad = bad.groupBy("bid").agg(F.count(F.lit(1)).alias("bad"))
    # batches from before items were recorded: their count, and the originals of duplicates that were cleared
    have = files.groupBy(F.col("batch").alias("bid")).agg(F.count(F.lit(1)).alias("have"))
    target = with_probe(files.select("id", "path", "size", "removed"), probe).select(F.col("id").alias("duplicate_of"), F.col("removed").alias("o_removed"), F.col("size").alias("o_size"), "p_exists", "p_size")
    cleared = files.where(F.col("removed") & F.col("duplicate_of").isNotNull()).join(target, "duplicate_of", "left")
    lost = F.coalesce(F.col("o_removed"), F.lit(True)) | ~F.coalesce("p_exists", F.lit(False)) | F.coalesce((F.col("o_size") != 0) & (F.col("p_size") != F.col("o_size")), F.lit(False))
    cleared = cleared.groupBy(F.col("batch").alias("bid")).agg(F.count(F.lit(1)).alias("dups"), F.count_if(lost).alias("lost"))
    every = batches.select(F.col("id").alias("bid"), F.col("count").alias("expected"))
    out = own
    for part, how in ((every, "full"), (listed, "left"), (bad, "left"), (have, "left"), (cleared, "left")):
        out = out.join(part, "bid", how)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    old = (z("items") == 0) & (F.col("bid") != LEGACY_BATCH)
    short = F.when(old & (z("expected") > 0) & (z("have") < z("expected")), 1).otherwise(0)
    wrong = z("bad") + short + F.when(old, z("lost")).otherwise(0)
    holds = (z("rows") > 0) | (z("done") > 0) | (old & (z("dups") > 0))
    total: Column = F.when(z("items") > 0, z("items")).otherwise(z("rows"))
    return out.select(F.col("bid").alias("batch"), total.alias("total"), z("images").alias("images"), z("videos").alias("videos"), z("others").alias("others"), wrong.alias("bad"), z("busy").alias("busy"), ((wrong == 0) & holds).alias("ok"))


def batch_times(files: DataFrame, probe: DataFrame) -> DataFrame:
    """(batch, first, last): the earliest and latest capture minute of each batch's images and videos that have no problem; probe has captured, a timestamp."""
    own = files.where(~F.col("removed") & F.col("kind").isin("image", "video")).join(file_problems(files, probe).select("id"), "id", "left_anti")
    at = own.join(probe.select("path", "captured"), "path").where("captured is not null").groupBy(F.coalesce("batch", F.lit(LEGACY_BATCH)).alias("batch"))
    return at.agg(*(F.date_format(f("captured"), "yyyy-MM-dd HH:mm").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))))


def retry_items(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Items that were received or failed in processing, with their batch's sender and mode."""
    b = batches.select(F.col("id").alias("batch"), "sender", "mode")
    return items.where(F.col("status").isin("received", "error")).join(b, "batch", "left").select("batch", "fid", "status", "sender", "mode")


def backfilled(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with the path, hash and size of their file where they have none of their own."""
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("__path"), F.col("sha256").alias("__sha256"), F.col("size").alias("__got_size"))
    own = items.join(f, "file_id", "left")
    return own.withColumns({c: F.coalesce(c, f"__{c}") if c in items.columns else F.col(f"__{c}") for c in ("path", "sha256", "got_size")}).drop("__path", "__sha256", "__got_size")


def registered(items: DataFrame, files: DataFrame) -> DataFrame:
    """(batch, fid, id): a file of the batch with the item's hash that no item claims; the smallest id."""
    claimed = items.where(F.col("file_id").isNotNull()).select(F.col("file_id").alias("id")).distinct()
    free = files.where(F.col("batch").isNotNull()).join(claimed, "id", "left_anti").select("id", "batch", "sha256")
    return items.where(F.col("file_id").isNull()).select("batch", "fid", "sha256").join(free, ["batch", "sha256"]).groupBy("batch", "fid").agg(F.min("id").alias("id"))


def sendable(files: DataFrame, probe: DataFrame, root: str = "") -> DataFrame:
    """(id, ok, why): files that are under the root and unchanged since they were indexed."""
    own = with_probe(files, probe)
    why = F.when(~F.col("p_exists"), "missing").when(~F.col("path").startswith(root), "outside").when(F.coalesce(F.col("p_size") != F.col("size"), F.lit(False)) | F.coalesce(F.col("p_sha") != F.col("sha256"), F.lit(False)), "changed")
    return own.select("id", why.isNull().alias("ok"), F.coalesce(why, F.lit("")).alias("why"))
