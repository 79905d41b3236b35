"""After a stop: what to do with each item that was received but never indexed, and which peers are still there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.audit import registered

PEER_SECONDS = 15 * 60


def recovery_plan(items: DataFrame, files: DataFrame, batches: DataFrame, probe: DataFrame) -> DataFrame:
    """(batch, fid, action, file_id, src) for items that were received or failed in processing.

    close: a row of the batch is the item already (its path or destination, else an unclaimed row with its hash). requeue,
    or register in a plain batch: the received file is there with its hash. move_back: it lies at its destination, not
    indexed yet. error: something else lies there, or a destination is known and empty. wait: there is nothing to go by.
    items: batch, fid, status, path, dest, sha256; probe as in audit.
    """
    todo = items.where(F.col("status").isin("received", "error")).select("batch", "fid", "path", "dest", F.col("sha256").alias("want"))
    known = files.where(F.col("batch").isNotNull()).select("batch", F.col("path").alias("at"), F.col("id").alias("by_path"), F.col("sha256").alias("has"))
    places = todo.select("batch", "fid", "want", F.explode(F.array("path", "dest")).alias("at")).where("at is not null")
    fits = F.col("want").isNull() | F.coalesce(F.col("want") == F.col("has"), F.lit(False))
    by_path = places.join(known, ["batch", "at"]).where(fits).groupBy("batch", "fid").agg(F.min("by_path").alias("by_path"))
    by_hash = registered(items.where(F.col("sha256").isNotNull()), files).withColumnRenamed("id", "by_hash")
    out = todo.join(by_path, ["batch", "fid"], "left").join(by_hash, ["batch", "fid"], "left").withColumn("file_id", F.coalesce("by_path", "by_hash"))
    for name in ("path", "dest"):
        seen = probe.select(F.col("path").alias(name), F.col("exists").alias(f"{name}_there"), F.col("sha256").alias(f"{name}_sha"))
        out = out.join(seen, name, "left")
    there = lambda n: F.coalesce(f"{n}_there", F.lit(False))
    right = lambda n: there(n) & (F.col("want").isNull() | F.coalesce(F.col("want") == F.col(f"{n}_sha"), F.lit(False)))
    modes = batches.select(F.col("id").alias("batch"), F.col("mode").alias("batch_mode"))
    action = (
        F.when(F.col("file_id").isNotNull(), "close").when(right("path"), F.when(F.col("batch_mode") == "plain", "register").otherwise("requeue"))
        .when(right("dest"), "move_back").when(there("path") | F.col("dest").isNotNull(), "error").otherwise("wait")
    )
    out = out.join(modes, "batch", "left").withColumn("action", action)
    return out.select("batch", "fid", "action", F.when(F.col("action") == "close", F.col("file_id")).alias("file_id"), F.when(F.col("action") == "move_back", F.col("dest")).when(F.col("action").isin("requeue", "register"), F.col("path")).alias("src"))


def live_peers(announced: DataFrame, now, own: tuple[str, ...] = (), seconds: int = PEER_SECONDS) -> DataFrame:
    """(fingerprint, alias, model, seen, ago) of the devices heard within the time: the latest announcement, with earlier names where it has none.

    announced: fingerprint, alias, model, at (a timestamp); now is a timestamp literal or column.
    """
    named = announced.where((F.coalesce("fingerprint", F.lit("")) != "") & ~F.col("fingerprint").isin(*own) if own else F.coalesce("fingerprint", F.lit("")) != "")
    last = lambda c: F.max(F.when(F.coalesce(c, F.lit("")) != "", F.struct("at", F.col(c).alias("v"))))["v"]
    held = named.groupBy("fingerprint").agg(last("alias").alias("alias"), last("model").alias("model"), F.max("at").alias("seen"))
    ago = (F.unix_timestamp(F.lit(now) if not hasattr(now, "alias") else now) - F.unix_timestamp("seen")).cast("int")
    return held.withColumn("ago", ago).where(F.col("ago") <= seconds).orderBy(F.desc("seen"), "fingerprint")
