"""Ingest as a stream: arrivals are checked once each and appended; roll-ups of events with a watermark.

Every micro-batch writes its accepted and its rejected arrivals to folders named
after the batch's number, so a batch that is run again after a failure replaces
its own files and nothing is lost or doubled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.shared import shared_dir


def stream_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def checked(arrivals: DataFrame) -> DataFrame:
    """Arrivals with why: a declared size or hash that the received bytes don't have."""
    size = F.coalesce(F.col("size") != F.col("got_size"), F.lit(False))
    sha = F.coalesce(F.lower("sha256") != F.lower("got_sha256"), F.lit(False))
    return arrivals.withColumn("why", F.when(size, "size").when(sha, "hash"))


def receive(arrivals: DataFrame, target: str, checkpoint: str, late: str = "1 hour"):
    """A stream of (batch, fid, at, size, got_size, sha256, got_sha256): each (batch, fid) is taken once within the lateness.

    Accepted rows go to target/accepted, others to target/rejected.
    """
    once = checked(arrivals).withWatermark("at", late).dropDuplicatesWithinWatermark(["batch", "fid"])

    def commit(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # both writes take it, and the once-only state is asked once
        try:
            rows.where("why is null").drop("why").write.mode("overwrite").parquet(f"{target}/accepted/step={number}")
            rows.where("why is not null").write.mode("overwrite").parquet(f"{target}/rejected/step={number}")
        finally:
            rows.unpersist()

    return once.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def replay_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the derived tables sent through the stream: those of every ninth file arrive damaged, all arrive twice."""
    from strata.plans import fixtures as fx

    where = stream_dir(spark)
    number = F.substring("fid", 2, 20).cast("long")
    own = fx.items(spark, sf_dir).select("batch", "fid", (F.timestamp_seconds(F.lit(1704067200) + number)).alias("at"), F.col("got_size").alias("size"), "got_size", "sha256", F.when(number % 9 == 4, F.lit("damaged")).otherwise(F.col("sha256")).alias("got_sha256"))
    own.unionByName(own).write.parquet(f"{where}/landing")
    stream = spark.readStream.schema(own.schema).parquet(f"{where}/landing")
    receive(stream, f"{where}/out", f"{where}/checkpoint", "3000 days").start().awaitTermination()
    return spark.read.parquet(f"{where}/out/accepted").select("batch", "fid", "sha256")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type, streamed from the events table and written when their hour is complete."""
    where = stream_dir(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{where}/landing")
    own = hourly(spark.readStream.schema(schema).parquet(f"{where}/landing"))

    def commit(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/out/step={number}")

    own.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("event_type", "hour").agg(F.max("n").alias("n"))
