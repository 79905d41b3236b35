"""Peers as keyed state: who has been heard lately.

Announcements: fingerprint, alias, at. Answers (fingerprint, alias, at, status): new when a peer is heard that wasn't there, renamed when its
alias changes, gone FORGET after it was last heard, when the watermark is past that or a later announcement shows it. What is said
doesn't depend on how announcements fall into triggers, as long as none is later than the lateness.

Defined results: an empty or null alias keeps the one before; announcements without a fingerprint or a time are left out; ties in time go by alias.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata.streaming.sessions import ROCKSDB

FORGET = timedelta(minutes=15)
ANSWERS = "fingerprint string, alias string, at timestamp, status string"
US = timedelta(microseconds=1)
EPOCH = pd.Timestamp(0)


def heard(peer: tuple[str, int] | None, alias: str | None, at: int, forget: int) -> tuple[tuple[str, int], list[tuple[str, int, str]]]:
    """(peer, answers) after an announcement; times in microseconds, peer is (alias, last heard)."""
    out = []
    if peer and at - peer[1] > forget:
        out.append((peer[0], peer[1] + forget, "gone"))
        peer = None
    name = alias or (peer[0] if peer else "")
    if not peer:
        out.append((name, at, "new"))
    elif name != peer[0]:
        out.append((name, at, "renamed"))
    return (name, max(at, peer[1]) if peer else at), out


class PeerState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.peer = handle.getValueState("peer", "alias string, heard long, due long")

    def _rows(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], a, EPOCH + t * US, s) for a, t, s in out], columns=["fingerprint", "alias", "at", "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.peer.get() if self.peer.exists() else None
        peer, forget, out = (known[0], known[1]) if known else None, FORGET // US, []
        for x in pd.concat(list(rows)).fillna({"alias": ""}).sort_values(["at", "alias"]).itertuples(index=False):
            peer, said = heard(peer, x.alias, (x.at - EPOCH) // US, forget)
            out += said
        due = max((peer[1] + forget) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        if known:
            self.handle.deleteTimer(known[2])
        self.handle.registerTimer(due)
        self.peer.update((*peer, due))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        alias, last, _ = self.peer.get()
        self.peer.clear()
        yield from self._rows(key, [(alias, last + FORGET // US, "gone")])

    def close(self) -> None:
        pass


def changes(announcements: DataFrame, late: str = "2 minutes") -> DataFrame:
    """The stream of answers to a stream of announcements."""
    own = announcements.where("fingerprint is not null and at is not null").withWatermark("at", late)
    return own.groupBy("fingerprint").transformWithStateInPandas(PeerState(), ANSWERS, "Append", "eventTime")


def watch(announcements: DataFrame, target: str, checkpoint: str, late: str = "2 minutes"):
    """Answers in a folder named after the micro-batch, so that one run again replaces its own."""

    def commit(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/step={number}")

    announcements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return changes(announcements, late).writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def present(answered: DataFrame) -> DataFrame:
    """(fingerprint, alias, at): peers that aren't gone, by their last answer."""
    rank = F.when(F.col("status") == "gone", 0).otherwise(1)
    last = answered.groupBy("fingerprint").agg(F.max(F.struct("at", rank.alias("r"), "alias", "status")).alias("m"))
    return last.where("m.status <> 'gone'").select("fingerprint", "m.alias", "m.at")


def replay_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as announcements of forty peers."""
    from strata.plans import fixtures as fx
    from strata.streaming.ingest import stream_dir

    where = stream_dir(spark)
    own = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("fingerprint"), F.lit("a").alias("alias"), F.col("ts").cast("timestamp").alias("at"))
    own.write.parquet(f"{where}/landing")
    watch(spark.readStream.schema(own.schema).parquet(f"{where}/landing"), f"{where}/out", f"{where}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("fingerprint", "status", F.col("at").cast("timestamp_ntz").alias("at"))
