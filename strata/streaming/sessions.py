"""Upload sessions as keyed state: what a batch announced, what it has got, and when it was last active.

Events: batch, at, kind (open, upload, cancel), fid, files (the announced fids, with open), size and sha256 as declared,
got_size and got_sha256 as received. Every event is answered by a row (batch, fid, at, status):

open      -> expected, one row for each announced file; a batch without files opens nothing
upload    -> received, or refused (no such session or file), repeated (already received), rejected (size or hash differ)
cancel    -> cancelled, for every file still expected
silence   -> expired, for every file still expected, once the watermark is IDLE past the last event

A rejected file may be sent again. State goes with cancel and expiry, so later uploads are refused. Events without a time are left out,
and so are announced fids that are null.

Every file of a batch has an entry of its own in keyed state, so an event reads and writes one entry however many files
its batch announced; cancel and expiry read them all once. Of events that arrive together an entry is read and written once.
State lies in RocksDB, which ``serve`` asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE = timedelta(hours=1)
EVENTS = "batch string, at timestamp, kind string, fid string, files array<string>, size long, sha256 string, got_size long, got_sha256 string"
ANSWERS = "batch string, fid string, at timestamp, status string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Session:
    """A batch's session over ``files``: announced fids and whether they are received."""

    open: bool = False
    files: MutableMapping[str, bool] = field(default_factory=dict)

    def close(self) -> list[str]:
        left = sorted(f for f, done in self.files.items() if not done)
        self.files.clear()
        self.open = False
        return left

    def answer(self, kind: str, fid: str | None, files, same: bool) -> list[tuple[str | None, str]]:
        """(fid, status) rows for an event; ``same``: what was received is what was declared."""
        if kind == "open":
            new = sorted(f for f in set(files) if f is not None and f not in self.files) if files is not None else []
            self.files.update((f, False) for f in new)
            self.open = self.open or bool(new)
            return [(f, "expected") for f in new]
        if kind == "cancel":
            return [(f, "cancelled") for f in self.close()] if self.open else []
        done = self.files.get(fid) if self.open and fid is not None else None
        if done is None:
            return [(fid, "refused")]
        if done:
            return [(fid, "repeated")]
        if not same:
            return [(fid, "rejected")]
        self.files[fid] = True
        return [(fid, "received")]


class KeyedFiles(MutableMapping):
    """Map state (fid -> received) as a mapping."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, fid: str) -> bool:
        if not self.state.containsKey((fid,)):
            raise KeyError(fid)
        return self.state.getValue((fid,))[0]

    def __setitem__(self, fid: str, done: bool) -> None:
        self.state.updateValue((fid,), (done,))

    def __delitem__(self, fid: str) -> None:
        self.state.removeKey((fid,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def items(self):  # one pass in place of a question for each
        return ((k[0], v[0]) for k, v in self.state.iterator())

    def clear(self) -> None:
        self.state.clear()


class Held(MutableMapping):
    """A mapping's entries while a session's events are answered: each is asked once at most and written once; ``empty``: there is nothing to ask."""

    def __init__(self, kept: MutableMapping[str, bool], empty: bool):
        self.kept, self.empty, self.whole = kept, empty, empty
        self.known: dict[str, bool | None] = {}  # None: not there
        self.changed: dict[str, None] = {}
        self.wiped = False

    def __getitem__(self, fid: str) -> bool:
        if fid not in self.known and not self.whole:
            self.known[fid] = self.kept.get(fid)
        done = self.known.get(fid)
        if done is None:
            raise KeyError(fid)
        return done

    def __setitem__(self, fid: str, done: bool) -> None:
        self.known[fid] = done
        self.changed[fid] = None

    def __delitem__(self, fid: str) -> None:
        self[fid]
        self[fid] = None

    def items(self):
        if not self.whole:
            self.known, self.whole = dict(self.kept.items()) | self.known, True
        return ((f, done) for f, done in self.known.items() if done is not None)

    def __iter__(self):
        return (f for f, _ in self.items())

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def clear(self) -> None:
        self.known, self.changed, self.whole, self.wiped = {}, {}, True, not self.empty

    def flush(self) -> None:
        if self.wiped:
            self.kept.clear()
        for fid in self.changed:
            done = self.known[fid]
            if done is not None:
                self.kept[fid] = done
            elif not self.empty and not self.wiped and fid in self.kept:
                del self.kept[fid]


def _same(declared, got) -> bool:
    return pd.isna(declared) or (not pd.isna(got) and str(declared).lower() == str(got).lower())


def _size(x):
    return x if pd.isna(x) else int(x)


class SessionState(StatefulProcessor):
    """A batch's files in map state, and the time of its one timer, which exists while the session is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "fid string", "done boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _rows(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["batch", "fid", "at", "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer = self.timer.get()[0] if self.timer.exists() else None
        files = Held(KeyedFiles(self.files), timer is None)  # every question to the state is a round trip between worker and JVM
        held, out, last = Session(timer is not None, files), [], None
        for x in pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable").itertuples(index=False):
            fine = _same(_size(x.size), _size(x.got_size)) and _same(x.sha256, x.got_sha256)
            out += [(key[0], f, x.at, s) for f, s in held.answer(x.kind, x.fid, x.files, fine)]
            last = x.at
        files.flush()
        due = max(int((last + IDLE).timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1) if held.open else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(due)
                self.timer.update((due,))
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        left = Session(True, KeyedFiles(self.files)).close()
        self.timer.clear()
        yield from self._rows([(key[0], f, at, "expired") for f in left])

    def close(self) -> None:
        pass


def answers(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream of answers to a stream of events; events of a batch in one trigger are taken in the order of their times."""
    return events.where("at is not null").withWatermark("at", late).groupBy("batch").transformWithStateInPandas(SessionState(), ANSWERS, "Append", "eventTime")


def serve(events: DataFrame, target: str, checkpoint: str, late: str = "10 minutes"):
    """Answers appended to a folder named after the micro-batch, so that one run again replaces its own."""

    def commit(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/step={number}")

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what map state and timers need; a stream goes on with what it began with
    return answers(events, late).writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def item_states(answered: DataFrame) -> DataFrame:
    """(batch, fid, status) of every announced file, by its last answer that isn't a refusal or a repeat: what a restart goes on from."""
    rows = answered.where(~F.col("status").isin("refused", "repeated"))
    rank = F.when(F.col("status") == "expected", 0).when(F.col("status") == "rejected", 1).otherwise(2)
    last = rows.groupBy("batch", "fid").agg(F.max(F.struct("at", rank.alias("r"), "status")).alias("m"))
    return last.select("batch", "fid", F.col("m.status").alias("status"))


def replay_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived items as sessions: every batch opens, uploads its files, some of them twice, damaged or unannounced."""
    from strata.plans import fixtures as fx
    from strata.streaming.ingest import stream_dir

    where = stream_dir(spark)
    number = F.substring("fid", 2, 20).cast("long")
    own = fx.items(spark, sf_dir).withColumn("k", number)
    start = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("k") / 20) * 60)
    null = lambda kind: F.lit(None).cast(kind)
    opened = own.where("k % 5 <> 3").groupBy("batch", start.alias("at")).agg(F.sort_array(F.collect_list("fid")).alias("files"))
    opened = opened.select("batch", "at", F.lit("open").alias("kind"), null("string").alias("fid"), "files", null("long").alias("size"), null("string").alias("sha256"), null("long").alias("got_size"), null("string").alias("got_sha256"))
    at = (start.cast("long") + 1 + F.col("k") % 20).cast("timestamp")
    sent = own.select("batch", at.alias("at"), F.lit("upload").alias("kind"), "fid", null("array<string>").alias("files"), F.col("got_size").alias("size"), F.col("sha256"), "got_size", F.when(F.col("k") % 9 == 4, "damaged").otherwise(F.col("sha256")).alias("got_sha256"))
    again = sent.where("fid like '%7'").withColumn("at", F.expr("at + interval 30 seconds"))
    events = opened.unionByName(sent).unionByName(again)
    events.write.parquet(f"{where}/landing")
    stream = spark.readStream.schema(EVENTS).parquet(f"{where}/landing")
    serve(stream, f"{where}/out", f"{where}/checkpoint", "300 days").start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("batch", "fid", "status")


def replay_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived items as sessions that open 640 seconds after each other; every third file is never sent, and ten minutes of lateness let silent sessions expire."""
    from strata.plans import fixtures as fx
    from strata.streaming.ingest import stream_dir

    where = stream_dir(spark)
    k = F.substring("fid", 2, 20).cast("long")
    start = 1704067200 + F.floor(k / 20) * 640
    own = fx.items(spark, sf_dir).select("batch", "fid", k.alias("k"), start.alias("start"), "got_size", "sha256")
    opened = own.groupBy("batch", F.timestamp_seconds("start").alias("at")).agg(F.collect_list("fid").alias("files")).withColumn("kind", F.lit("open"))  # twenty at most
    sent = own.where("k % 3 <> 0").select("batch", F.timestamp_seconds(F.col("start") + 1 + F.col("k") % 20).alias("at"), F.lit("upload").alias("kind"), "fid", F.col("got_size").alias("size"), "sha256", "got_size", F.col("sha256").alias("got_sha256"))
    spark.createDataFrame([], EVENTS).unionByName(opened.unionByName(sent, allowMissingColumns=True), allowMissingColumns=True).write.parquet(f"{where}/landing")
    serve(spark.readStream.schema(EVENTS).parquet(f"{where}/landing"), f"{where}/out", f"{where}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("batch", "fid", "status")
