"""Shared helpers: scratch tables, Arrow columns as bytes, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session
    on one machine gets a folder of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


BYTES_AT_ONCE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts are at most BYTES_AT_ONCE together, or one row: what a worker
    holds several times over is bounded by bytes, however many rows Spark hands it."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > BYTES_AT_ONCE:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the machine: Python workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


ROWS_PER_BATCH = 1_000


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Texts are long: while a table is written, Python workers get fewer rows at once than a session's own setting hands them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= ROWS_PER_BATCH:
        spark.conf.set(name, ROWS_PER_BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Written tables that cut lineage and outlive lost executors.

    ``put`` writes a DataFrame to the shared folder and returns it reread;
    ``drop`` deletes a table that is no longer read. What is left goes when
    the driver's Python ends.
    """

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        Scratch.live.append(self)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with short_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strata_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._strata_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all other tables of this scratch."""
        kept = {t._strata_path for t in tables}
        for k in range(1, self.n + 1):
            if f"{self.root}/{k}" not in kept:
                delete_path(self.spark, f"{self.root}/{k}")

    def sweep(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of steps whose results are written and whose DataFrames are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session is already closed
            pass


def release(first: int) -> None:
    """Deletes what the operators called since ``first`` (an earlier length of Scratch.live) have written; nothing of it may still be read."""
    for own in Scratch.live[first:]:
        own._end()
    del Scratch.live[first:]


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary Arrow column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [b or b"" for b in column.to_pylist()]


def bounded_sample(rows: DataFrame, key: Column, most: int, by: Column | None = None, classes: tuple = (None,)) -> DataFrame:
    """At most so many rows with distinct keys: all of them, or those whose key's hash falls in a share of its range
    that the number of distinct keys sets. A group of equal keys counts once, however large it is.

    With ``by`` every class gets an equal part of ``most``. No task holds more than its own share.
    """
    held = rows.withColumn("__hash", F.xxhash64(key)).withColumn("__class", F.lit(None).cast("string") if by is None else by)
    counts = {r["__class"]: r["n"] for r in held.groupBy("__class").agg(F.approx_count_distinct("__hash", 0.02).alias("n")).collect()}  # a row per class
    quota, share = most // len(classes), F.lit(0)
    for c in classes:
        part = min(1.0, 0.9 * quota / max(1, counts.get(c, 0)))
        share = F.when(F.col("__class").eqNullSafe(F.lit(c)), F.lit(int(part * (1 << 40)))).otherwise(share)
    chosen = held.where(F.pmod("__hash", F.lit(1 << 40)) < share).dropDuplicates(["__class", "__hash"])  # about ``most``
    first = F.row_number().over(Window.partitionBy("__class").orderBy("__hash"))
    return chosen.withColumn("__first", first).where(F.col("__first") <= quota).drop("__hash", "__class", "__first")


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no hash, count as their JSON."""
    has_map = lambda kind: "map<" in kind.simpleString()
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema))


class Renamed:
    """A DataFrame whose columns are named c0, c1, ... so that any names of an operator's own are free.

    ``more`` are further columns by name, resolved on the original. ``back`` gives
    the original names again; columns named in ``give_way`` are left out.
    """

    def __init__(self, docs: DataFrame, **more: Column):
        self.names = docs.columns
        self.df = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.names)), *(c.alias(n) for n, c in more.items()))

    def __getitem__(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, give_way: tuple[str, ...] = ()) -> list[Column]:
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n not in give_way]


def worker_cache(name: str) -> dict:
    """A dict that lives in the Python worker process until an operator asks for another; one is held at a time."""
    held = sys.modules.setdefault("_strata_worker_cache", types.ModuleType("_strata_worker_cache")).__dict__.setdefault("held", {})
    for other in [n for n in held if n != name]:
        del held[other]
    return held.setdefault(name, {})


def with_text(batch: pa.RecordBatch, name: str, texts: list[bytes | None], n_chars: str = "n_chars") -> pa.RecordBatch:
    """The batch with its text column replaced, and n_chars counted anew where there is one."""
    names = batch.schema.names
    new = pa.array(texts, pa.binary()).cast(batch.schema.field(name).type)
    columns = [new if n == name else batch.column(n) for n in names]
    if n_chars in names and n_chars != name:
        kind = batch.schema.field(n_chars).type
        columns[names.index(n_chars)] = pa.array([None if t is None else len(t.decode("utf-8", "replace")) for t in texts], pa.int64()).cast(kind)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def null_mask(column: pa.Array) -> list[bool]:
    return column.is_null().to_pylist()
