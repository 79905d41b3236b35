"""The index as one object: tables of a snapshot, and a method for each question about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.vectors import has_dim, literal
from strata.operators import audit, dedupe, export, filters, ingest, mutate, recovery, rollups, search
from strata.operators.categories import Categories
from strata.operators.filters import Filter
from strata.sources.snapshots import Snapshots

TABLES = ("files", "segs", "batches", "items")


@dataclass
class Engine:
    files: DataFrame
    segs: DataFrame
    batches: DataFrame
    items: DataFrame
    dim: int = 256

    @classmethod
    def open(cls, spark: SparkSession, root: str, dim: int = 256) -> Engine:
        own = Snapshots(spark, root)
        return cls(*(own.load(t) for t in TABLES), dim=dim)

    def save(self, root: str, note: str = "") -> str:
        return Snapshots(self.files.sparkSession, root).commit({t: getattr(self, t) for t in TABLES}, note)

    def search(self, text: str = "", vector: list[float] | None = None, chosen: Filter = Filter(), k: int = 60, limit: int = 300) -> DataFrame:
        """vector is the query's embedding; without text and filter there is no result."""
        if not text and not chosen:
            return self.files.limit(0)
        return search.search(self.files, self.segs, text, literal(vector) if vector else None, self.dim, chosen, k, min(max(limit, 1), 5000))

    def similar(self, file_id: int, chosen: Filter = Filter(), k: int = 60) -> DataFrame:
        if not self.files.where((F.col("id") == file_id) & has_dim("vec", self.dim)).limit(1).count():
            raise ValueError(f"no file {file_id} with a vector of {self.dim} entries")
        return search.similar(self.files, self.segs, file_id, self.dim, chosen, k)

    def similar_to(self, vector: list[float], chosen: Filter = Filter(), k: int = 60) -> DataFrame:
        """Like an image that isn't in the index."""
        return search.ranked(self.files, self.segs, literal(vector), self.dim, chosen, k)

    def text(self, file_id: int) -> DataFrame:
        """One row: the text, whether it was read, and how many segments there are."""
        n = self.segs.where(F.col("file_id") == file_id).agg(F.count(F.lit(1)).alias("segs"))  # one row
        return self.files.where(F.col("id") == file_id).select("id", F.coalesce("ocr", F.lit("")).alias("text"), F.col("ocr_done").alias("done")).crossJoin(F.broadcast(n))

    def timeline(self, chosen: Filter = Filter(), per_month: int = 12) -> DataFrame:
        return rollups.timeline(self.files, chosen, per_month)

    def places(self) -> DataFrame:
        return rollups.places(self.files)

    def counts(self) -> DataFrame:
        return rollups.category_counts(self.files)

    def batch_list(self, view: str = "pending", category: str = "", limit: int = 30) -> DataFrame:
        return rollups.newest_batches(rollups.batch_list(self.files, self.batches, view, category), min(max(limit, 1), 500))

    def batch_check(self, probe: DataFrame) -> DataFrame:
        return audit.batch_checks(self.files, self.batches, self.items, probe)

    def duplicates(self) -> DataFrame:
        return dedupe.duplicate_groups(self.files)

    def removed(self) -> DataFrame:
        return self.files.where("removed").orderBy(F.desc("id"))

    def home(self) -> DataFrame:
        return rollups.home(self.files, self.batches, self.segs, self.dim)

    def recent(self, n: int = 50) -> DataFrame:
        return filters.recent(self.files, n)

    def export(self, ids: list[int], by: str = "") -> DataFrame:
        return export.plan(self.files, ids, by)

    def with_files(self, files: DataFrame) -> Engine:
        """The index after a change from ``mutate``."""
        return Engine(files, self.segs, self.batches, self.items, self.dim)

    def status(self) -> DataFrame:
        return rollups.status(self.files, self.items)

    def batch_page(self, view: str = "pending", category: str = "", limit: int = 30) -> DataFrame:
        """The newest batches with the number of all that the view has."""
        return rollups.batch_page(rollups.batch_list(self.files, self.batches, view, category), min(max(limit, 1), 500))

    def recovery(self, probe: DataFrame) -> DataFrame:
        return recovery.recovery_plan(self.items, self.files, self.batches, probe)

    def remove(self, ids: list[int]) -> Engine:
        return self.with_files(mutate.remove(self.files, ids))

    def restore(self, ids: list[int]) -> Engine:
        return self.with_files(mutate.restore(self.files, ids))

    def add(self, arrivals: DataFrame, probe: DataFrame, protos: DataFrame, categories: Categories, districts: DataFrame, cities: DataFrame, last_id: int = 0) -> Engine:
        """Arrivals sorted in, in the order in which they came."""
        return self.with_files(ingest.ingest(self.files, arrivals, probe, protos, categories.names, self.dim, districts, cities, categories.screenshot, categories.document, last_id=last_id))

    def set_category(self, ids: list[int], category: str, categories: Categories) -> Engine:
        return self.with_files(mutate.set_category(self.files, ids, category, categories.names))

    def check(self, ids: list[int], value: bool = True) -> Engine:
        return self.with_files(mutate.check(self.files, ids, value))

    def confirm_batch(self, batch: str | None, value: bool = True) -> Engine:
        return self.with_files(mutate.confirm_batch(self.files, batch, value))

    def resolve_duplicates(self, keep: list[int], gone: list[int], categories: Categories) -> Engine:
        return self.with_files(mutate.resolve_duplicates(self.files, keep, gone, categories.names, categories.document))

    def clear_exact(self, batch: str, probe: DataFrame, categories: Categories) -> Engine:
        return self.with_files(mutate.clear_exact(self.files, probe, batch, categories.names, categories.document))

    def rename_category(self, categories: Categories, old: str, new: str, descriptions: list[str]) -> tuple[Engine, Categories]:
        return self.with_files(mutate.rename_category(self.files, old, new)), categories.edit(old, new, descriptions)

    def delete_category(self, categories: Categories, name: str) -> tuple[Engine, Categories]:
        return self.with_files(mutate.delete_category(self.files, name)), categories.delete(name)
