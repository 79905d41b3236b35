"""Counts, timeline, places, batches, doubts and the home page: one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.constants import DOUBT_CLOSE_RATIO, DOUBT_CONFIDENCE, DUPLICATE, LEGACY_BATCH, REASON_DOCUMENT, REASON_SHOT_NAME, REASON_SHOT_SIZE, UNKNOWN, UNSORTED
from strata.operators.filters import Filter, live
from strata.sources.shared import written


def category_counts(files: DataFrame) -> DataFrame:
    """Live files by category; duplicates have one of their own, null and empty are unknown."""
    name = F.when(F.col("duplicate_of").isNotNull(), DUPLICATE).otherwise(F.when(F.coalesce("category", F.lit("")) == "", UNKNOWN).otherwise(F.col("category")))
    return live(files).groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def totals(files: DataFrame) -> DataFrame:
    return live(files).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("used"))


def home_categories(files: DataFrame) -> DataFrame:
    return live(files).where(F.col("duplicate_of").isNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def covers(files: DataFrame, present: DataFrame | None = None, candidates: int = 12, shown: int = 4) -> DataFrame:
    """(category, pos, id): of each category's first candidates, images before videos and newest first, those present, at most ``shown``."""
    first = Window.partitionBy("category").orderBy((F.col("kind") == "image").desc(), F.col("id").desc())
    own = live(files).where(F.col("duplicate_of").isNull() & F.col("kind").isin("image", "video"))
    top = own.withColumn("r", F.row_number().over(first)).where(F.col("r") <= candidates).select("category", "id", "r")
    if present is not None:
        top = top.join(present.select("id"), "id", "left_semi")
    return top.withColumn("pos", F.row_number().over(Window.partitionBy("category").orderBy("r"))).where(F.col("pos") <= shown).select("category", "pos", "id")


def last_batch(files: DataFrame, batches: DataFrame) -> DataFrame:
    """The newest batch with a live file: totals by kind and its first six images and videos."""
    known = batches.join(live(files).select(F.col("batch").alias("bid")), F.col("id") == F.col("bid"), "left_semi")
    newest = known.orderBy(F.desc("started_at"), "id").limit(1).select(F.col("id").alias("batch"), "started_at")
    own = live(files).join(F.broadcast(newest), "batch")
    seen = F.col("kind").isin("image", "video")
    totals = own.groupBy("batch", "started_at").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(~seen).alias("others"))
    first = own.where(seen).select("id").orderBy("id").limit(6).agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("thumbs"))  # one row of six
    return totals.crossJoin(F.broadcast(first))


def places(files: DataFrame) -> DataFrame:
    """(p1, total, p2, n): second-level places under the first with the first's total, which counts files without a second too."""
    own = live(files).where(F.col("place1").isNotNull()).groupBy(F.col("place1").alias("p1"), F.col("place2").alias("p2")).agg(F.count(F.lit(1)).alias("n"))
    whole = own.groupBy("p1").agg(F.sum("n").alias("total"))
    return own.join(whole, "p1").where(F.coalesce("p2", F.lit("")) != "").select("p1", "total", "p2", "n")


def without_place(files: DataFrame) -> DataFrame:
    return live(files).agg(F.count_if(F.col("place1").isNull() & F.col("geo") & F.col("kind").isin("image", "video")).alias("none"))


def month_counts(files: DataFrame, chosen: Filter = Filter()) -> DataFrame:
    return files.where(chosen.column()).groupBy(F.coalesce("taken", F.lit("")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def month_files(files: DataFrame, chosen: Filter = Filter(), per_month: int = 12) -> DataFrame:
    """(month, pos, id): the newest of each month; the empty month lists only files without one."""
    w = Window.partitionBy("month").orderBy(F.desc("id"))
    own = files.where(chosen.column() & (F.col("taken").isNull() | (F.col("taken") != ""))).select(F.coalesce("taken", F.lit("")).alias("month"), "id")
    return own.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_month)


def month_places(files: DataFrame, chosen: Filter = Filter(), most: int = 3) -> DataFrame:
    """(month, pos, place, n): the commonest places of each month, ties by name."""
    own = files.where(chosen.column() & F.col("place1").isNotNull()).groupBy(F.coalesce("taken", F.lit("")).alias("month"), F.coalesce("place2", "place1").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("n"), "place"))).where(F.col("pos") <= most)


def timeline(files: DataFrame, chosen: Filter = Filter(), per_month: int = 12) -> DataFrame:
    """(month, n, files, places): counts, newest ids and commonest places by month."""
    ids = month_files(files, chosen, per_month).groupBy("month").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"].cast("string"))).alias("files"))
    top = month_places(files, chosen).groupBy("month").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "place"))), lambda s: s["place"])).alias("places"))
    return month_counts(files, chosen).join(ids, "month", "left").join(top, "month", "left").select("month", "n", F.coalesce("files", F.lit("")).alias("files"), F.coalesce("places", F.lit("")).alias("places"))


def doubt(target_name: Column | None = None) -> Column:
    """Why a file should be looked at: dup_of, unsure, either or low with what it is about; null if there is no doubt."""
    unsure = F.coalesce("reason", F.lit("unsure"))
    close = (F.coalesce("second", F.lit("")) != "") & F.col("second_score").isNotNull() & (F.col("score") > 0) & (F.col("second_score") >= DOUBT_CLOSE_RATIO * F.col("score"))
    duplicate = F.lit("dup") if target_name is None else F.when(target_name.isNotNull(), F.concat(F.lit("dup_of:"), target_name)).otherwise("dup")
    return (
        F.when((F.col("mode") != "sort") | F.col("corrected") | F.col("checked"), None)
        .when(F.col("duplicate_of").isNotNull() & (F.col("duplicate_of") != 0), duplicate)
        .when(F.col("category") == UNSORTED, unsure)
        .when(F.col("score").isNull() | F.coalesce(F.col("reason").isin(REASON_SHOT_SIZE, REASON_SHOT_NAME, REASON_DOCUMENT), F.lit(False)), None)
        .when(close, F.concat(F.lit("either:"), "category", F.lit("|"), "second"))
        .when(F.col("score") < DOUBT_CONFIDENCE, F.concat(F.lit("low:"), F.bround(F.col("score") * 100).cast("int").cast("string")))
    )


def reviewed_rows(files: DataFrame) -> DataFrame:
    """Live files with bid, exact and doubt as a review list shows them; targets may have been removed."""
    target = files.select(F.col("id").alias("duplicate_of"), F.col("name").alias("target_name"), F.col("sha256").alias("target_sha"))
    own = live(files).join(target, "duplicate_of", "left")
    exact = F.coalesce((F.col("target_sha") != "") & (F.col("target_sha") == F.col("sha256")), F.lit(False))
    own = own.withColumn("exact", exact).withColumn("d", doubt(F.col("target_name")))
    known = F.when(F.col("d").isNotNull() & F.col("target_name").isNotNull(), F.concat(F.when(F.col("exact"), "exact:").otherwise("similar:"), "target_name")).otherwise(F.col("d"))
    return own.withColumn("doubt", F.when(~F.col("reviewed"), known)).withColumn("bid", F.coalesce("batch", F.lit(LEGACY_BATCH)))


def batch_list(files: DataFrame, batches: DataFrame, view: str = "pending", category: str = "") -> DataFrame:
    """Batches by review state. total and reviewed count all live files of the batch; n, doubts and exact_dups those that the view and category leave."""
    rows = reviewed_rows(files)
    whole = rows.groupBy("bid").agg(F.count(F.lit(1)).alias("total"), F.count_if("reviewed").alias("reviewed"))
    if view == "pending":
        whole, rows = whole.where("reviewed < total"), rows.where(~F.col("reviewed"))
    elif view == "reviewed":
        whole = whole.where("reviewed = total")
    if category == DUPLICATE:
        rows = rows.where(F.col("duplicate_of").isNotNull() | (F.col("category") == DUPLICATE))
    elif category:
        rows = rows.where((F.col("category") == category) & F.col("duplicate_of").isNull())
    left = rows.groupBy("bid").agg(F.count(F.lit(1)).alias("n"), F.count("doubt").alias("doubts"), F.count_if("exact").alias("exact_dups"), F.min(F.coalesce("received_at", F.lit(0.0))).alias("first"))
    info = batches.select(F.col("id").alias("bid"), "started_at", "sender", "count")
    out = whole.join(left, "bid").join(info, "bid", "left")
    return out.select("bid", F.coalesce("started_at", "first").alias("started_at"), "total", "reviewed", "n", "doubts", "exact_dups", F.col("count").alias("expected"))


def newest_batches(listed: DataFrame, limit: int = 30) -> DataFrame:
    return listed.orderBy(F.desc("started_at"), "bid").limit(limit)


def batch_page(listed: DataFrame, limit: int = 30) -> DataFrame:
    """The newest batches, each with the number of all that the list has."""
    listed = written(listed)  # a row per batch, for the page and the count
    return newest_batches(listed, limit).crossJoin(F.broadcast(listed.agg(F.count(F.lit(1)).alias("batches"))))  # one row


def status(files: DataFrame, items: DataFrame) -> DataFrame:
    """One row: counts by category, removed files, pending items, what is left to read."""
    counts = category_counts(files).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("counts"))  # a user's categories
    out = counts.crossJoin(files.agg(F.count_if("removed").alias("removed"))).crossJoin(items.agg(F.count_if(F.col("status").isin("expected", "received")).alias("pending")))
    return out.crossJoin(enrich_left(files).select(F.col("texts").alias("texts_left"), F.col("videos").alias("videos_left")))  # one row each


def enrich_left(files: DataFrame, documents_only: bool = False) -> DataFrame:
    has = (F.col("mode") == "sort") | F.col("vec").isNotNull()
    text = (F.col("kind") == "document") if documents_only else F.col("kind").isin("image", "document")
    return live(files).agg(F.count_if((F.col("ocr_done") == 0) & text & has).alias("texts"), F.count_if((F.col("seg_done") == 0) & (F.col("kind") == "video") & has).alias("videos"))


def stale_counts(files: DataFrame, segs: DataFrame, dim: int) -> DataFrame:
    a = files.agg(F.count_if(F.col("vec").isNotNull() & (F.size("vec") != dim)).alias("files"))
    b = segs.where(F.size("vec") != dim).agg(F.countDistinct("file_id").alias("videos"))
    return a.crossJoin(b)  # one row each


def modal_dim(files: DataFrame) -> DataFrame:
    """The most common vector length, the smallest of equals."""
    n = files.where(F.col("vec").isNotNull()).groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "dim").limit(1)


def segment_counts(segs: DataFrame) -> DataFrame:
    return segs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def home(files: DataFrame, batches: DataFrame, segs: DataFrame, dim: int) -> DataFrame:
    """One row of figures for the start page."""
    from strata.operators.dedupe import duplicate_roots

    pending = batch_list(files, batches, "pending").agg(F.count(F.lit(1)).alias("pending_batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("pending_files"), F.coalesce(F.sum("doubts"), F.lit(0)).alias("doubts"))
    groups = duplicate_roots(files).agg(F.countDistinct("root").alias("dup_groups"))
    gone = files.agg(F.count_if("removed").alias("removed"))
    out = totals(files)
    for part in (pending, groups, gone, stale_counts(files, segs, dim).select(F.col("files").alias("stale_files"), F.col("videos").alias("stale_videos"))):
        out = out.crossJoin(part)  # one row each
    return out
