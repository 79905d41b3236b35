"""Ingest: arrivals become rows of the index, in the order in which they came.

Every file sees the rows before it, those of the same run included: ids follow the
order of arrival, and exact and near duplicates are looked up among smaller ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.constants import DUPLICATE, NEAR_DUPLICATE, OTHER, PLAIN, REASON_DOCUMENT, REASON_UNKNOWN_TYPE
from strata.functions.text import kind_of, norm
from strata.operators import audit, classify, dedupe, geo
from strata.operators.filters import live
from strata.operators.mutate import Layout, next_id
from strata.operators.neighbours import near_earlier
from strata.sources.shared import written

CANDIDATES = 20  # of the most similar files, the first that exists counts


def numbered(rows: DataFrame, order: str, first: int) -> DataFrame:
    """rows with id, gapless from ``first`` in the given order: ranges are counted, and each row adds its range's start."""
    sorted_ = written(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()))
    counts = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    starts = counts.withColumn("__start", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return sorted_.join(F.broadcast(starts), "__part").withColumn("id", (F.lit(first) - 1 + F.col("__start") + own).cast("long")).drop("__part", "__start")


def exact_originals(new: DataFrame, files: DataFrame, probe: DataFrame) -> DataFrame:
    """(id, original, original_name): the first earlier file with the same hash, an arrival or one that is verified on disk."""
    known = audit.verified(files, probe).select("id", "sha256").unionByName(new.select("id", "sha256")).where(F.coalesce("sha256", F.lit("")) != "")
    first = known.groupBy("sha256").agg(F.min("id").alias("original"))
    found = new.select("id", "sha256").join(first, "sha256").where("original < id")
    names = files.select(F.col("id").alias("original"), F.col("name").alias("original_name")).unionByName(new.select(F.col("id").alias("original"), F.col("name").alias("original_name")))
    return found.join(names, "original").select("id", "original", "original_name")


def near_originals(new: DataFrame, files: DataFrame, probe: DataFrame, dim: int, first: int, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """(id, other, sim) for arrivals that are images: of the most similar earlier images, the first whose file exists."""
    image = (F.col("kind") == "image") & F.col("vec").isNotNull() & (F.size("vec") == dim)
    rows = live(files).where(image).select("id", "vec").unionByName(new.where(image).select("id", "vec"))
    pairs = near_earlier(rows, threshold, CANDIDATES, since=first)
    here = audit.with_probe(live(files).select("id", "path"), probe).where("p_exists").select("id").unionByName(new.select("id"))
    return dedupe.first_near(pairs, here, threshold, CANDIDATES)


def ingest(
    files: DataFrame, arrivals: DataFrame, probe: DataFrame, protos: DataFrame, names: list[str], dim: int, districts: DataFrame, cities: DataFrame,
    screenshot: str = "", document: str = "", layout: Layout = Layout(), last_id: int = 0, near: float = NEAR_DUPLICATE, vote: float | None = None,
) -> DataFrame:
    """files with the arrivals appended.

    arrivals: seq (the order), name, path, size, sha256, taken, lat, lon, vec, ocr, camera, shot, mode, batch, received_at. Plain ones
    are registered as they are. Others are exact duplicates of an earlier file, or are classified (documents by
    kind, what has no vector as other), and may be near duplicates, which keep their category. path becomes the
    folder where the file belongs and its name; the move itself is the caller's.
    """
    # what the steps ask of the index is computed once, and so are the arrivals without their texts
    known = written(files.select("id", "name", "path", "kind", "category", "sha256", "size", "corrected", "removed", "vec"))
    probe = written(probe.select("path", "exists", "size", "opens", "sha256"))
    first = next_id(known, last_id).first().id
    new = written(numbered(arrivals, "seq", first).withColumn("kind", kind_of(F.col("name"))))
    judgeable = F.col("vec").isNotNull() & (F.col("kind") != "document")
    slim = written(new.withColumn("text_len", F.when((F.col("mode") == "sort") & judgeable, F.length(norm(F.coalesce("ocr", F.lit("")))))).drop("ocr"))
    own = slim.where("mode = 'sort'")
    exact = written(exact_originals(slim, known, probe).join(own.select("id"), "id", "left_semi"))
    rest = written(own.join(exact, "id", "left_anti"))
    judged = classify.cascade(rest.where(judgeable), known, protos, names, dim, screenshot, document, vote)
    alike = near_originals(rest, known, probe, dim, first, near).select("id", F.col("other").alias("near"))
    placed = geo.place_of(slim.where("lat is not null and lon is not null").select("id", "lat", "lon"), districts, cities)
    fresh = new.join(exact, "id", "left").join(judged.withColumnsRenamed({"category": "j_category", "reason": "j_reason", "confidence": "j_score", "second": "j_second", "second_score": "j_second_score"}), "id", "left")
    fresh = fresh.join(alike, "id", "left").join(placed, "id", "left")

    plain, same = F.col("mode") == "plain", F.col("original").isNotNull()
    paper, blank = F.col("kind") == "document", F.col("vec").isNull()

    def by_case(other: Column, for_plain=None, for_same=None, for_paper=None, for_blank=None) -> Column:
        return F.when(plain, for_plain).when(same, for_same).when(paper, for_paper).when(blank, for_blank).otherwise(other)

    category = by_case(F.col("j_category"), PLAIN, DUPLICATE, document, OTHER)
    link = F.when(~plain, F.coalesce("original", "near"))
    folder = F.when(link.isNotNull(), layout.duplicates).otherwise(layout.folder(category, F.col("taken")))
    bare = plain | same  # no vector and no text is read of these
    rows = fresh.select(
        "id", "name", F.when(plain, F.col("path")).otherwise(F.concat(folder, F.lit("/"), F.col("name"))).alias("path"), "kind", "mode", category.alias("category"), by_case(F.col("j_score")).alias("score"),
        by_case(F.col("j_reason"), None, F.concat(F.lit("與 "), "original_name", F.lit(" 完全相同")), REASON_DOCUMENT, REASON_UNKNOWN_TYPE).alias("reason"), by_case(F.col("j_second")).alias("second"),
        by_case(F.col("j_second_score")).alias("second_score"), "sha256", "size", link.alias("duplicate_of"), "batch", "taken", "received_at", *(F.lit(False).alias(c) for c in ("reviewed", "corrected", "checked", "removed")),
        "place1", "place2", (F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("geo"), F.when(~bare, F.col("vec")).alias("vec"), F.when(~bare, F.col("ocr")).alias("ocr"), F.when(~bare, norm("ocr")).alias("ocr_n"),
        F.when(~bare & F.col("ocr").isNotNull(), 1).otherwise(0).alias("ocr_done"), F.lit(0).alias("seg_done"),
    )
    return files.unionByName(rows.select(*(F.col(c).cast(files.schema[c].dataType) for c in rows.columns if c in files.columns)), allowMissingColumns=True)


def enriched(files: DataFrame, attempts: DataFrame, results: DataFrame, most: int = 2, run: int = 3) -> tuple[DataFrame, DataFrame, bool]:
    """(files, attempts, pause) after a round of background reading.

    results: pos (the order of reading), id, ocr (null if it failed), failed, missing. A file that is missing, or has
    failed ``most`` times over all rounds (attempts: id, n), is given up (ocr_done 2); ``run`` failures one after
    another of files that are there pause the work. A round has some dozens of rows.
    """
    r = results.select("id", F.col("ocr").alias("__ocr"), "failed", "missing")
    tries = attempts.join(results.where("failed").select("id", F.lit(1).alias("__more")), "id", "full").select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("__more", F.lit(0))).alias("n"))
    own = files.join(r.join(tries, "id", "left"), "id", "left")
    give_up = F.col("failed") & (F.col("missing") | (F.col("n") >= most))
    read = F.coalesce(~F.col("failed"), F.lit(False))
    changed = {"ocr": F.when(read, F.col("__ocr")).otherwise(F.col("ocr")), "ocr_n": F.when(read, norm("__ocr")).otherwise(F.col("ocr_n")), "ocr_done": F.when(read, 1).when(F.coalesce(give_up, F.lit(False)), 2).otherwise(F.col("ocr_done")).cast("int")}
    pause, streak = False, 0
    for x in results.orderBy("pos").select("failed", "missing").collect():  # a round
        streak = streak + 1 if x.failed and not x.missing else streak if x.failed else 0
        pause |= streak >= run
    return own.withColumns(changed).select(*files.columns), tries.where("n > 0"), pause


def located(files: DataFrame, found: DataFrame) -> DataFrame:
    """Back-fill of what a second look at the files found (id, taken, place1, place2, geo): only what is missing is filled."""
    f = found.select("id", *(F.col(c).alias(f"__{c}") for c in ("taken", "place1", "place2", "geo")))
    own = files.join(f, "id", "left")
    asked = ~F.coalesce("geo", F.lit(False))
    fill = {c: F.when(asked, F.coalesce(c, f"__{c}")).otherwise(F.col(c)) for c in ("place1", "place2")}
    return own.withColumns(fill | {"taken": F.coalesce("taken", "__taken"), "geo": F.coalesce("geo", F.lit(False)) | F.coalesce("__geo", F.lit(False))}).select(*files.columns)


def reindexed(files: DataFrame, segs: DataFrame, vectors: DataFrame, new_segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, segs) with recomputed vectors (id, vec) and segments (file_id, t, vec)."""
    from strata.operators.mutate import replace_segments

    own = files.join(vectors.select("id", F.col("vec").alias("__vec")), "id", "left")
    done = new_segs.select(F.col("file_id").alias("id"), F.lit(1).alias("__done")).distinct()
    own = own.join(done, "id", "left").withColumns({"vec": F.coalesce("__vec", "vec"), "seg_done": F.coalesce("__done", "seg_done")})
    return own.select(*files.columns), replace_segments(segs, new_segs)
