"""Hybrid search: text hits, vector ranking with video segments, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import normalise, snippet
from strata.functions.vectors import dot, has_dim
from strata.operators.filters import Filter, live, newest_first
from strata.operators.neighbours import near_earlier
from strata.sources.shared import written


def result_row(score: Column, hit: str, t: Column) -> list[Column]:
    """What every search returns of a file."""
    plain = ["id", "name", "kind", "category", "mode", "duplicate_of", "taken", "place1", "place2", "reviewed"]
    return [*(F.col(c) for c in plain), F.bround("score", 3).alias("score"), F.round(score, 6).alias("sim"), t.alias("t"), F.lit(hit).alias("hit"), (F.coalesce(F.length("ocr"), F.lit(0)) > 0).alias("has_text")]


def text_hits(files: DataFrame, text: str, chosen: Filter = Filter(), limit: int = 200) -> DataFrame:
    """Files whose normalised text contains the normalised query (two characters at least), newest first."""
    wanted = normalise(text)[0]
    mine = chosen.column() & F.col("ocr_n").contains(wanted) if len(wanted) >= 2 else F.lit(False)
    return newest_first(files.where(mine), limit)


def with_snippets(hits: DataFrame, text: str, width: int = 40) -> DataFrame:
    return hits.withColumn("snip", snippet(text, width)("ocr"))


def best_segments(segs: DataFrame, query: Column, dim: int) -> DataFrame:
    """(id, seg_score, t): each file's best segment, the earliest of equals."""
    scored = segs.where(has_dim("vec", dim)).select(F.col("file_id").alias("id"), "t", dot(F.col("vec"), query).alias("s"))
    return scored.groupBy("id").agg(F.max(F.struct("s", (-F.col("t")).alias("n"))).alias("m")).select("id", F.col("m.s").alias("seg_score"), (-F.col("m.n")).alias("t"))


def ranked(files: DataFrame, segs: DataFrame, query: Column, dim: int, chosen: Filter = Filter(), k: int = 60, exclude: DataFrame | None = None) -> DataFrame:
    """The k live files most like the query vector; a video scores as its best segment where that is strictly better."""
    own = (files.where(chosen.column()) if chosen else live(files)).where(has_dim("vec", dim))
    if exclude is not None:
        own = own.join(exclude, "id", "left_anti")
    scored = own.withColumn("own_score", dot(F.col("vec"), query)).join(best_segments(segs, query, dim), "id", "left")
    better = F.coalesce(F.col("seg_score") > F.col("own_score"), F.lit(False)) & (F.col("kind") == "video")
    scored = scored.withColumn("sim", F.when(better, F.col("seg_score")).otherwise(F.col("own_score"))).withColumn("t", F.when(better, F.col("t")))
    return scored.orderBy(F.desc("sim"), "id").limit(k)


def search(files: DataFrame, segs: DataFrame, text: str, query: Column | None, dim: int, chosen: Filter = Filter(), k: int = 60, limit: int = 300) -> DataFrame:
    """Text hits, then the most similar of the others; without a text, the filtered listing. section and rank give the order."""
    if not text:
        out = newest_first(files.where(chosen.column()), limit).withColumn("section", F.lit(0))
        return _numbered(out.select("section", *result_row(F.lit(None).cast("double"), "list", F.lit(None).cast("double")), F.coalesce("taken", F.lit("")).alias("__a")), [F.desc("__a"), F.desc("id")])
    hits = written(text_hits(files, text, chosen))  # the scan of texts serves both sections; 200 rows at most
    first = _numbered(hits.select(F.lit(0).alias("section"), *result_row(F.lit(None).cast("double"), "text", F.lit(None).cast("double")), F.coalesce("taken", F.lit("")).alias("__a")), [F.desc("__a"), F.desc("id")])
    if query is None:
        return first
    like = ranked(files, segs, query, dim, chosen, k, hits.select("id"))
    second = _numbered(like.select(F.lit(1).alias("section"), *result_row(F.col("sim"), "like", F.col("t")), F.col("sim").alias("__a")), [F.desc("__a"), F.col("id")])
    return first.unionByName(second)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rank from 1 over a result that a limit bounds."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order))).drop("__a")


def similar(files: DataFrame, segs: DataFrame, file_id: int, dim: int, chosen: Filter = Filter(), k: int = 60) -> DataFrame:
    """The k files most like a file of the index; its vector is one row, checked by the id."""
    one = files.where((F.col("id") == file_id) & has_dim("vec", dim)).select(F.col("vec").alias("__q")).limit(1)
    exclude = files.sparkSession.range(1).select(F.lit(file_id).cast("long").alias("id"))
    return ranked(files.crossJoin(F.broadcast(one)), segs.crossJoin(F.broadcast(one)), F.col("__q"), dim, chosen, k, exclude).drop("__q")


def near_pairs(files: DataFrame, threshold: float, dim: int, most: int = 1) -> DataFrame:
    """(id, other, sim): for each live image, the ``most`` smaller ids most like it at the threshold or above (the smaller of equals first)."""
    return near_earlier(live(files).where((F.col("kind") == "image") & has_dim("vec", dim)), threshold, most)
