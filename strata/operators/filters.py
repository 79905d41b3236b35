"""Facets, listings and work lists over the files table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.constants import DUPLICATE, PLAIN, SCREENS, SCREENSHOT_WORDS, REASON_SHOT_NAME, REASON_SHOT_SIZE


HINTED = 100_000  # ids


@dataclass(frozen=True)
class Filter:
    """Facets; an empty string is off. place is p1, p1|p2, or - for no place."""

    cat: str = ""
    kind: str = ""
    date_from: str = ""
    date_to: str = ""
    place: str = ""

    def __bool__(self) -> bool:
        return any((self.cat, self.kind, self.date_from, self.date_to, self.place))

    def column(self) -> Column:
        parts = [~F.col("removed")]
        if self.cat == DUPLICATE:
            parts.append(F.col("duplicate_of").isNotNull())
        elif self.cat == PLAIN:
            parts.append(F.col("mode") == "plain")
        elif self.cat:
            parts += [F.col("category") == self.cat, F.col("duplicate_of").isNull(), F.col("mode") == "sort"]
        if self.kind:
            parts.append(F.col("kind") == self.kind)
        if self.date_from:
            parts.append(F.col("taken") >= self.date_from[:7])
        if self.date_to:
            parts.append(F.col("taken") <= self.date_to[:7])
        if self.place == "-":
            parts.append(F.col("place1").isNull())
        elif self.place:
            first, _, second = self.place.partition("|")
            parts.append(F.col("place1") == first)
            if second:
                parts.append(F.col("place2") == second)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def live(files: DataFrame) -> DataFrame:
    return files.where(~F.col("removed"))


def newest_first(files: DataFrame, limit: int | None = None) -> DataFrame:
    out = files.orderBy(F.coalesce("taken", F.lit("")).desc(), F.col("id").desc())
    return out.limit(limit) if limit else out


def listing(files: DataFrame, chosen: Filter, limit: int = 300) -> DataFrame:
    return newest_first(files.where(chosen.column()), limit)


def multi_get(files: DataFrame, ids: list[int]) -> DataFrame:
    """Rows in the order of the request, repeats kept, unknown ids left out; column pos. A request of HINTED ids at most is broadcast."""
    wanted = files.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("pos", "id"))
    return files.join(F.broadcast(wanted) if len(ids) <= HINTED else wanted, "id").orderBy("pos")


def by_hash(files: DataFrame, sha256: str) -> DataFrame:
    return live(files).where(F.col("sha256") == sha256).orderBy("id").limit(1)


def has_path(files: DataFrame, path: str) -> DataFrame:
    """One row: whether a row of the index has the path."""
    return files.where(F.col("path") == path).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def get(files: DataFrame, file_id: int) -> DataFrame:
    return files.where(F.col("id") == file_id)


def recent(files: DataFrame, n: int = 50) -> DataFrame:
    return live(files).orderBy(F.desc("id")).limit(n)


def batch_files(files: DataFrame, batch: str | None) -> DataFrame:
    """Live files of a batch; None is the legacy batch."""
    mine = F.col("batch").isNull() if batch is None else F.col("batch") == batch
    return live(files).where(mine).orderBy("id")


def enrich_list(files: DataFrame, limit: int = 10, what: str = "text", documents_only: bool = False) -> DataFrame:
    """Files whose text, or with what = video whose segments, are still to be read."""
    kinds, done = (("video",), "seg_done") if what == "video" else (("document",) if documents_only else ("image", "document"), "ocr_done")
    todo = (F.col(done) == 0) & F.col("kind").isin(*kinds) & ((F.col("mode") == "sort") | F.col("vec").isNotNull())
    return live(files).where(todo).orderBy(F.desc("id")).limit(limit)


def unindexed_plain(files: DataFrame) -> DataFrame:
    return live(files).where((F.col("mode") == "plain") & F.col("vec").isNull())


def reclassifiable(files: DataFrame) -> DataFrame:
    return live(files).where((F.col("mode") == "sort") & F.col("vec").isNotNull() & ~F.col("corrected") & ~F.col("reviewed") & F.col("duplicate_of").isNull() & F.col("kind").isin("image", "video"))


def needs_place(files: DataFrame) -> DataFrame:
    return live(files).where(~F.coalesce("geo", F.lit(False)) | F.col("taken").isNull())


def stale(files: DataFrame, segs: DataFrame, dim: int) -> DataFrame:
    """Live files whose vector, or one of whose segments, has another length than dim."""
    odd = segs.where(F.size("vec") != dim).select(F.col("file_id").alias("id")).distinct()
    own = live(files)
    return own.where(F.col("vec").isNotNull() & (F.size("vec") != dim)).select("id").unionByName(own.join(odd, "id", "left_semi").select("id")).distinct()


def screenshot_reason(name: str, fmt: str, width: str, height: str, camera: str) -> Column:
    """Why an image counts as a screenshot; null if it doesn't. A camera's photo never does."""
    low = F.lower(F.col(name))
    word = F.lit(False)
    for w in SCREENSHOT_WORDS:
        word = word | low.contains(w)
    size = F.concat_ws("x", F.least(width, height), F.greatest(width, height)).isin(*(f"{a}x{b}" for a, b in SCREENS))
    return F.when(F.col(camera), None).when(word, REASON_SHOT_NAME).when(F.upper(F.col(fmt)).isin("PNG", "WEBP") & size, REASON_SHOT_SIZE)
