"""Changes to the index as functions from table to table; moves of files come out as a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.constants import DUPLICATE, OTHER, PLAIN, UNSORTED
from strata.operators.audit import verified
from strata.operators.rollups import reviewed_rows


@dataclass(frozen=True)
class Layout:
    """Names of the folders of a library."""

    sorted: str = "sorted"
    other: str = "other"
    removed: str = "removed"
    duplicates: str = "duplicates"
    date_subfolder: bool = True

    def folder(self, category: Column, taken: Column) -> Column:
        dated = F.coalesce(taken, F.lit("")) if self.date_subfolder else F.lit("")
        path = F.concat(F.lit(f"{self.sorted}/"), category)
        return F.when(category == OTHER, self.other).when(dated != "", F.concat(path, F.lit("/"), dated)).otherwise(path)


def _where(files: DataFrame, mine: Column, **changes) -> DataFrame:
    return files.withColumns({c: F.when(mine, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(files.schema[c].dataType) for c, v in changes.items()})


def next_id(files: DataFrame, last_id: int = 0) -> DataFrame:
    """One row: the id that the next file gets; never one used before."""
    return files.agg((F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(last_id)) + 1).alias("id"))


def set_category(files: DataFrame, ids: list[int], category: str, known: list[str]) -> DataFrame:
    """A user's choice for sorted files: it becomes an example, is no duplicate, and is certain."""
    if category not in known and category != UNSORTED:
        raise ValueError(f"no such category: {category}")
    mine = F.col("id").isin(ids) & (F.col("mode") == "sort") & ~F.col("removed")
    return _where(files, mine, category=category, corrected=True, duplicate_of=None, score=1.0)


def check(files: DataFrame, ids: list[int], value: bool = True) -> DataFrame:
    return _where(files, F.col("id").isin(ids), checked=value)


def confirm_batch(files: DataFrame, batch: str | None, value: bool = True, only: list[int] | None = None) -> DataFrame:
    """Marks all of a batch's rows, removed ones too; None is the legacy batch."""
    mine = F.col("batch").isNull() if batch is None else F.col("batch") == batch
    return _where(files, mine & F.col("id").isin(only) if only is not None and batch is not None else mine, reviewed=value)


def remove(files: DataFrame, ids: list[int], layout: Layout = Layout()) -> DataFrame:
    """Soft delete: the row stays, with the path that it came from."""
    return _removed(files, F.col("id").isin(ids) & ~F.col("removed"), layout)


def _removed(files: DataFrame, mine: Column, layout: Layout) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return _where(files, mine, prev_path=F.col("path"), path=F.concat(F.lit(f"{layout.removed}/"), name), removed=True)


def _promoted(files: DataFrame, originals: DataFrame, mine: Column, known: list[str], document: str, layout: Layout) -> DataFrame:
    """Duplicates become files of their own: they keep a valid category or take their original's, and an exact original's vector."""
    target = originals.select(F.col("id").alias("duplicate_of"), F.col("vec").alias("__tvec"), F.col("sha256").alias("__tsha"), F.col("category").alias("__tcat"))
    own = files.withColumn("__mine", mine & F.col("duplicate_of").isNotNull()).join(target, "duplicate_of", "left").select(*files.columns, "__mine", "__tvec", "__tsha", "__tcat")
    valid = lambda c: F.col(c).isin(*known, UNSORTED)
    fallback = F.when(F.col("kind") == "document", document).when(F.col("kind") == "other", OTHER).otherwise(UNSORTED)
    category = F.when(valid("category"), F.col("category")).when(valid("__tcat"), F.col("__tcat")).otherwise(fallback)
    vec = F.coalesce("vec", F.when(F.col("__tsha") == F.col("sha256"), F.col("__tvec")))
    own = _where(own, F.col("__mine"), category=category, vec=vec, checked=True)
    own = _where(own, F.col("__mine") & (F.col("mode") == "sort"), path=F.concat(layout.folder(F.col("category"), F.col("taken")), F.lit("/"), F.element_at(F.split("path", "/"), -1)))
    return _where(own, F.col("__mine"), duplicate_of=None).select(*files.columns)


def restore(files: DataFrame, ids: list[int], layout: Layout = Layout()) -> DataFrame:
    """Undo of remove: a link to a removed or missing original goes, and an exact duplicate without one is unsorted."""
    alive = files.where(~F.col("removed")).select(F.col("id").alias("duplicate_of"), F.lit(True).alias("__alive"))
    own = files.join(alive, "duplicate_of", "left").select(*files.columns, "__alive")
    mine = F.col("id").isin(ids) & F.col("removed")
    orphan = F.col("__alive").isNull()
    loose = orphan & (F.col("category") == DUPLICATE)
    name = F.element_at(F.split("path", "/"), -1)
    back = F.concat(F.regexp_replace(F.coalesce("prev_path", F.lit("")), r"[^/]*$", ""), name)
    out = own.withColumn("__loose", loose)
    out = _where(out, mine, path=F.when(F.col("__loose"), F.concat(layout.folder(F.lit(UNSORTED), F.col("taken")), F.lit("/"), name)).otherwise(back))
    out = _where(out, mine & F.col("__loose"), category=UNSORTED)
    out = _where(out, mine, duplicate_of=F.when(F.col("__alive"), F.col("duplicate_of")), prev_path=None)
    return _where(out, mine, removed=False).select(*files.columns)


def forget(files: DataFrame, segs: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows whose files are gone leave the index, with their segments and links to them."""
    left = files.where(~F.col("id").isin(ids))
    return _where(left, F.col("duplicate_of").isin(ids), duplicate_of=None), segs.where(~F.col("file_id").isin(ids))


def replace_segments(segs: DataFrame, new: DataFrame) -> DataFrame:
    """New segments take the place of all that their files had."""
    return segs.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new.select(*segs.columns))


def resolve_duplicates(files: DataFrame, keep: list[int], gone: list[int], known: list[str], document: str, layout: Layout = Layout()) -> DataFrame:
    """Of a group: ``gone`` is removed, ``keep`` become files of their own; other duplicates of removed files point to the first kept."""
    if not keep:
        raise ValueError("keep at least one file")
    if set(keep) & set(gone):
        raise ValueError("a file can't be both kept and removed")
    own = _promoted(remove(files, gone, layout), files, F.col("id").isin(keep), known, document, layout)
    if gone:
        own = _where(own, F.col("duplicate_of").isin(gone) & ~F.col("removed") & (F.col("id") != keep[0]), duplicate_of=keep[0])
    return own


def exact_plan(files: DataFrame, probe: DataFrame, batch: str) -> DataFrame:
    """(id, action) for a batch's exact duplicates: remove if the original verifies, else promote."""
    rows = reviewed_rows(files).where((F.col("bid") == batch) & F.col("exact")).select("id", F.col("duplicate_of").alias("o"), "sha256")
    good = verified(files, probe).select(F.col("id").alias("o"), F.col("sha256").alias("osha"))
    return rows.join(good, "o", "left").select("id", F.when(F.col("osha") == F.col("sha256"), "remove").otherwise("promote").alias("action"))


def clear_exact(files: DataFrame, probe: DataFrame, batch: str, known: list[str], document: str, layout: Layout = Layout()) -> DataFrame:
    """A batch's exact duplicates go where their original verifies; the others are the only copy and become files of their own."""
    todo = exact_plan(files, probe, batch).select("id", F.col("action").alias("__action"))
    own = files.join(todo, "id", "left").select(*files.columns, "__action")
    own = _removed(own, F.coalesce(F.col("__action") == "remove", F.lit(False)) & ~F.col("removed"), layout)
    return _promoted(own, files, F.coalesce(F.col("__action") == "promote", F.lit(False)), known, document, layout).select(*files.columns)


def rename_category(files: DataFrame, old: str, new: str) -> DataFrame:
    out = _where(files, F.col("category") == old, category=new)
    return _where(out, F.col("second") == old, second=new)


def delete_category(files: DataFrame, name: str) -> DataFrame:
    """Its files are unsorted again, with neither the user's marks nor a runner-up."""
    gone = F.col("second") == name
    out = _where(files, gone, second_score=None)
    out = _where(out, gone, second=None)
    mine = (F.col("category") == name) & (F.col("mode") == "sort")
    return _where(out, mine, category=UNSORTED, corrected=False, checked=False, second=None, second_score=None, reason=f"類別「{name}」已刪除")


def reclassify(files: DataFrame, results: DataFrame) -> DataFrame:
    """Results (id, category, confidence, reason, second, second_score) of the cascade; a changed category has to be checked again."""
    r = results.select("id", F.col("category").alias("__c"), F.col("confidence").alias("__s"), F.col("reason").alias("__r"), F.col("second").alias("__2"), F.col("second_score").alias("__2s"))
    own = files.join(r, "id", "left").select(*files.columns, "__c", "__s", "__r", "__2", "__2s")
    mine = F.col("__c").isNotNull() & ~F.col("corrected") & ~F.col("reviewed") & ~F.col("removed") & F.col("vec").isNotNull()
    own = own.withColumn("__mine", mine)
    own = _where(own, F.col("__mine") & ~F.col("category").eqNullSafe(F.col("__c")), checked=False)
    return _where(own, F.col("__mine"), category=F.col("__c"), score=F.col("__s"), reason=F.col("__r"), second=F.col("__2"), second_score=F.col("__2s")).select(*files.columns)


def retarget(files: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(id, src, dst) of files whose folder isn't their category's; removed, duplicate and plain files stay where they are."""
    own = files.where(~F.col("removed") & F.col("duplicate_of").isNull() & (F.col("mode") == "sort") & (F.col("category") != PLAIN))
    dst = F.concat(layout.folder(F.col("category"), F.col("taken")), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    return own.select("id", F.col("path").alias("src"), dst.alias("dst")).where("src <> dst")


def advance_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items after changes (batch, fid and any of status, file_id, error, path, sha256, got_size, dest): what a change leaves null stays."""
    columns = [c for c in changes.columns if c not in ("batch", "fid")]
    new = changes.select("batch", "fid", *(F.col(c).alias(f"__{c}") for c in columns))
    return items.join(new, ["batch", "fid"], "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in items.columns))
