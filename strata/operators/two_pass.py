"""Ranking in two passes: codes of one byte a coordinate discard, whole vectors decide.

A code is a vector over its scale, rounded; what rounding left over has a length that is kept with it, so a product with any
query lies within that length times the query's. The k-th greatest lower bound is a score that k files reach; what can't reach it
is discarded, and ``search.ranked`` runs over the rest. Results are those of ``search.ranked`` over all.

Defined results: a vector with a null or non-finite coordinate has no code and is always asked whole; vectors of another length take
no part; with fewer than k files all are asked; ties at the k-th place are all asked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.vectors import literal
from strata.operators.filters import Filter, live
from strata.operators.narrow import narrowed
from strata.operators.search import ranked
from strata.sources.shared import written

CODE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("err", T.DoubleType())])
INF = float("inf")


@F.pandas_udf(CODE)
def code_of(vectors: pd.Series) -> pd.DataFrame:
    """dim, and for finite vectors the code, its scale, and the length of what it leaves out (null vectors: all null)."""
    out = pd.DataFrame({"dim": vectors.map(lambda v: None if v is None else len(v)).astype("Int32"), "code": None, "scale": np.nan, "err": np.nan}, index=vectors.index).astype({"code": object})
    for dim, rows in out.groupby("dim").groups.items():
        m = np.array([np.asarray(v, dtype=np.float64) for v in vectors.loc[rows]]).reshape(len(rows), int(dim))
        fine = np.isfinite(m).all(axis=1)
        m[~fine] = 0.0
        scale = np.abs(m).max(axis=1, initial=0.0) / 127
        scale[scale < 1e-300] = 1.0
        codes = np.rint(m / scale[:, None]).astype(np.int8)
        err = np.sqrt(((m - codes * scale[:, None]) ** 2).sum(axis=1))
        out.loc[rows, "code"] = pd.Series([c.tobytes() if f else None for c, f in zip(codes, fine)], index=rows, dtype=object)
        out.loc[rows, "scale"], out.loc[rows, "err"] = scale, err
    return out


def with_codes(table: DataFrame, name: str = "code") -> DataFrame:
    """table with its vectors' codes: a column to be kept in the table and made again where vec changes."""
    return table.withColumn(name, code_of("vec"))


def bounds(code: str, vector: list[float]) -> Column:
    """(low, high) of the product of each coded vector with the vector asked for."""
    q = np.asarray(vector, dtype=np.float64)

    @F.pandas_udf("struct<low:double,high:double>")
    def run(codes: pd.DataFrame) -> pd.DataFrame:
        known = codes["code"].notna().to_numpy()
        low, high = np.full(len(codes), -INF), np.full(len(codes), INF)
        if known.any():
            own = codes[known]
            c = np.frombuffer(b"".join(own["code"]), dtype=np.int8).reshape(len(own), len(q))
            scale, err = own["scale"].to_numpy(float), own["err"].to_numpy(float)
            with np.errstate(all="ignore"):
                mid = scale * (c @ q)
                slack = err * np.linalg.norm(q) * (1 + 1e-9) + 1e-12 * 128 * scale * np.abs(q).sum()  # rounding in doubles lies far below
                a, b = mid - slack, mid + slack
            low[known], high[known] = np.where(np.isfinite(a), a, -INF), np.where(np.isfinite(b), b, INF)
        return pd.DataFrame({"low": low, "high": high})

    return run(F.col(code))


def candidates(files: DataFrame, segs: DataFrame, vector: list[float], chosen: Filter = Filter(), k: int = 60, exclude: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(id) of all files that may be among the k best, and the score that those have at least; files and segs have codes, and no vector is read."""
    mine = F.col("code.dim") == len(vector)
    own = (files.where(chosen.column()) if chosen else live(files)).where(mine).select("id", "kind", bounds("code", vector).alias("b"))
    if exclude is not None:
        own = own.join(exclude, "id", "left_anti")
    parts = segs.where(mine).select(F.col("file_id").alias("id"), bounds("code", vector).alias("s")).groupBy("id").agg(F.max("s.low").alias("s_low"), F.max("s.high").alias("s_high"))
    video = own.where("kind = 'video'").join(parts, "id", "left")
    video = video.select("id", F.when(F.col("b.low") > -INF, F.greatest("b.low", "s_low")).otherwise(F.lit(-INF)).alias("low"), F.greatest("b.high", "s_high").alias("high"))
    rows = written(own.where("kind IS NULL OR kind <> 'video'").select("id", "b.low", "b.high").unionByName(video))
    reached = rows.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).first()
    least = reached.least if reached.n == k else -INF
    return rows.where(F.col("high") >= least).select("id"), least


def asked_whole(files: DataFrame, segs: DataFrame, vector: list[float], chosen: Filter = Filter(), k: int = 60, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of files and of segs whose vectors decide: of a candidate's segments, those alone that can reach the score."""
    found, least = candidates(files, segs, vector, chosen, k, exclude)
    best = written(found)
    parts = narrowed(segs.where(F.col("code.dim") == len(vector)), "file_id", best).withColumn("__b", bounds("code", vector)).where(F.col("__b.high") >= least).drop("__b")
    return narrowed(files, "id", best), parts


def ranked_by_codes(files: DataFrame, segs: DataFrame, vector: list[float], chosen: Filter = Filter(), k: int = 60, exclude: DataFrame | None = None) -> DataFrame:
    """``search.ranked`` for tables with codes (``with_codes``): whole vectors are multiplied of candidates alone."""
    return ranked(*asked_whole(files, segs, vector, chosen, k, exclude), literal(vector), len(vector), chosen, k, exclude)
