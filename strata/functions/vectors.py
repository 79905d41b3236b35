"""Vectors as arrays: products in doubles, norms, truncation, means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Inner product, summed in doubles; null if either is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def unit(vector, eps: float = 1e-9) -> Column:
    """The vector over its norm plus eps."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v)) + eps), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def truncate(vector, dim: int) -> Column:
    """The first dim entries, normalised."""
    return unit(F.slice(vector, 1, dim))


def has_dim(vector, dim: int) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) == dim)


def mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by..., vec: the normalised mean of each group's vectors; entries are averaged where they lie, then gathered once."""
    flat = rows.select(*by, F.posexplode(vector).alias("__pos", "__x"))
    means = flat.groupBy(*by, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    out = means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__m"))), lambda s: s["__m"]).alias("vec"))  # one entry per dimension
    return out.withColumn("vec", unit("vec"))
