"""Mixing sources to target weights by Poisson replication.

A source with weight w and size s gets the mean repetition rate w * total / s.
Each document draws a uniform number from a hash of the seed and its id, inverts
the Poisson distribution with its source's rate there, and is exploded into that
many copies; the copies are dealt to partitions by a hash key and sorted by it
inside, which is one global order drawn at random.

The inversion counts the entries of the source's cumulative distribution at or
below the draw; the distribution is computed once per source. A rate above
``CHUNK`` is a sum of independent draws of at most that mean.

Defined results: null is a source of its own; a null text has size zero but its
document can be drawn; rows with equal ids draw alike; a source of total size
zero gets the rate 1. Given weights are added up by source; a source without one has
weight 0 and its documents are left out; weights that are null, negative or infinite,
or that leave no source of the documents a positive one, are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Renamed, Scratch

CHUNK, TERMS_PAST = 100, 200  # largest mean of one draw; entries of its distribution, far past the last that 52 bits can reach


def draw(*parts: Column) -> Column:
    """A uniform number in [0, 1) with 52 bits, from the MD5 of the parts joined by colons; null counts as the word null."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS_PAST + CHUNK)), start, step, lambda s: s["c"])


def rates(docs: DataFrame, source: str, size: Column, temperature: float, weights: DataFrame | None, factor: float) -> DataFrame:
    """(__source, __rate, __draws, __cdf): one row per source.

    Without ``weights`` (columns source, weight) a source's weight is its share of
    the size to the power of ``temperature``; below 1 this lifts small sources.
    """
    sums = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__size"))
    if weights is None:
        given = sums.withColumn("__weight", F.pow("__size", F.lit(temperature)))
    else:
        weight = F.col("weight").cast("double")
        fine = F.when((weight >= 0) & (weight < float("inf")), weight).otherwise(F.raise_error(F.lit("a weight is null, negative or infinite")).cast("double"))
        target = weights.groupBy(F.col("source").alias("__w")).agg(F.sum(fine).alias("__weight"))
        given = sums.join(target, F.col("__source").eqNullSafe(F.col("__w")), "left").drop("__w").na.fill(0.0, ["__weight"])
    total = given.where("__size > 0").agg(F.sum("__size").alias("__total"), F.sum("__weight").alias("__weights"))  # one row
    share = F.try_divide(F.lit(factor) * F.col("__weight"), F.col("__weights"))  # null if all weights are 0
    rate = F.when(F.col("__size") > 0, share * F.col("__total") / F.col("__size")).otherwise(F.lit(1.0))
    out = given.crossJoin(F.broadcast(total)).select("__source", rate.alias("__rate"))
    out = out.withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("__rate") / CHUNK)).cast("int"))
    return out.withColumn("__cdf", distribution(F.col("__rate") / F.col("__draws")))


def mix(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text: str = "text", temperature: float = 0.5, weights: DataFrame | None = None, factor: float = 1.0, seed: int = 17, keep_draw: bool = False) -> DataFrame:
    """Documents replicated to their sources' rates and shuffled; ``factor`` scales the total size.

    Returns the columns of ``docs``, and with ``keep_draw`` also rate, n_copies,
    copy (from 0) and shuffle_key, to which columns of the same names give way.
    """
    named = Renamed(docs)
    own, where, who, what = named.df, named[source], named[id_column], named[text]
    # written first, so that Spark knows its size when it plans the join: small, it is broadcast and no text moves
    by = Scratch(docs.sparkSession, "mixing").put(rates(own, where, F.coalesce(F.length(what), F.lit(0)).cast("double"), temperature, weights, factor))
    if by.where("__rate is null").limit(1).count():
        raise ValueError("no source of the documents has a positive weight")
    own = own.join(by, F.col(where).eqNullSafe(F.col("__source")), "left")
    draws = F.transform(F.sequence(F.lit(1), F.col("__draws")), lambda k: draw(F.lit(seed), k, F.col(who)))
    each = F.transform(draws, lambda u: F.size(F.filter("__cdf", lambda c: c <= u)))
    own = own.withColumn("n_copies", F.aggregate(each, F.lit(0), lambda a, b: a + b)).where("n_copies > 0").drop("__cdf", "__draws", "__source")
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed} shuffle"), F.coalesce(F.col(who).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    own = own.withColumn("shuffle_key", key).withColumn("__deal", F.xxhash64("shuffle_key", what))  # ids that many rows share are spread by their texts
    shuffled = own.repartition("__deal").sortWithinPartitions("shuffle_key").withColumnRenamed("__rate", "rate")
    extra = ("rate", "n_copies", "copy", "shuffle_key") if keep_draw else ()
    return shuffled.select(*named.back(extra), *extra)


#: The same in DuckDB for the query's parameters; rates are rounded on both sides.
MIX_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS sz FROM documents GROUP BY source),
w AS (SELECT source, sz, pow(sz, 0.5) AS wt FROM s),
r AS (SELECT source, CASE WHEN sz > 0 THEN 1.0 * wt / (SELECT sum(wt) FROM w) * (SELECT sum(sz) FROM w) / sz ELSE 1.0 END AS rate FROM w),
t AS (SELECT source, rate, k, exp(-rate) * product(rate / k) OVER (PARTITION BY source ORDER BY k) AS p
      FROM r, (SELECT unnest(generate_series(1, {TERMS_PAST})) AS k)),
c AS (SELECT source, 0 AS k, exp(-rate) AS cdf FROM r UNION ALL
      SELECT source, k, exp(-rate) + sum(p) OVER (PARTITION BY source ORDER BY k) FROM t),
l AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
u AS (SELECT d.doc_id, d.source, d.text, r.rate, l.cdf,
  ('0x' || substr(md5('17:1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN r ON r.source IS NOT DISTINCT FROM d.source JOIN l ON l.source IS NOT DISTINCT FROM d.source),
n AS (SELECT doc_id, source, text, rate, len(list_filter(cdf, lambda x: x <= u))::INTEGER AS n_copies FROM u),
e AS (SELECT *, unnest(generate_series(0, n_copies - 1))::INTEGER AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, source, text, round(rate, 6) AS rate, n_copies, copy,
  md5('17 shuffle:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key FROM e
"""
