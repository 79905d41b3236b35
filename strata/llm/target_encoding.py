"""Time-ordered target encoding: what a row's keys were worth in the past of the other folds.

Rows carry a fold, a time and aggregated history: a count, and how much of it hit the
target. Each history row is replicated to every other fold as recipient, a column for each recipient; rows are
dealt by key and time slice and summed by recipient, key and slice in order of time, so that a
row's history is a running sum as it stands: nothing is subtracted. What lies in earlier slices comes in as
one carried row for each recipient, key and slice, made in the same way from the slices' sums, a level up.

Only keys with more than ``slice_rows`` rows are cut into slices, each into as many as it
takes; their list is a table that is joined, so nothing that grows with the input goes to the driver, and
nothing is broadcast but what Spark measures as small.

Defined results: null keys form one shared value, as do ids that a lookup table lacks; repeated
lines count each, repeated rows of sales multiply their lines; a sale id with several clients or
times has a row for each; repeated ids of a lookup table count as one, with their smallest attribute;
lines without a sale or a time are left out; a null flag is no return; rows of one time don't see each other; without
rows the result is empty. Times without a zone are read as they stand, whatever the session's zone.
Columns beside those named are passed over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import Scratch

SLICE_ROWS = 50_000


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp's fields as they read."""
    minutes = (F.unix_date(time.cast("date")) * 24 + F.hour(time)).cast("long") * 60 + F.minute(time)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")


def fold_of(key: Column, folds: int) -> Column:
    """Unsigned CRC-32 of the key's decimal digits, modulo the number of folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")


def rate(hits: Column, count: Column, prior: Column, weight: int = 50) -> Column:
    """Hits of count in millionths, drawn to the prior as by ``weight`` rows; the prior itself where there is no history."""
    drawn = F.call_function("div", F.lit(1_000_000) * hits + F.lit(weight) * prior, count + F.lit(weight))
    return F.when(count < 1, prior).otherwise(drawn).cast("long")


def long_keys(bases: dict[str, DataFrame], scratch: Scratch, folds: int = 5, slice_rows: int = SLICE_ROWS) -> dict[str, DataFrame]:
    """By key column, where some have more than slice_rows rows in their base: (hot, since, width), the keys and the slices they are cut into.

    A slice holds 4 * folds rows at least, so that the level above, a row for each slice and fold, has at most about a quarter of the rows.
    """
    found, slice_rows = None, max(slice_rows, 4 * folds)
    for key, base in bases.items():
        spans = base.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("rows"), F.min("t").alias("since"), F.max("t").alias("until")).where(F.col("rows") > slice_rows)
        spans = spans.select(F.lit(key).alias("key"), F.col("hot").cast("string").alias("hot"), "since", F.expr(f"(until - since) div (rows div {slice_rows}) + 1").alias("width"))
        found = spans if found is None else found.unionByName(spans)
    found = scratch.put(found)
    names = [r["key"] for r in found.select("key").distinct().collect()]  # of columns, not of keys
    return {k: found.where(F.col("key") == k).select(F.col("hot").cast(bases[k].schema[k].dataType).alias("hot"), "since", "width") for k in names}


def _sliced(rows: DataFrame, key: str, long: DataFrame) -> DataFrame:
    """With __slice: null for keys that are whole."""
    return rows.join(long, F.col(key).eqNullSafe(F.col("hot")), "left").withColumn("__slice", F.expr("(t - since) div width")).drop("hot", "since", "width")


def with_history(rows: DataFrame, base: DataFrame, key: str, n: str, s: str, scratch: Scratch, folds: int = 5, slice_rows: int = SLICE_ROWS, long: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rows`` (fold, t, n, s and others) with the count ``n`` and the hits ``s`` of the history that shares their value of ``key``.

    ``base`` is a written table with the same fold, t, n, s and key, from which the slices are found
    (``long``: what long_keys has found).
    """
    given, carried = rows.columns, None
    long = long_keys({key: base}, scratch, folds, slice_rows) if long is None else long
    if key not in long:
        held = rows.withColumn("__slice", F.lit(None).cast("long"))
    else:
        held = _sliced(rows, key, long[key])
        sums = _sliced(base.select("fold", "t", "n", "s", key), key, long[key]).where("__slice is not null")
        sums = scratch.put(sums.groupBy(F.col(key).alias("value"), F.col("__slice").alias("t"), "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
        above = with_history(sums, sums, "value", "carried_n", "carried_s", scratch, folds, slice_rows)
        carried = above.where("carried_n > 0").select(F.col("value").alias("__key"), F.col("t").alias("__slice"), F.col("fold").alias("__to"), F.lit(-(1 << 62)).alias("__t"), F.col("carried_n").alias("__n"), F.col("carried_s").alias("__s"), F.lit(True).alias("__carried"))
    dealt = held.select(*given, F.col(key).alias("__key"), "__slice", F.col("t").alias("__t"), F.col("n").alias("__n"), F.col("s").alias("__s"), F.lit(False).alias("__carried"))
    if carried is not None:
        dealt = dealt.unionByName(carried, allowMissingColumns=True)
    dealt = dealt.withColumn("__fold", F.coalesce("__to", "fold") if carried is not None else F.col("fold"))
    # the replica for recipient r is a column: history that comes from elsewhere, or was carried for r
    meant = [F.when((F.col("__fold") == r) == F.col("__carried"), 1).otherwise(0) for r in range(folds)]
    sent = dealt.repartition("__key", "__slice").withColumns({f"__{c}{r}": F.col(f"__{c}") * m for r, m in enumerate(meant) for c in "ns"})
    earlier = Window.partitionBy("__key", "__slice").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    summed = sent.withColumns({f"__{c}{r}": F.sum(f"__{c}{r}").over(earlier) for r in range(folds) for c in "ns"}).where("not __carried")
    asked = lambda c: F.coalesce(F.element_at(F.array(*(F.col(f"__{c}{r}") for r in range(folds))), F.col("fold") + 1), F.lit(0)).cast("long")
    return summed.select(*given, asked("n").alias(n), asked("s").alias(s))


def _lookup(table: DataFrame, id_column: str, attribute: str) -> DataFrame:
    return table.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("known")).agg(F.min(attribute).alias(attribute))


def sale_rates(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = 5, prior: int = 500_000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per sale_id, item_id, vendor_id: its lines and returns, and count and rate of the history of item, vendor and client.

    Priors go from all history to the kind, nation or segment, and from there to the id.
    """
    scratch = Scratch(lines.sparkSession, "rates")
    sold = sales.where("sold_at is not null and sale_id is not null").groupBy("sale_id", F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id"), micros(F.col("sold_at")).alias("t")).agg(F.count("*").alias("times"))
    bought = lines.where("sale_id is not null").groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), "vendor_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "returned").alias("s"))
    rows = bought.join(sold, "sale_id").withColumns({"n": F.col("n") * F.col("times"), "s": F.col("s") * F.col("times"), "fold": fold_of(F.col("sale_id"), folds)}).drop("times")
    for id_column, table, attribute in (("item_id", items, "kind"), ("vendor_id", vendors, "nation_id")):
        rows = rows.join(_lookup(table, id_column, attribute), F.col(id_column) == F.col("known"), "left").drop("known")
    rows = scratch.put(rows)

    by_sale = rows.groupBy("sale_id", "client_id", "t", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_sale = scratch.put(by_sale.join(_lookup(clients, "client_id", "segment"), F.col("client_id") == F.col("known"), "left").drop("known").withColumn("everything", F.lit(0)))

    bases = {"everything": by_sale, "segment": by_sale, "client_id": by_sale, "kind": rows, "item_id": rows, "nation_id": rows, "vendor_id": rows}
    long = long_keys(bases, scratch, folds, slice_rows)

    def step(frame: DataFrame, key: str, before: Column, name: str, keep_n: bool = False) -> DataFrame:
        found = with_history(frame, bases[key], key, "n_", "s_", scratch, folds, slice_rows, long)
        found = found.withColumn(f"{name}_rate", rate(F.col("s_"), F.col("n_"), before))
        return found.withColumnRenamed("n_", f"{name}_n").drop("s_") if keep_n else found.drop("n_", "s_")

    asked = step(by_sale, "everything", F.lit(prior), "all").drop("everything")
    asked = step(asked, "segment", F.col("all_rate"), "segment").drop("segment")
    asked = step(asked, "client_id", F.col("segment_rate"), "client", keep_n=True)
    asked = asked.select("sale_id", "client_id", "t", "all_rate", "client_n", "client_rate")

    found = rows.join(asked, ["sale_id", "client_id", "t"])
    found = step(found, "kind", F.col("all_rate"), "kind").drop("kind")
    found = step(found, "item_id", F.col("kind_rate"), "item", keep_n=True).drop("kind_rate")
    found = step(found, "nation_id", F.col("all_rate"), "nation").drop("nation_id", "all_rate")
    found = step(found, "vendor_id", F.col("nation_rate"), "vendor", keep_n=True)
    return found.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


def _running(partition: str) -> str:
    """Counts before a line in other folds: those of all folds less those of its own, over whole windows."""
    earlier = "ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    both = lambda x: f"coalesce(sum({x}) OVER (PARTITION BY {partition} {earlier}), 0) - coalesce(sum({x}) OVER (PARTITION BY {partition}, fold {earlier}), 0)"
    return f"CAST({both('1')} AS BIGINT) AS %s_n, CAST({both('hit')} AS BIGINT) AS %s_s"


def _rates_sql() -> str:
    keys = {"g": "0", "kind": "kind", "nation": "nation_id", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
    sums = ", ".join(_running(v) % (k, k) for k, v in keys.items())
    step = lambda k, p: f"CASE WHEN {k}_n < 1 THEN {p} ELSE (1000000 * {k}_s + 50 * {p}) // ({k}_n + 50) END"
    return f"""
WITH bits AS (SELECT list(list_reduce([i] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS b FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT sale_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, d: xor(b[xor(a, d) % 256 + 1], a // 256)), 4294967295) AS c FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL), bits),
l AS (SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, epoch_us(s.sold_at) AS t,
    crc.c % 5 AS fold, CASE WHEN l.flag = 'returned' THEN 1 ELSE 0 END AS hit
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id JOIN crc ON crc.sale_id = l.sale_id WHERE s.sold_at IS NOT NULL),
k AS (SELECT l.*, i.kind, v.nation_id, c.segment FROM l LEFT JOIN items i ON l.item_id = i.item_id LEFT JOIN vendors v ON l.vendor_id = v.vendor_id LEFT JOIN clients c ON l.client_id = c.client_id),
h AS (SELECT *, {sums} FROM k),
g AS (SELECT *, {step("g", "500000")} AS g_rate FROM h),
p AS (SELECT *, {step("kind", "g_rate")} AS kind_rate, {step("nation", "g_rate")} AS nation_rate, {step("segment", "g_rate")} AS segment_rate FROM g),
r AS (SELECT *, {step("item", "kind_rate")} AS item_rate, {step("vendor", "nation_rate")} AS vendor_rate, {step("client", "segment_rate")} AS client_rate FROM p)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, CAST(sum(hit) AS BIGINT) AS n_returned, min(item_n) AS item_n, min(item_rate) AS item_rate,
  min(vendor_n) AS vendor_n, min(vendor_rate) AS vendor_rate, min(client_n) AS client_n, min(client_rate) AS client_rate
FROM r GROUP BY sale_id, item_id, vendor_id
"""


#: The same by whole windows and subtraction; CRC-32 is worked out from its polynomial.
RATES_SQL = _rates_sql()
