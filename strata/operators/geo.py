"""Place names: the nearest gazetteer points of a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.constants import CITY_KM, EARTH_KM, TAIWAN_KM
from strata.functions.media import km, xyz
from strata.functions.vectors import dot


def nearest(points: DataFrame, gazetteer: DataFrame, within_km: float) -> DataFrame:
    """(id, place, km): the nearest gazetteer point (columns place, lat, lon) within the distance.

    Both sides go to cells of a latitude-longitude grid as wide as the distance;
    a position meets only the cells around its own, so this is an equi-join. What was
    met is dealt by id before it is grouped: a task that scans holds no groups.
    """
    import math

    step = math.degrees(within_km / EARTH_KM)
    row = lambda lat: F.floor(lat / step).cast("long")
    # a cell row's width in longitude, from its edge nearest to a pole; the poles' rows are one cell
    rows = points.select("id", "lat", "lon", F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1)))).alias("d")).withColumn("r", row(F.col("lat")) + F.col("d"))
    edge = F.least(F.lit(90.0), F.greatest(F.abs(F.col("r") * step), F.abs((F.col("r") + 1) * step)) + step)
    cells = F.when(edge >= 89.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * 360 / step))).cast("long")
    column = lambda lon, n: F.least(n - 1, F.floor((lon + 180) / 360 * n).cast("long"))
    near = F.array_distinct(F.array(*(F.pmod(column(F.col("lon"), F.col("n")) + k, F.col("n")) for k in (-1, 0, 1))))  # few cells in a row may be the same one
    asked = rows.withColumn("n", cells).select("id", "r", F.explode(near).alias("c"), "lat", "lon")
    known = gazetteer.select("place", F.col("lat").alias("glat"), F.col("lon").alias("glon")).withColumn("r", row(F.col("glat"))).withColumn("n", cells).withColumn("c", column(F.col("glon"), F.col("n"))).drop("n")
    met = asked.join(known, ["r", "c"]).withColumn("km", km(dot(xyz("lat", "lon"), xyz("glat", "glon")))).where(F.col("km") <= within_km)
    best = met.repartition("id").groupBy("id").agg(F.min(F.struct("km", "place")).alias("m"))
    return best.select("id", F.col("m.place").alias("place"), F.col("m.km").alias("km"))


def place_of(points: DataFrame, districts: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, place1, place2): the district within 10 km if no city is nearer, else the city within 80 km with its country; nulls far from all, and at the origin.

    districts: place (struct p1, p2), lat, lon; cities: place (struct p1 the country, p2 the city), lat, lon.
    """
    real = points.where((F.abs("lat") >= 1e-6) | (F.abs("lon") >= 1e-6))
    d = nearest(real, districts, TAIWAN_KM).select("id", F.col("place").alias("dp"), F.col("km").alias("dk"))
    c = nearest(real, cities, CITY_KM).select("id", F.col("place").alias("cp"), F.col("km").alias("ck"))
    out = points.select("id").join(d, "id", "left").join(c, "id", "left")
    own = F.col("dk").isNotNull() & (F.col("ck").isNull() | (F.col("dk") <= F.col("ck")))
    return out.select("id", F.when(own, F.col("dp.p1")).otherwise(F.col("cp.p1")).alias("place1"), F.when(own, F.col("dp.p2")).otherwise(F.col("cp.p2")).alias("place2"))
