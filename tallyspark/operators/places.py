"""Places: distances, radius joins, merged locations, coordinate choice, distance summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import rounded

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.0
#: What a chord may be too long by, in km on the ground: more than the rounding of a distance and of its sums. Bytes of places that go to all tasks, and of one; tasks a core.
SLACK_KM, MOST_BYTES, PLACE_BYTES, TASKS = 0.01, 8 << 20, 120, 4


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres to three places; null if a coordinate is missing or out of range."""
    ok = (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90) & (F.abs(lon1) <= 180) & (F.abs(lon2) <= 180)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.when(ok, rounded(2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h)), 3))


def within(origins: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """Pairs of origin and place within km, anywhere on the globe.

    Places go to bands of latitude a little over one radius high, and within a band to cells of longitude that are as wide as the radius can be there;
    round a pole a band is one cell. Origins look into their own band and the two beside it, and there into their own cell and those beside it,
    across the date line too. So the join is by band and cell and never all pairs. Coordinates out of range meet nothing. origins: origin_id, lat, lon. places: place_id, lat, lon.
    """
    tall, turn = km / KM_PER_DEGREE, km / EARTH_KM
    band = F.floor(F.col("lat") / tall).cast("long")
    # the latitude farthest from the equator of a band and the two beside it, and how many cells the band has there
    far = F.least(F.greatest(F.abs((F.col("__y") - 1) * tall), F.abs((F.col("__y") + 2) * tall)), F.lit(90.0))
    reach = F.lit(math.sin(turn)) / F.cos(F.radians(far))
    cells = F.when((reach < 1) & F.lit(turn < math.pi / 2), F.greatest(F.floor(F.lit(2 * math.pi) / F.asin(reach)), F.lit(1))).otherwise(1).cast("long")
    cell = F.floor((F.col("lon") + 180) / 360 * F.col("__n")).cast("long")
    # points on the unit sphere: a chord much longer than the radius allows is told by three products, without the distance's functions
    p, q = F.radians("lat"), F.radians("lon")
    at = F.array(F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))
    xyz = lambda side: [at[i].alias(f"__{side}{i}") for i in range(3)]
    spark = origins.sparkSession
    few = places.count() * PLACE_BYTES <= MOST_BYTES
    # few places go to all tasks, so origins are dealt out evenly, however few files or places they lie in; many meet by cell
    a = origins.repartition(TASKS * spark.sparkContext.defaultParallelism, "origin_id") if few else origins
    a = a.select("origin_id", "lat", "lon", *xyz("o"), F.explode(F.sequence(band - 1, band + 1)).alias("__y")).withColumn("__n", cells)
    a = a.withColumn("__x", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.pmod(cell + s, F.col("__n"))))))
    a = a.select("origin_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "__o0", "__o1", "__o2", "__y", "__x")
    b = places.select("place_id", "lat", "lon", *xyz("p")).withColumn("__y", band).withColumn("__n", cells).withColumn("__x", F.pmod(cell, F.col("__n"))).drop("__n")
    chord = sum(((F.col(f"__o{i}") - F.col(f"__p{i}")) * (F.col(f"__o{i}") - F.col(f"__p{i}")) for i in range(3)), F.lit(0.0))
    most = (2 * math.sin(min(turn + SLACK_KM / EARTH_KM, math.pi) / 2)) ** 2
    met = a.join(F.broadcast(b) if few else b, ["__y", "__x"])
    near = met.filter(chord <= most * (1 + 1e-9) + 1e-15) if turn < math.pi / 2 else met
    pairs = near.withColumn("distance_km", haversine(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon")))
    return pairs.filter(F.col("distance_km") <= km).select("origin_id", "place_id", "distance_km")


def resolve_coordinates(locations: DataFrame, reviewed: DataFrame, geocoded: DataFrame) -> DataFrame:
    """A reviewed coordinate if there is one, else the provider's, else none."""
    r = reviewed.select("location_id", F.struct("lat", "lon").alias("r"))
    g = geocoded.select("location_id", F.struct("lat", "lon").alias("g"))
    rows = locations.join(r, "location_id", "left").join(g, "location_id", "left")
    source = F.when(F.col("r").isNotNull(), "reviewed").when(F.col("g").isNotNull(), "provider").otherwise("none")
    return rows.select("location_id", F.coalesce("r.lat", "g.lat").alias("lat"), F.coalesce("r.lon", "g.lon").alias("lon"), source.alias("coordinate_source"))


def merge_locations(snapshots: DataFrame) -> DataFrame:
    """One row per store and locality: days seen, observations, distinct products."""
    return snapshots.groupBy("locality_code", "store_name").agg(F.min("snapshot_date").alias("first_seen"), F.max("snapshot_date").alias("last_seen"), F.count("*").alias("observations"), F.countDistinct("canonical_product_id").alias("products"))


def availability_order(rows: DataFrame, sort: str) -> DataFrame:
    """nearest, cheapest or best_value (price and 0.1 a kilometre)."""
    value = rounded(F.col("price") + 0.1 * F.col("distance_km"), 3)
    first = {"nearest": ["distance_km", "price"], "cheapest": ["price", "distance_km"], "best_value": ["value", "price"]}[sort]
    return rows.withColumn("value", value).orderBy(*first, "offer_id")


def distance_summary(distances: DataFrame, km: str = "distance_km") -> DataFrame:
    """count, mean, greatest, and the nearest-rank 95th percentile, which is percentile_disc.

    Equal distances are counted first. They have three places, so what is left are no more rows than metres of the longest, whatever the pairs.
    """
    n, d = F.col("__n"), F.col(km)
    each = distances.filter(d.isNotNull()).groupBy(d.alias(km)).agg(F.count("*").alias("__n"))
    # as exact_sum, each distance as often as it occurs
    units = F.floor(d * 10000.0 + 0.5)
    lower = units % 1_000_000
    total = (F.sum(((units - lower) / 1_000_000).cast("long") * n).cast("double") * 1e6 + F.sum(lower * n).cast("double")) / 10000.0
    whole = each.agg(F.coalesce(F.sum(n), F.lit(0)).alias("count"), rounded(total / F.sum(n), 3).alias("mean_km"), F.max(km).alias("max_km"))
    upto = each.withColumn("__upto", F.sum(n).over(Window.orderBy(km))).crossJoin(F.broadcast(whole.select(F.col("count").alias("__all"))))
    p95 = upto.filter(F.col("__upto") >= 0.95 * F.col("__all")).agg(F.min(km).alias("p95_km"))
    return whole.crossJoin(F.broadcast(p95)).select("count", "mean_km", "max_km", "p95_km")


def parse_store(text: Column) -> tuple[Column, Column, Column]:
    """City, address and branch number of "City, address #12"."""
    return F.trim(F.regexp_extract(text, r"^([^,]+),", 1)), F.trim(F.regexp_extract(text, r",\s*([^#]+)", 1)), F.regexp_extract(text, r"#(\d+)", 1).try_cast("int")
