"""Queries over places: suppliers are stores and customers shoppers, with coordinates made from their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import places as G
from tallyspark.operators import prices as P
from tallyspark.plans.adapter import LATEST, SNAPSHOTS, read, snapshots, sql_avg, sql_round
from tallyspark.plans.registry import query

R = sql_round

HAVERSINE = "6371.0088::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h))"
POINTS = """stores AS (SELECT s_suppkey AS place_id, 42.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS lat, 23.0::DOUBLE + (s_suppkey * 91 % 1000) / 1000.0::DOUBLE AS lon, s_name FROM supplier),
shoppers AS (SELECT c_custkey AS origin_id, 42.0::DOUBLE + (c_custkey * 53 % 1000) / 1000.0::DOUBLE AS lat, 23.0::DOUBLE + (c_custkey * 17 % 1000) / 1000.0::DOUBLE AS lon FROM customer),
pairs AS (SELECT origin_id, place_id, pow(sin((radians(s.lat) - radians(o.lat)) / 2), 2) + cos(radians(o.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(o.lon)) / 2), 2) AS h FROM shoppers o, stores s)""" + f""",
near AS (SELECT origin_id, place_id, {R(HAVERSINE, 3)} AS distance_km FROM pairs WHERE {R(HAVERSINE, 3)} <= 15)"""


def _points(spark, d):
    at = lambda k, m: (F.col(k) * m % 1000) / F.lit(1000.0)
    stores = read(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), (at("s_suppkey", 37) + 42.0).alias("lat"), (at("s_suppkey", 91) + 23.0).alias("lon"), "s_name")
    shoppers = read(spark, d, "customer").select(F.col("c_custkey").alias("origin_id"), (at("c_custkey", 53) + 42.0).alias("lat"), (at("c_custkey", 17) + 23.0).alias("lon"))
    return shoppers, stores


@query("radius_join", f"WITH {POINTS} SELECT * FROM near")
def radius_join(spark, d):
    shoppers, stores = _points(spark, d)
    return G.within(shoppers, stores, 15.0)


@query("distance_summary", f"WITH {POINTS} SELECT count(*) AS count, {R(sql_avg('distance_km'), 3)} AS mean_km, max(distance_km) AS max_km, quantile_disc(distance_km, 0.95) AS p95_km FROM near")
def distance_summary(spark, d):
    return G.distance_summary(radius_join(spark, d))


@query("priority_coordinates", """SELECT s_suppkey AS location_id, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 WHEN s_suppkey % 3 = 1 THEN 2.0 END::DOUBLE AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 1.5 WHEN s_suppkey % 3 = 1 THEN 2.5 END::DOUBLE AS lon,
  CASE WHEN s_suppkey % 3 = 0 THEN 'reviewed' WHEN s_suppkey % 3 = 1 THEN 'provider' ELSE 'none' END AS coordinate_source FROM supplier""")
def priority_coordinates(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("location_id"))
    reviewed = s.filter("location_id % 3 = 0").select("location_id", F.lit(1.0).alias("lat"), F.lit(1.5).alias("lon"))
    geocoded = s.filter("location_id % 3 < 2").select("location_id", F.lit(2.0).alias("lat"), F.lit(2.5).alias("lon"))
    return G.resolve_coordinates(s, reviewed, geocoded)


@query("retailer_locations", f"WITH {SNAPSHOTS} SELECT locality_code, store_name, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen, count(*) AS observations, count(DISTINCT canonical_product_id) AS products FROM snapshots GROUP BY ALL")
def retailer_locations(spark, d):
    return G.merge_locations(snapshots(spark, d))


@query("nearest_availability", f"""WITH {LATEST}, {POINTS}, o AS (SELECT offer_id, current_price AS price, distance_km FROM offers JOIN stores ON s_name = store_id JOIN near USING (place_id) WHERE origin_id = 11)
  SELECT offer_id, price, distance_km, {R('price + 0.1::DOUBLE * distance_km', 3)} AS value FROM o ORDER BY value, price, offer_id LIMIT 20""")
def nearest_availability(spark, d):
    shoppers, stores = _points(spark, d)
    near = G.within(shoppers.filter("origin_id = 11"), stores, 15.0).join(stores.select("place_id", F.col("s_name").alias("store_id")), "place_id")
    offers = P.current_offers(snapshots(spark, d)).select("offer_id", F.col("current_price").alias("price"), "store_id")
    return G.availability_order(offers.join(near, "store_id").select("offer_id", "price", "distance_km"), "best_value").limit(20)


@query("store_address_parse", "SELECT s_suppkey AS location_id, 'City ' || s_nationkey AS city, 'Main street ' || s_suppkey AS address, s_suppkey::INTEGER AS branch FROM supplier")
def store_address_parse(spark, d):
    text = F.concat(F.lit("City "), "s_nationkey", F.lit(", Main street "), "s_suppkey", F.lit(" #"), "s_suppkey")
    city, address, branch = G.parse_store(text)
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("location_id"), city.alias("city"), address.alias("address"), branch.alias("branch"))
