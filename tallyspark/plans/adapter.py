"""The driver's tables as the domain's tables, and the same mapping as SQL for the checks.

snapshots: one price observation per order line. Parts are canonical products, a part at a supplier is a source
product, suppliers are stores, nations are chains' localities. Prices are whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions (supplier, nation) are fixed and small; lines and orders join on the order key, whose shuffle the planner chooses."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    stores = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    retail = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("double") / 100
    promo = F.when(F.col("l_discount") > 0, F.floor(F.col("retail_price") * (1 - F.col("l_discount")) * 100 + 0.5).cast("double") / 100).otherwise(0.0)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.withColumn("retail_price", retail).withColumn("promo_price", promo).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("snapshot_id"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("source_product_id"),
        F.col("l_partkey").alias("canonical_product_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot_date"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ingested_at"),
        F.col("n_name").alias("locality_code"),
        F.col("s_name").alias("store_name"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category_code"),
        "retail_price",
        "promo_price",
    )


SNAPSHOTS = """
lines AS (
  SELECT l.*, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS retail FROM lineitem l
), snapshots AS (
  SELECT l_orderkey || '-' || l_linenumber AS snapshot_id, l_partkey || '-' || l_suppkey AS source_product_id,
         l_partkey AS canonical_product_id, strftime(o_orderdate, '%Y-%m-%d') AS snapshot_date, strftime(l_shipdate, '%Y-%m-%d') AS ingested_at,
         n_name AS locality_code, s_name AS store_name, p_name AS product_name, p_brand AS brand, p_type AS category_code,
         retail AS retail_price,
         CASE WHEN l_discount > 0 THEN floor(retail * (1 - l_discount) * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS promo_price
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), priced AS (
  SELECT *, CASE WHEN promo_price > 0 AND promo_price < retail_price THEN promo_price WHEN retail_price > 0 THEN retail_price END AS price FROM snapshots
)"""


def sql_round(x: str, places: int = 2) -> str:
    unit = 10**places
    return f"(floor((({x}) + 2.220446049250313e-16) * {unit}::DOUBLE + 0.5) / {unit}::DOUBLE)"


def sql_sum(x: str) -> str:
    return f"sum(({x})::DECIMAL(18,4))::DOUBLE"


def sql_avg(x: str) -> str:
    return f"(sum(({x})::DECIMAL(18,4))::DOUBLE / count({x}))"


#: The latest observation of each source product, as a current offer.
LATEST = f"""{SNAPSHOTS}, latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_product_id ORDER BY snapshot_date DESC, ingested_at DESC, snapshot_id DESC) AS rn FROM priced
  ) WHERE rn = 1
), offers AS (
  SELECT 'offer_' || source_product_id AS offer_id, canonical_product_id, source_product_id, locality_code AS chain_id, store_name AS store_id, category_code, brand, product_name,
         price AS current_price, retail_price, promo_price, promo_price > 0 AND promo_price < retail_price AS is_sale, snapshot_date
  FROM latest WHERE price IS NOT NULL
)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search signals from events: what was asked for, how it ended, where, at what price."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("purchase", "click"), "resolved").when(F.col("event_type") == "view", "ambiguous").otherwise("unresolved")
    user = F.col("user_id")
    return e.select(
        "event_id",
        F.concat(F.lit("item-"), user % 40).alias("normalized_query"),
        status.alias("status"),
        F.concat(F.lit("cat-"), user % 7).alias("category_l2"),
        F.concat(F.lit("loc-"), user % 5).alias("locality_code"),
        F.when(user % 11 != 0, F.concat(F.lit("chain-"), F.col("event_id") % 4)).alias("chain_id"),
        F.when(F.col("event_type") == "signup", "watchlist").when(F.col("event_type") == "error", "shopping_list").otherwise("search").alias("source"),
        F.when(F.col("value") > 0, F.floor(F.col("value") * 100 + 0.5) / 100).alias("avg_price"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"),
    )


SIGNALS = """
signals AS (
  SELECT event_id, 'item-' || (user_id % 40) AS normalized_query,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'resolved' WHEN event_type = 'view' THEN 'ambiguous' ELSE 'unresolved' END AS status,
         'cat-' || (user_id % 7) AS category_l2, 'loc-' || (user_id % 5) AS locality_code,
         CASE WHEN user_id % 11 <> 0 THEN 'chain-' || (event_id % 4) END AS chain_id,
         CASE WHEN event_type = 'signup' THEN 'watchlist' WHEN event_type = 'error' THEN 'shopping_list' ELSE 'search' END AS source,
         CASE WHEN value > 0 THEN floor(value * 100 + 0.5) / 100 END AS avg_price,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at
  FROM events
)"""
