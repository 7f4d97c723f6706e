"""Queries over prices: aggregates, offers, lookups, deals, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import prices as P
from tallyspark.functions.money import exact_avg, rounded
from tallyspark.plans.adapter import AS_OF, LATEST, SNAPSHOTS, read, snapshots, sql_avg, sql_round
from tallyspark.plans.registry import query

R = sql_round


@query("effective_price", f"WITH {SNAPSHOTS} SELECT snapshot_id, retail_price, promo_price, price FROM priced")
def effective_price(spark, d):
    return P.with_price(snapshots(spark, d)).select("snapshot_id", "retail_price", "promo_price", "price")


DAILY = f"""{R(sql_avg('price'), 4)} AS price_avg, {R('min(price)', 4)} AS price_min, {R('max(price)', 4)} AS price_max,
  count(DISTINCT locality_code || '|' || store_name) AS store_count, count(*) AS snapshot_count"""


@query("daily_product_price", f"WITH {SNAPSHOTS} SELECT canonical_product_id, snapshot_date, {DAILY} FROM priced GROUP BY ALL")
def daily_product_price(spark, d):
    return P.daily_prices(snapshots(spark, d), "canonical_product_id")


@query("daily_category_price", f"""WITH {SNAPSHOTS} SELECT category_code, snapshot_date, {R(sql_avg('price'), 4)} AS avg_price, {R('min(price)', 4)} AS min_price,
  {R('max(price)', 4)} AS max_price, count(DISTINCT source_product_id) AS product_count, count(*) AS snapshot_count FROM priced GROUP BY ALL""")
def daily_category_price(spark, d):
    return P.category_prices(snapshots(spark, d))


@query("day_build_idempotent", f"""WITH {SNAPSHOTS} SELECT canonical_product_id, snapshot_date, {DAILY} FROM priced
  WHERE snapshot_date NOT IN (SELECT snapshot_date FROM priced WHERE snapshot_date < '2001-01-01') GROUP BY ALL""")
def day_build_idempotent(spark, d):
    rows = snapshots(spark, d)
    return P.missing_days(rows.filter("snapshot_date < '2001-01-01'"), rows, "canonical_product_id")


@query("latest_per_key", f"WITH {LATEST} SELECT source_product_id, snapshot_id, snapshot_date, price FROM latest")
def latest_per_key(spark, d):
    rows = P.with_price(snapshots(spark, d)).select("source_product_id", "snapshot_id", "snapshot_date", "ingested_at", "price")
    return P.latest_per_key(rows, ["source_product_id"], ["snapshot_date", "ingested_at", "snapshot_id"]).drop("ingested_at")


@query("current_offers", f"WITH {LATEST} SELECT * FROM offers")
def current_offers(spark, d):
    return P.current_offers(snapshots(spark, d))


SUMMARY = f"""{LATEST}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY canonical_product_id ORDER BY current_price, snapshot_date DESC, offer_id) AS k FROM offers
), summary AS (
  SELECT canonical_product_id, {R('min(current_price)')} AS min_current_price, {R('max(current_price)')} AS max_current_price, {R(sql_avg('current_price'))} AS avg_current_price,
    count(*) AS offer_count, count(DISTINCT chain_id) AS chain_count, string_agg(DISTINCT chain_id, ',' ORDER BY chain_id) AS available_chains,
    max(CASE WHEN k = 1 THEN offer_id END) AS cheapest_offer_id, max(CASE WHEN k = 1 THEN chain_id END) AS cheapest_chain_id,
    max(CASE WHEN k = 1 THEN current_price END) AS cheapest_price, max(snapshot_date) AS snapshot_date
  FROM ranked GROUP BY canonical_product_id
)"""


@query("offer_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def offer_summary(spark, d):
    return P.offer_summary(P.current_offers(snapshots(spark, d))).withColumn("available_chains", F.array_join("available_chains", ","))


ITEMS = f"""{LATEST}, requested AS (
  SELECT range AS canonical_product_id FROM range(1, 400, 3)
), records AS (
  SELECT o.*, date_diff('day', snapshot_date::DATE, DATE '{AS_OF}') > 120 AS is_stale FROM offers o WHERE canonical_product_id IN (SELECT canonical_product_id FROM requested)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY canonical_product_id ORDER BY is_stale, current_price, snapshot_date DESC, source_product_id) AS k,
    count(*) OVER (PARTITION BY canonical_product_id) AS n, count(*) FILTER (NOT is_stale) OVER (PARTITION BY canonical_product_id) AS fresh FROM records
), items AS (
  SELECT canonical_product_id, CASE WHEN n IS NULL THEN 'missing' WHEN fresh > 0 THEN 'priced' ELSE 'stale' END AS price_status,
    current_price AS best_price, source_product_id AS best_source_product_id, coalesce(n, 0) AS record_count
  FROM requested LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (canonical_product_id)
)"""


def _items(spark, d):
    requested = spark.range(1, 400, 3).withColumnRenamed("id", "canonical_product_id")
    return P.price_lookup(requested, P.current_offers(snapshots(spark, d)), AS_OF, 120)


@query("price_lookup", f"WITH {ITEMS} SELECT * FROM items")
def price_lookup(spark, d):
    return _items(spark, d)


@query("price_lookup_summary", f"""WITH {ITEMS} SELECT count(*) AS requested_count, count(*) FILTER (price_status = 'priced') AS priced_count,
  count(*) FILTER (price_status = 'stale') AS stale_count, count(*) FILTER (price_status = 'missing') AS missing_count FROM items""")
def price_lookup_summary(spark, d):
    return P.lookup_summary(_items(spark, d))


@query("price_record_filters", f"""WITH {LATEST} SELECT offer_id, chain_id, current_price, date_diff('day', snapshot_date::DATE, DATE '{AS_OF}') > 365 AS is_stale
  FROM offers WHERE chain_id IN ('NATION_1', 'NATION_4', 'NATION_22', 'NATION_9', 'NATION_11', 'NATION_15')""")
def price_record_filters(spark, d):
    rows = P.current_offers(snapshots(spark, d)).filter(F.col("chain_id").isin("NATION_1", "NATION_4", "NATION_22", "NATION_9", "NATION_11", "NATION_15"))
    return rows.select("offer_id", "chain_id", "current_price", P.is_stale(F.col("snapshot_date"), AS_OF, 365).alias("is_stale"))


@query("fallback_read_path", f"""WITH {LATEST}, asked AS (SELECT range AS canonical_product_id FROM range(0, 300, 7)),
  first AS (SELECT canonical_product_id, source_product_id, current_price AS price FROM offers WHERE chain_id = 'NATION_4' AND canonical_product_id IN (SELECT canonical_product_id FROM asked)),
  second AS (SELECT canonical_product_id, source_product_id, price FROM latest WHERE canonical_product_id IN (SELECT canonical_product_id FROM asked))
  SELECT *, 'offers' AS path FROM first UNION ALL SELECT *, 'snapshots' FROM second WHERE NOT EXISTS (SELECT 1 FROM first)""")
def fallback_read_path(spark, d):
    """Offers if the request has any, else the snapshots: one flag for the whole request, decided inside the plan."""
    rows = snapshots(spark, d)
    asked = spark.range(0, 300, 7).withColumnRenamed("id", "canonical_product_id")
    offers = P.current_offers(rows).filter("chain_id = 'NATION_4'").join(F.broadcast(asked), "canonical_product_id", "left_semi")
    first = offers.select("canonical_product_id", "source_product_id", F.col("current_price").alias("price"), F.lit("offers").alias("path"))
    last = P.latest_per_key(P.with_price(rows).select("source_product_id", "canonical_product_id", "price", "snapshot_date", "ingested_at", "snapshot_id"), ["source_product_id"], ["snapshot_date", "ingested_at", "snapshot_id"])
    second = last.join(F.broadcast(asked), "canonical_product_id", "left_semi").select("canonical_product_id", "source_product_id", "price", F.lit("snapshots").alias("path"))
    none = first.agg((F.count("*") == 0).alias("__none"))
    return first.unionByName(second.crossJoin(F.broadcast(none)).filter("__none").drop("__none"))


DEALS = f"""{LATEST}, stats AS (
  SELECT canonical_product_id, {R(sql_avg('current_price'))} AS a, {R('min(current_price)')} AS m FROM offers WHERE current_price > 0 GROUP BY ALL
), judged AS (
  SELECT offer_id, o.canonical_product_id, current_price, a AS avg_price, m AS min_price, CASE WHEN a > 0 THEN {R('(current_price - a) / a', 4)} ELSE 0 END AS percent_difference,
    CASE WHEN current_price <= a * 0.8::DOUBLE THEN 'good' WHEN current_price >= a * 1.2::DOUBLE THEN 'expensive' ELSE 'normal' END AS deal_level, target_price
  FROM offers o JOIN stats USING (canonical_product_id) LEFT JOIN (SELECT canonical_product_id, {R('a * 0.7::DOUBLE')} AS target_price FROM stats WHERE canonical_product_id % 3 = 0) USING (canonical_product_id)
), deals AS (
  SELECT offer_id, canonical_product_id, current_price, deal_level,
    greatest(0.0, least(1.0, CASE deal_level WHEN 'good' THEN {R('0.75::DOUBLE + least(abs(percent_difference), 0.5::DOUBLE) / 2', 4)} WHEN 'expensive' THEN {R('0.25::DOUBLE - least(abs(percent_difference), 0.5::DOUBLE) / 2', 4)} ELSE 0.5 END))::DOUBLE AS deal_score,
    CASE deal_level WHEN 'good' THEN 'price is ' || floor(abs(percent_difference) * 100 + 0.5)::BIGINT || '% below recent average'
      WHEN 'expensive' THEN 'price is ' || floor(abs(percent_difference) * 100 + 0.5)::BIGINT || '% above recent average' ELSE 'price is close to recent average' END AS reason,
    coalesce(current_price <= target_price, false) AS target_hit, avg_price, min_price, percent_difference
  FROM judged
)"""


def _deals(spark, d):
    offers = P.current_offers(snapshots(spark, d))
    stats = offers.filter("canonical_product_id % 3 = 0").groupBy("canonical_product_id").agg(rounded(exact_avg(F.col("current_price"))).alias("a"))
    return P.deals(offers, stats.select("canonical_product_id", rounded(F.col("a") * 0.7).alias("target_price")))


@query("deal_class", f"WITH {DEALS} SELECT * FROM deals")
def deal_class(spark, d):
    return _deals(spark, d)


@query("deal_summary", f"""WITH {DEALS} SELECT count(*) FILTER (deal_level = 'good') AS good_deals_count, count(*) FILTER (deal_level = 'expensive') AS expensive_items_count,
  count(*) FILTER (deal_level = 'normal') AS normal_items_count FROM deals""")
def deal_summary(spark, d):
    is_ = lambda s: F.count_if(F.col("deal_level") == s)
    return _deals(spark, d).agg(is_("good").alias("good_deals_count"), is_("expensive").alias("expensive_items_count"), is_("normal").alias("normal_items_count"))


def _trend_sql(days, key):
    now = f"snapshot_date::DATE >= (SELECT max(snapshot_date::DATE) - {(days or 1) - 1} FROM daily)"
    before = f"snapshot_date::DATE >= (SELECT max(snapshot_date::DATE) - {2 * (days or 1) - 1} FROM daily) AND NOT {now}"
    if days:
        per = f"""SELECT canonical_product_id, arg_max(p, snapshot_date) FILTER ({now}) AS current_price, arg_max(p, snapshot_date) FILTER ({before}) AS previous_price,
          (sum(total) FILTER ({now}))::DOUBLE / sum(n) FILTER ({now}) AS mean FROM by_day GROUP BY 1"""
    else:
        per = """SELECT canonical_product_id, max(p) FILTER (k = 1) AS current_price, max(p) FILTER (k = 2) AS previous_price, sum(total)::DOUBLE / sum(n) AS mean
          FROM (SELECT *, row_number() OVER (PARTITION BY canonical_product_id ORDER BY snapshot_date DESC) AS k FROM by_day) GROUP BY 1"""
    return f"""WITH {SNAPSHOTS}, daily AS (SELECT canonical_product_id, source_product_id, snapshot_date, {R(sql_avg('price'), 4)} AS price_avg FROM priced GROUP BY ALL),
    by_day AS (SELECT canonical_product_id, snapshot_date, {R(sql_avg('price_avg'))} AS p, sum(price_avg::DECIMAL(18,4)) AS total, count(*) AS n FROM daily WHERE price_avg > 0 GROUP BY ALL),
    per AS ({per}),
    g AS (SELECT {key} AS key, count(*) AS product_count, count(current_price) AS priced_product_count, {R(sql_avg('current_price'))} AS average_price_current,
      {R(sql_avg('previous_price'))} AS average_price_previous, count(*) FILTER (current_price <= {R('mean')} * 0.8::DOUBLE) AS deal_count
      FROM part LEFT JOIN per ON p_partkey = canonical_product_id GROUP BY 1),
    h AS (SELECT *, {R('average_price_current - average_price_previous')} AS change_amount FROM g),
    i AS (SELECT *, CASE WHEN average_price_previous > 0 THEN {R('change_amount / average_price_previous', 4)} END AS change_percent FROM h)
    SELECT *, CASE WHEN change_percent IS NULL THEN 'insufficient_data' WHEN change_percent >= 0.03 THEN 'up' WHEN change_percent <= -0.03 THEN 'down' ELSE 'flat' END AS trend,
      CASE WHEN priced_product_count > 0 THEN {R('deal_count::DOUBLE / priced_product_count', 4)} ELSE 0 END AS deal_density FROM i"""


def _trends(spark, d, group_by, days):
    rows = P.with_price(snapshots(spark, d))
    daily = rows.groupBy("canonical_product_id", "source_product_id", "snapshot_date").agg(rounded(exact_avg(F.col("price")), 4).alias("price_avg"))
    return P.market_trends(read(spark, d, "part").withColumnRenamed("p_partkey", "canonical_product_id"), daily, group_by, days)


@query("market_trends_30d", _trend_sql(30, "p_type"))
def market_trends_30d(spark, d):
    return _trends(spark, d, "p_type", 30)


@query("market_trends_7d_brand", _trend_sql(7, "p_brand"))
def market_trends_7d(spark, d):
    return _trends(spark, d, "p_brand", 7)


@query("market_trends_all", _trend_sql(None, "p_type"))
def market_trends_all(spark, d):
    return _trends(spark, d, "p_type", None)


@query("trend_filters", _trend_sql(30, "p_type").replace("FROM part LEFT JOIN", "FROM (SELECT * FROM part WHERE lower(trim(p_brand)) = lower(trim(' BRAND#11 '))) LEFT JOIN"))
def trend_filters(spark, d):
    """Only whitelisted keys filter, by equality that ignores case and outer blanks."""
    rows = P.with_price(snapshots(spark, d))
    daily = rows.groupBy("canonical_product_id", "source_product_id", "snapshot_date").agg(rounded(exact_avg(F.col("price")), 4).alias("price_avg"))
    parts = read(spark, d, "part").withColumnRenamed("p_partkey", "canonical_product_id").filter(F.lower(F.trim("p_brand")) == F.lower(F.trim(F.lit(" BRAND#11 "))))
    return P.market_trends(parts, daily, "p_type", 30)
