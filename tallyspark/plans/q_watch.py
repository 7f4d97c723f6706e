"""Queries over watchlists: customers watch parts chosen by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import prices as P
from tallyspark.operators import watch as W
from tallyspark.functions.money import rounded
from tallyspark.plans.adapter import SNAPSHOTS, read, snapshots, sql_avg, sql_round
from tallyspark.plans.registry import query

R, KEY, DAY = sql_round, "canonical_product_id", "2000-01-05"

BASE = f"""{SNAPSHOTS}, daily AS (
  SELECT canonical_product_id, snapshot_date, {R(sql_avg('price'), 4)} AS price_avg, {R('min(price)', 4)} AS price_min FROM priced GROUP BY ALL
), watchlist AS (
  SELECT 'user-' || c_custkey AS user_id, (c_custkey * 7) % (SELECT count(*) FROM part) + 1 AS canonical_product_id,
    CASE WHEN c_custkey % 3 = 0 THEN {R('c_acctbal')} END AS target_price, CASE WHEN c_custkey % 5 <> 0 THEN 'device-' || c_custkey END AS device_token FROM customer
)"""


def daily(spark, d):
    return P.daily_prices(snapshots(spark, d), KEY)


def watchlist(spark, d):
    c = read(spark, d, "customer")
    n = read(spark, d, "part").count()
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("user-"), k).alias("user_id"), ((k * 7) % n + 1).alias(KEY), F.when(k % 3 == 0, rounded(F.col("c_acctbal"))).alias("target_price"), F.when(k % 5 != 0, F.concat(F.lit("device-"), k)).alias("device_token"))


ALERTS = f"""{BASE}, today AS (SELECT canonical_product_id, price_min AS current_price FROM daily WHERE snapshot_date = '{DAY}'),
before AS (SELECT canonical_product_id, arg_max(price_min, snapshot_date) AS previous_price, max(snapshot_date) AS previous_date FROM daily WHERE snapshot_date < '{DAY}' GROUP BY 1),
alerts AS (SELECT sha256(concat_ws('|', user_id, canonical_product_id, '{DAY}', printf('%.2f', current_price))) AS alert_id, user_id, canonical_product_id, current_price, previous_price, target_price,
  {R('previous_price - current_price')} AS drop_amount, CASE WHEN previous_price > 0 THEN {R('(previous_price - current_price) / previous_price * 100')} END AS drop_percent, coalesce(current_price <= target_price, false) AS target_hit
  FROM watchlist JOIN today USING (canonical_product_id) LEFT JOIN before USING (canonical_product_id) WHERE coalesce(current_price < previous_price, false) OR coalesce(current_price <= target_price, false))"""


@query("price_drop_alerts", f"WITH {ALERTS} SELECT * FROM alerts")
def price_drop_alerts(spark, d):
    return W.drop_alerts(watchlist(spark, d), daily(spark, d), DAY, KEY)


@query("as_of_join", f"""WITH {BASE}, l AS (SELECT canonical_product_id, snapshot_date, source_product_id, price FROM priced WHERE snapshot_date >= '2001-01-01')
  SELECT l.canonical_product_id, l.snapshot_date, l.source_product_id, l.price, r.snapshot_date AS snapshot_date_found, r.price_min AS price_min_found FROM l ASOF LEFT JOIN daily r ON l.canonical_product_id = r.canonical_product_id AND l.snapshot_date > r.snapshot_date""")
def as_of_join(spark, d):
    rows = P.with_price(snapshots(spark, d)).filter("snapshot_date >= '2001-01-01'").select(KEY, "snapshot_date", "source_product_id", "price")
    return W.as_of(rows, daily(spark, d), KEY, "snapshot_date", ["price_min"])


@query("previous_price_index", f"WITH {ALERTS} SELECT * FROM before")
def previous_price_index(spark, d):
    return W.previous_before(daily(spark, d), DAY, KEY, "price_min")


@query("dated_price", f"WITH {BASE} SELECT canonical_product_id, snapshot_date, price_min FROM daily WHERE snapshot_date = '{DAY}'")
def dated_price(spark, d):
    return W.on_date_or_latest(daily(spark, d), KEY, DAY)


@query("latest_price", f"WITH {BASE} SELECT canonical_product_id, max(snapshot_date) AS snapshot_date, arg_max(price_min, snapshot_date) AS price_min FROM daily GROUP BY 1")
def latest_price(spark, d):
    return W.on_date_or_latest(daily(spark, d), KEY)


LEVEL = "CASE WHEN drop_amount IS NULL OR drop_amount <= 0 THEN 'none' WHEN drop_percent >= 12 OR drop_amount >= 1 THEN 'major' WHEN drop_percent >= 5 OR drop_amount >= 0.2 THEN 'significant' ELSE 'minor' END"


@query("drop_significance", f"WITH {ALERTS} SELECT alert_id, user_id, {LEVEL} AS level FROM alerts")
def drop_significance(spark, d):
    return price_drop_alerts(spark, d).select("alert_id", "user_id", W.significance(F.col("drop_amount"), F.col("drop_percent")).alias("level"))


RECUR = f"""{BASE}, lagged AS (SELECT canonical_product_id, snapshot_date, price_min, lag(price_min) OVER w AS before FROM daily WINDOW w AS (PARTITION BY canonical_product_id ORDER BY snapshot_date)),
marked AS (SELECT *, CASE WHEN before > 0 AND price_min < before AND (before - price_min) / before * 100 >= 1 THEN snapshot_date END AS drop_date FROM lagged),
gaps AS (SELECT canonical_product_id, drop_date, date_diff('day', (lag(drop_date) OVER (PARTITION BY canonical_product_id ORDER BY drop_date))::DATE, drop_date::DATE) AS gap FROM marked WHERE drop_date IS NOT NULL),
gathered AS (SELECT canonical_product_id, count(*) AS trigger_event_count, max(drop_date) AS latest_trigger_date, count(gap) AS n, sum(gap) AS s, sum(gap * gap) AS ss FROM gaps GROUP BY 1),
recurring AS (SELECT canonical_product_id, CASE WHEN n > 0 THEN floor(s::DOUBLE / n + 0.5)::BIGINT END AS recurring_interval_days,
  CASE WHEN n > 0 THEN {R('1 - CASE WHEN n <= 1 OR s = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (n * ss - s * s)::DOUBLE / (s * s)::DOUBLE) END', 4)} ELSE 0 END AS recurrence_confidence,
  price_observation_count, coalesce(trigger_event_count, 0) AS trigger_event_count, latest_trigger_date
  FROM (SELECT canonical_product_id, count(*) AS price_observation_count FROM daily GROUP BY 1) LEFT JOIN gathered USING (canonical_product_id))"""


@query("recurring_patterns", f"WITH {RECUR} SELECT * FROM recurring")
def recurring_patterns(spark, d):
    return W.recurrence(daily(spark, d), KEY)


@query("history_stats", f"WITH {BASE} SELECT canonical_product_id, {R(sql_avg('price_min'))} AS average_price, {R('min(price_min)')} AS lowest_price, count(*) AS days FROM daily GROUP BY 1")
def history_stats(spark, d):
    return W.history_stats(daily(spark, d), KEY)


@query("watchlist_evaluation", f"""{ALERTS.join(['WITH ', ''])}, recurring AS ({RECUR.split('recurring AS (', 1)[1].rsplit(')', 1)[0].replace('gathered', '(SELECT canonical_product_id, count(*) AS trigger_event_count, max(drop_date) AS latest_trigger_date, count(gap) AS n, sum(gap) AS s, sum(gap * gap) AS ss FROM gaps GROUP BY 1)')}),
  stats AS (SELECT canonical_product_id, {R(sql_avg('price_min'))} AS average_price FROM daily GROUP BY 1), leveled AS (SELECT *, {LEVEL} AS level, coalesce(current_price <= average_price * 0.8::DOUBLE, false) AS good_deal FROM alerts JOIN stats USING (canonical_product_id) JOIN recurring USING (canonical_product_id))
  SELECT user_id, canonical_product_id, level, good_deal, CASE WHEN target_hit THEN 'target_price_hit' WHEN level IN ('major', 'significant') THEN 'significant_drop' WHEN good_deal THEN 'good_deal'
    WHEN recurrence_confidence >= 0.7 AND recurring_interval_days > 0 THEN 'recurring_window' END AS nudge_type FROM leveled""".replace("before AS (SELECT canonical_product_id, arg_max", "lagged AS (SELECT canonical_product_id, snapshot_date, price_min, lag(price_min) OVER w AS before FROM daily WINDOW w AS (PARTITION BY canonical_product_id ORDER BY snapshot_date)), marked AS (SELECT *, CASE WHEN before > 0 AND price_min < before AND (before - price_min) / before * 100 >= 1 THEN snapshot_date END AS drop_date FROM lagged), gaps AS (SELECT canonical_product_id, drop_date, date_diff('day', (lag(drop_date) OVER (PARTITION BY canonical_product_id ORDER BY drop_date))::DATE, drop_date::DATE) AS gap FROM marked WHERE drop_date IS NOT NULL), before AS (SELECT canonical_product_id, arg_max"))
def watchlist_evaluation(spark, d):
    """Alert, history and recurrence of each watched product, and the one nudge they give."""
    days = daily(spark, d)
    rows = W.drop_alerts(watchlist(spark, d), days, DAY, KEY).join(W.history_stats(days, KEY), KEY).join(W.recurrence(days, KEY), KEY)
    rows = rows.withColumn("level", W.significance(F.col("drop_amount"), F.col("drop_percent"))).withColumn("good_deal", F.coalesce(F.col("current_price") <= F.col("average_price") * 0.8, F.lit(False)))
    return rows.select("user_id", KEY, "level", "good_deal", W.nudge(F.col("target_hit"), F.col("level"), F.col("good_deal"), F.col("recurrence_confidence"), F.col("recurring_interval_days")).alias("nudge_type"))


@query("alert_dispatch", f"WITH {ALERTS} SELECT alert_id, user_id, CASE WHEN coalesce(tier, 'free') = 'free' THEN 'blocked' WHEN device_token IS NULL THEN 'queued' ELSE 'sent' END AS notification_status FROM alerts LEFT JOIN (SELECT DISTINCT user_id, device_token FROM watchlist) USING (user_id) LEFT JOIN (SELECT 'user-' || c_custkey AS user_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'premium' END AS tier FROM customer) USING (user_id)")
def alert_dispatch(spark, d):
    alerts = price_drop_alerts(spark, d).join(watchlist(spark, d).select("user_id", "device_token").distinct(), "user_id", "left")
    tiers = read(spark, d, "customer").select(F.concat(F.lit("user-"), "c_custkey").alias("user_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "premium").alias("tier"))
    return W.dispatch(alerts, tiers).select("alert_id", "user_id", "notification_status")


@query("watchlist_summaries", f"""WITH {ALERTS} SELECT user_id, count(*) AS alert_count, count(*) FILTER (target_hit) AS target_hits, max(drop_amount) AS largest_drop,
  array_to_string(list_slice(list(alert_id ORDER BY coalesce(drop_amount, 0) DESC, alert_id), 1, 3), ',') AS top_alerts FROM alerts GROUP BY 1""")
def watchlist_summaries(spark, d):
    return W.user_summaries(price_drop_alerts(spark, d)).withColumn("top_alerts", F.array_join("top_alerts", ","))


@query("watchlist_dedupe_last", f"WITH {BASE} SELECT canonical_product_id, arg_max(user_id, user_id) AS user_id, arg_max(coalesce(target_price, -1), user_id) AS target FROM watchlist GROUP BY 1")
def watchlist_dedupe_last(spark, d):
    rows = watchlist(spark, d).select(KEY, "user_id", F.coalesce("target_price", F.lit(-1.0)).alias("target"))
    return W.dedupe_last(rows, [KEY], "user_id")


@query("nudge_cooldown", """WITH e AS (SELECT user_id, event_id, ts::DATE AS day, event_type AS kind FROM events), l AS (SELECT *, lag(day) OVER w AS last_day, lag(kind) OVER w AS last_kind FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, coalesce(last_day IS NOT NULL AND date_diff('day', last_day, day) < 3 AND (last_kind IS NULL OR last_kind = kind), false) AS suppressed FROM l""")
def nudge_cooldown(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind"))
    e = e.withColumn("last_day", F.lag("day").over(w)).withColumn("last_kind", F.lag("kind").over(w))
    return e.select("event_id", W.in_cooldown(F.col("last_day"), F.col("day"), 3, F.col("kind"), F.col("last_kind")).alias("suppressed"))


HOME = f"""WITH {{deals}}, best AS (SELECT canonical_product_id, b.current_price AS price, b.deal_level AS deal_level, b.deal_score AS deal_score FROM (SELECT canonical_product_id, min({{{{'current_price': current_price, 'offer_id': offer_id, 'deal_level': deal_level, 'deal_score': deal_score}}}}) AS b FROM deals GROUP BY 1)),
  watchlist AS (SELECT 'user-' || (c_custkey % 100) AS user_id, (c_custkey * 7) % (SELECT count(*) FROM part) + 1 AS canonical_product_id, CASE WHEN c_custkey % 3 = 0 THEN {R('c_acctbal')} END AS target_price FROM customer),
  w AS (SELECT *, coalesce(price <= target_price, false) AS target_hit FROM watchlist LEFT JOIN best USING (canonical_product_id)), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY target_hit DESC, deal_score DESC NULLS LAST, canonical_product_id)::INTEGER AS place FROM w)
  SELECT 'deals' AS section, NULL::VARCHAR AS user_id, place, canonical_product_id, price, deal_level, deal_score, NULL::BOOLEAN AS target_hit FROM (SELECT *, row_number() OVER (ORDER BY deal_score DESC, canonical_product_id)::INTEGER AS place FROM best WHERE deal_level = 'good') WHERE place <= 10
  UNION ALL SELECT 'watchlist', user_id, place, canonical_product_id, price, deal_level, deal_score, target_hit FROM o WHERE place <= 5"""


def _home_sql() -> str:
    from tallyspark.plans.q_prices import DEALS

    return HOME.format(deals=DEALS)


@query("home_view", _home_sql())
def home_view(spark, d):
    """Top deals of all, and of each of a hundred users the five watched products that matter most."""
    from tallyspark.plans.q_prices import _deals

    k = F.col("c_custkey")
    own = watchlist(spark, d).withColumn("c_custkey", F.regexp_extract("user_id", r"(\d+)$", 1).cast("long")).withColumn("user_id", F.concat(F.lit("user-"), k % 100))
    return W.home_view(_deals(spark, d), own.select("user_id", KEY, "target_price"))
