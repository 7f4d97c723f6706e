"""Queries over demand and gap signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import demand as D
from tallyspark.plans.adapter import SIGNALS, signals, sql_avg, sql_round
from tallyspark.plans.registry import query

R = sql_round
AGG = f"""{SIGNALS}, aggregates AS (
  SELECT normalized_query, locality_code, count(*) AS frequency, count(*) FILTER (source = 'search') AS search_count, count(*) FILTER (source <> 'search') AS other_count,
    min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_min(event_id, (seen_at, event_id)) AS first_event, arg_max(event_id, (seen_at, event_id)) AS last_event FROM signals GROUP BY ALL
)"""


@query("demand_aggregates", f"WITH {AGG} SELECT * FROM aggregates")
def demand_aggregates(spark, d):
    return D.demand_aggregates(signals(spark, d))


@query("top_demand", f"WITH {AGG} SELECT * FROM aggregates ORDER BY frequency DESC, last_seen_at DESC, normalized_query, locality_code LIMIT 10")
def top_demand(spark, d):
    return D.top_demand(D.demand_aggregates(signals(spark, d)))


@query("demand_location_filter", f"WITH {AGG} SELECT * FROM aggregates WHERE locality_code = 'loc-2' ORDER BY frequency DESC, last_seen_at DESC, normalized_query LIMIT 5")
def demand_location_filter(spark, d):
    return D.top_demand(D.demand_aggregates(signals(spark, d)), 5, locality_code="loc-2", normalized_query=None)


@query("trending_demand", f"""WITH {SIGNALS}, g AS (SELECT normalized_query, locality_code,
    count(*) FILTER (seen_at::DATE BETWEEN DATE '2024-01-20' - 6 AND DATE '2024-01-20') AS recent_frequency, count(*) FILTER (seen_at::DATE >= DATE '2024-01-20' - 13 AND seen_at::DATE < DATE '2024-01-20' - 6) AS previous_frequency,
    max(seen_at) AS last_seen_at FROM signals GROUP BY ALL)
  SELECT *, recent_frequency - previous_frequency AS trend_delta, CASE WHEN previous_frequency = 0 THEN recent_frequency::DOUBLE ELSE {R('recent_frequency::DOUBLE / previous_frequency')} END AS trend_score
  FROM g WHERE recent_frequency > 0 ORDER BY trend_delta DESC, recent_frequency DESC, last_seen_at DESC, normalized_query, locality_code LIMIT 10""")
def trending_demand(spark, d):
    return D.trending_demand(signals(spark, d), "2024-01-20")


def _window(days):
    return f"""{SIGNALS}, windowed AS (SELECT *, 'x' AS one FROM signals WHERE seen_at::TIMESTAMP >= (SELECT max(seen_at::TIMESTAMP) FROM signals) - INTERVAL {days - 1} DAYS),
averages AS (SELECT category_l2 AS category_key, {sql_avg('avg_price')} AS category_avg FROM windowed WHERE avg_price > 0 GROUP BY 1)"""


@query("recent_window", f"WITH {_window(7)} SELECT event_id, seen_at FROM windowed")
def recent_window(spark, d):
    return D.in_window(signals(spark, d), 7).select("event_id", "seen_at")


@query("category_average_map", f"WITH {_window(30)} SELECT * FROM averages")
def category_average_map(spark, d):
    return D.category_averages(D.in_window(signals(spark, d), 30))


def _groups(keys: str, name: str, fall_back: str, extra: str = "") -> str:
    """Groups of windowed signals with rates, the most common category and price pressure."""
    return f"""{name}_n AS (SELECT {keys}, count(*) AS signal_count, count(*) FILTER (source = 'search') AS search_count, count(*) FILTER (status = 'resolved') AS resolved_count,
    count(*) FILTER (status = 'ambiguous') AS ambiguous_count, count(*) FILTER (status = 'unresolved') AS unresolved_count, {R(sql_avg('CASE WHEN avg_price > 0 THEN avg_price END'))} AS avg_price FROM {extra or 'keyed'} GROUP BY ALL),
  {name}_c AS (SELECT {keys}, category_l2 FROM (SELECT {keys}, category_l2, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, category_l2) AS k FROM {extra or 'keyed'} WHERE category_l2 IS NOT NULL GROUP BY {keys}, category_l2) WHERE k = 1),
  {name} AS (SELECT *, coalesce(avg_price > category_avg * 1.2::DOUBLE, false) AS price_pressure, {R('unresolved_count::DOUBLE / signal_count', 4)} AS unresolved_rate, {R('ambiguous_count::DOUBLE / signal_count', 4)} AS ambiguous_rate
    FROM {name}_n LEFT JOIN {name}_c USING ({keys}) LEFT JOIN averages ON category_key = coalesce(category_l2, {fall_back}))"""


SCORE = R("signal_count * 0.4::DOUBLE + unresolved_rate * 5.0::DOUBLE + ambiguous_rate * 2.0::DOUBLE + CASE WHEN price_pressure THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END", 4)
TYPE = "CASE WHEN unresolved_rate > 0.5 THEN 'missing_supply' WHEN ambiguous_rate > 0.4 THEN 'poor_match_quality' WHEN price_pressure THEN 'high_price_pressure' ELSE 'normal' END"


def _gap_sql(column: str) -> str:
    return f"""WITH {_window(30)}, keyed AS (SELECT *, coalesce({column}, 'Uncategorized') AS key FROM windowed), {_groups('key', 'g', 'key')}
      SELECT key, signal_count, unresolved_rate, ambiguous_rate, avg_price, category_l2, {SCORE} AS gap_score, {TYPE} AS gap_type FROM g"""


@query("gap_groups_query", _gap_sql("normalized_query"))
def gap_groups_query(spark, d):
    return D.gap_groups(D.in_window(signals(spark, d), 30), "normalized_query")


@query("gap_groups_chain", _gap_sql("chain_id"))
def gap_groups_chain(spark, d):
    return D.gap_groups(D.in_window(signals(spark, d), 30), "chain_id")


@query("gap_groups_locality_nested", f"""WITH {_window(30)}, keyed AS (SELECT *, normalized_query AS key, locality_code AS locality FROM windowed), {_groups('locality, key', 'g', 'key')}
  SELECT locality, rank, key, signal_count, gap_score, gap_type FROM (SELECT *, row_number() OVER (PARTITION BY locality ORDER BY gap_score DESC, signal_count DESC, key)::INTEGER AS rank
    FROM (SELECT *, {SCORE} AS gap_score, {TYPE} AS gap_type FROM g)) WHERE rank <= 3""")
def gap_groups_locality_nested(spark, d):
    return D.gaps_by_locality(D.in_window(signals(spark, d), 30), "normalized_query")


CHAIN = f"""keyed AS (SELECT *, normalized_query AS key, coalesce(chain_id, 'Uncategorized') AS chain FROM windowed)"""


@query("coverage_by_chain", f"WITH {_window(30)}, {CHAIN}, {_groups('chain', 'g', repr('Uncategorized'))} SELECT chain, signal_count, resolved_count, ambiguous_count, unresolved_count, {R('resolved_count::DOUBLE / signal_count', 4)} AS coverage_rate, {SCORE} AS gap_score FROM g")
def coverage_by_chain(spark, d):
    return D.coverage_by_chain(D.in_window(signals(spark, d), 30))


def _common(c: str) -> str:
    return f"SELECT key, {c} FROM (SELECT key, {c}, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, {c}) AS k FROM keyed WHERE {c} IS NOT NULL GROUP BY key, {c}) WHERE k = 1"


OPPORTUNITIES = f"""{_window(30)}, {CHAIN}, {_groups('key', 'g', 'key')}, per_chain AS (SELECT key, chain, count(*) AS n, {R("count(*) FILTER (status = 'resolved')::DOUBLE / count(*)", 4)} AS cover FROM keyed GROUP BY ALL),
spread AS (SELECT key, min(cover) AS worst, max(cover) AS best FROM per_chain WHERE n >= 2 GROUP BY key),
typed AS (SELECT *, {SCORE} AS gap_score, CASE WHEN signal_count < 10 AND (unresolved_rate > 0 OR ambiguous_rate > 0) THEN 'data_quality_gap' WHEN worst <= 0.25 AND best >= 0.6 THEN 'distribution_gap'
  WHEN unresolved_rate > 0.5 THEN 'missing_supply' WHEN ambiguous_rate > 0.4 THEN 'poor_match_quality' WHEN price_pressure THEN 'high_price_pressure' WHEN signal_count >= 10 THEN 'emerging_interest' ELSE 'normal' END AS opportunity_type
  FROM g LEFT JOIN spread USING (key) LEFT JOIN ({_common('locality_code')}) USING (key) LEFT JOIN ({_common('chain_id')}) USING (key)),
opportunities AS (SELECT key, opportunity_type, CASE WHEN signal_count >= 50 AND gap_score >= 8 THEN 'high' WHEN signal_count >= 10 THEN 'medium' ELSE 'low' END AS confidence, locality_code, category_l2, chain_id, gap_score,
  signal_count, search_count, unresolved_rate, ambiguous_rate, avg_price, price_pressure FROM typed WHERE opportunity_type <> 'normal')"""


@query("opportunity_reports", f"WITH {OPPORTUNITIES} SELECT * FROM opportunities")
def opportunity_reports(spark, d):
    return D.opportunities(D.in_window(signals(spark, d), 30))


@query("opportunity_filters", f"WITH {OPPORTUNITIES} SELECT * FROM opportunities WHERE category_l2 = 'cat-3' ORDER BY gap_score DESC, key LIMIT 20")
def opportunity_filters(spark, d):
    return D.filtered(D.opportunities(D.in_window(signals(spark, d), 30)), category_l2="cat-3", chain_id=None).orderBy(F.desc("gap_score"), "key").limit(20)


def _insight(by: str) -> str:
    return f"""WITH {OPPORTUNITIES} SELECT {by}, count(*) AS opportunity_count, sum(signal_count)::BIGINT AS signal_count, {R(sql_avg('gap_score'), 4)} AS avg_gap_score,
      {R('sum((unresolved_rate * signal_count)::DECIMAL(18,4))::DOUBLE / sum(signal_count)', 4)} AS unresolved_rate FROM opportunities WHERE {by} IS NOT NULL GROUP BY 1"""


@query("insights_by_category", _insight("category_l2"))
def insights_by_category(spark, d):
    return D.insights(D.opportunities(D.in_window(signals(spark, d), 30)), "category_l2")


@query("insights_by_locality", _insight("locality_code"))
def insights_by_locality(spark, d):
    return D.insights(D.opportunities(D.in_window(signals(spark, d), 30)), "locality_code")


@query("insights_by_chain", _insight("chain_id"))
def insights_by_chain(spark, d):
    return D.insights(D.opportunities(D.in_window(signals(spark, d), 30)), "chain_id")


@query("mode_with_ties", f"WITH {SIGNALS} SELECT locality_code, status AS common_status FROM (SELECT *, row_number() OVER (PARTITION BY locality_code ORDER BY n DESC, status) AS k FROM (SELECT locality_code, status, count(*) AS n FROM signals GROUP BY ALL)) WHERE k = 1")
def mode_with_ties(spark, d):
    return D.most_common(signals(spark, d), ["locality_code"], "status")


@query("unmatched_capture", f"WITH {SIGNALS} SELECT sha256(concat_ws('|', normalized_query, locality_code, seen_at)) AS signal_id, normalized_query, locality_code, seen_at FROM signals WHERE status = 'unresolved'")
def unmatched_capture(spark, d):
    """Only what found nothing, under an identifier that a repeated event shares."""
    rows = signals(spark, d).filter("status = 'unresolved'")
    return rows.select(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("normalized_query", "locality_code", "seen_at")]), 256).alias("signal_id"), "normalized_query", "locality_code", "seen_at")
