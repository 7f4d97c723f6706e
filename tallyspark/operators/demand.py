"""Demand and supply gaps: aggregates, trends of demand, gap groups, coverage, opportunities, insights.

Every group is aggregated where its rows are before anything is shuffled; the most common value of a group is taken from counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_avg, positive, rate, rounded

#: The reference weights and limits of gap scores.
COUNT_WEIGHT, UNRESOLVED_WEIGHT, AMBIGUOUS_WEIGHT, PRESSURE_BONUS, PRESSURE = 0.4, 5.0, 2.0, 2.0, 1.2
MISSING_RATE, POOR_RATE, FEW, MANY, HIGH_SCORE, POOR_COVER, FAIR_COVER = 0.5, 0.4, 10, 50, 8.0, 0.25, 0.6


def demand_aggregates(logs: DataFrame) -> DataFrame:
    """Per query and locality: how often, from which sources, first and last seen, and the first and last raw query."""
    at = F.struct("seen_at", "event_id")
    return logs.groupBy("normalized_query", "locality_code").agg(
        F.count("*").alias("frequency"), F.count_if(F.col("source") == "search").alias("search_count"), F.count_if(F.col("source") != "search").alias("other_count"),
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"),
    )


def top_demand(aggregates: DataFrame, limit: int = 10, **where: str) -> DataFrame:
    return filtered(aggregates, **where).orderBy(F.desc("frequency"), F.desc("last_seen_at"), "normalized_query", "locality_code").limit(limit)


def filtered(rows: DataFrame, **where: str | None) -> DataFrame:
    """Equality on each given column; a column given as None isn't tested."""
    tests = [F.col(k) == v for k, v in where.items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def trending_demand(logs: DataFrame, now: str, recent_days: int = 7, previous_days: int = 7, limit: int = 10) -> DataFrame:
    """Two adjacent ranges of days counted in one pass over the logs."""
    day, today = F.col("seen_at").cast("date"), F.lit(now).cast("date")
    start = F.date_sub(today, recent_days - 1)
    g = logs.groupBy("normalized_query", "locality_code").agg(
        F.count_if((day >= start) & (day <= today)).alias("recent_frequency"), F.count_if((day >= F.date_sub(start, previous_days)) & (day < start)).alias("previous_frequency"), F.max("seen_at").alias("last_seen_at")
    )
    g = g.filter("recent_frequency > 0").withColumn("trend_delta", F.col("recent_frequency") - F.col("previous_frequency"))
    score = F.when(F.col("previous_frequency") == 0, F.col("recent_frequency").cast("double")).otherwise(rounded(F.col("recent_frequency") / F.col("previous_frequency")))
    return g.withColumn("trend_score", score).orderBy(F.desc("trend_delta"), F.desc("recent_frequency"), F.desc("last_seen_at"), "normalized_query", "locality_code").limit(limit)


def in_window(signals: DataFrame, days: int | None) -> DataFrame:
    """Signals of the last days before the latest signal (not before today)."""
    if days is None:
        return signals
    end = signals.agg(F.max(F.col("seen_at").cast("timestamp")).alias("__end"))
    rows = signals.crossJoin(F.broadcast(end))  # one row
    return rows.filter(F.col("seen_at").cast("timestamp") >= F.col("__end") - F.expr(f"INTERVAL {days - 1} DAYS")).drop("__end")


def key_of(c: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Uncategorized"))


def category_averages(signals: DataFrame) -> DataFrame:
    return signals.filter(positive(F.col("avg_price")).isNotNull()).groupBy(key_of("category_l2").alias("category_key")).agg(exact_avg(F.col("avg_price")).alias("category_avg"))


def most_common(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of those equally frequent, from counts: at most one row per group and value is ranked."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    best = n.groupBy(*keys).agg(F.max("count").alias("__most"))
    tied = n.join(best, keys).filter(F.col("count") == F.col("__most"))
    return tied.groupBy(*keys).agg(F.min(value).alias(f"common_{value}"))


def _score(count: Column, unresolved: Column, ambiguous: Column, pressed: Column) -> Column:
    return rounded(count * COUNT_WEIGHT + unresolved * UNRESOLVED_WEIGHT + ambiguous * AMBIGUOUS_WEIGHT + F.when(pressed, PRESSURE_BONUS).otherwise(0.0), 4)


def gap_type(unresolved: Column, ambiguous: Column, pressed: Column) -> Column:
    return F.when(unresolved > MISSING_RATE, "missing_supply").when(ambiguous > POOR_RATE, "poor_match_quality").when(pressed, "high_price_pressure").otherwise("normal")


def grouped(signals: DataFrame, keys: list[str]) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    g = signals.groupBy(*keys).agg(
        F.count("*").alias("signal_count"), F.count_if(F.col("source") == "search").alias("search_count"), status("resolved").alias("resolved_count"), status("ambiguous").alias("ambiguous_count"),
        status("unresolved").alias("unresolved_count"), rounded(exact_avg(positive(F.col("avg_price")))).alias("avg_price"),
    )
    return g.withColumn("unresolved_rate", rate(F.col("unresolved_count"), F.col("signal_count"))).withColumn("ambiguous_rate", rate(F.col("ambiguous_count"), F.col("signal_count")))


def _with_pressure(g: DataFrame, signals: DataFrame, keys: list[str], fall_back: str | None) -> DataFrame:
    g = g.join(most_common(signals, keys, "category_l2"), keys, "left")
    category = F.coalesce(key_of("common_category_l2") if fall_back is None else F.col("common_category_l2"), F.col(fall_back) if fall_back else F.lit(None))
    g = g.withColumn("category_key", category).join(category_averages(signals), "category_key", "left")
    pressed = F.coalesce(F.col("avg_price") > F.col("category_avg") * PRESSURE, F.lit(False))
    return g.withColumn("price_pressure", pressed).drop("category_key", "category_avg")


def gap_groups(signals: DataFrame, group_by: str) -> DataFrame:
    rows = signals.withColumn("key", key_of(group_by))
    g = _with_pressure(grouped(rows, ["key"]), rows, ["key"], "key")
    u, a, p = F.col("unresolved_rate"), F.col("ambiguous_rate"), F.col("price_pressure")
    return g.select("key", "signal_count", "unresolved_rate", "ambiguous_rate", "avg_price", F.col("common_category_l2").alias("category_l2"), _score(F.col("signal_count"), u, a, p).alias("gap_score"), gap_type(u, a, p).alias("gap_type"))


def gaps_by_locality(signals: DataFrame, group_by: str, top: int = 3) -> DataFrame:
    """The top gaps of each locality. Ranking sees one row per group, not per signal."""
    rows = signals.withColumn("key", key_of(group_by)).withColumn("locality", key_of("locality_code"))
    g = _with_pressure(grouped(rows, ["locality", "key"]), rows, ["locality", "key"], "key")
    u, a, p = F.col("unresolved_rate"), F.col("ambiguous_rate"), F.col("price_pressure")
    g = g.withColumn("gap_score", _score(F.col("signal_count"), u, a, p)).withColumn("gap_type", gap_type(u, a, p))
    w = Window.partitionBy("locality").orderBy(F.desc("gap_score"), F.desc("signal_count"), "key")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("locality", "rank", "key", "signal_count", "gap_score", "gap_type")


def coverage_by_chain(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """resolved / all per chain, within keys if given."""
    by = [*(keys or []), "chain"]
    rows = signals.withColumn("chain", key_of("chain_id"))
    g = _with_pressure(grouped(rows, by), rows, by, None)
    score = _score(F.col("signal_count"), F.col("unresolved_rate"), F.col("ambiguous_rate"), F.col("price_pressure"))
    return g.select(*by, "signal_count", "resolved_count", "ambiguous_count", "unresolved_count", rate(F.col("resolved_count"), F.col("signal_count")).alias("coverage_rate"), score.alias("gap_score"))


def opportunities(signals: DataFrame) -> DataFrame:
    """Queries with an opportunity: its type from a ladder of evidence, its confidence from count and score; normal ones are dropped."""
    rows = signals.withColumn("key", key_of("normalized_query"))
    g = _with_pressure(grouped(rows, ["key"]), rows, ["key"], "key")
    cover = coverage_by_chain(rows, ["key"]).filter("signal_count >= 2").groupBy("key").agg(F.min("coverage_rate").alias("worst"), F.max("coverage_rate").alias("best"))
    for c in ("locality_code", "chain_id"):
        g = g.join(most_common(rows, ["key"], c), "key", "left")
    g = g.join(cover, "key", "left")
    u, a, p, n = F.col("unresolved_rate"), F.col("ambiguous_rate"), F.col("price_pressure"), F.col("signal_count")
    spread = F.coalesce((F.col("worst") <= POOR_COVER) & (F.col("best") >= FAIR_COVER), F.lit(False))
    kind = F.when((n < FEW) & ((u > 0) | (a > 0)), "data_quality_gap").when(spread, "distribution_gap").when(u > MISSING_RATE, "missing_supply").when(a > POOR_RATE, "poor_match_quality").when(p, "high_price_pressure").when(n >= FEW, "emerging_interest").otherwise("normal")
    g = g.withColumn("opportunity_type", kind).filter("opportunity_type != 'normal'").withColumn("gap_score", _score(n, u, a, p))
    confidence = F.when((n >= MANY) & (F.col("gap_score") >= HIGH_SCORE), "high").when(n >= FEW, "medium").otherwise("low")
    return g.select(
        "key", "opportunity_type", confidence.alias("confidence"), F.col("common_locality_code").alias("locality_code"), F.col("common_category_l2").alias("category_l2"), F.col("common_chain_id").alias("chain_id"),
        "gap_score", "signal_count", "search_count", "unresolved_rate", "ambiguous_rate", "avg_price", "price_pressure",
    )


def insights(found: DataFrame, by: str) -> DataFrame:
    """Opportunities gathered by category or locality: count, signals, mean score, and the mean unresolved rate weighted by signals."""
    weighted = F.sum((F.col("unresolved_rate") * F.col("signal_count")).cast("decimal(18,4)")).cast("double") / F.sum("signal_count")
    return found.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("opportunity_count"), F.sum("signal_count").alias("signal_count"), rounded(exact_avg(F.col("gap_score")), 4).alias("avg_gap_score"), rounded(weighted, 4).alias("unresolved_rate"))
