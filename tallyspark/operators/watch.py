"""Watchlists: as-of price drops, alerts, recurrence, significance, nudges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_avg, rounded
from tallyspark.operators.ranking import first_few

MAJOR_PERCENT, MAJOR_AMOUNT, SOME_PERCENT, SOME_AMOUNT = 12, 1, 5, 0.2


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the latest right row of its key before its time (not after it, unless strict).

    Left and right go into one window ordered by time and each left row takes the last right row seen, so there is one shuffle and
    no pairs; a key's rows stream through, none are gathered.
    """
    cols = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.struct(*cols).alias("__left"), F.lit(None).cast(right.select(F.struct(at, *value)).schema[0].dataType).alias("__right"), F.lit(0 if strict else 1).alias("__side"))
    b = right.select(key, at, F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("__left"), F.struct(at, *value).alias("__right"), F.lit(1 if strict else 0).alias("__side"))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("__seen", F.last("__right", ignorenulls=True).over(w)).filter("__left is not null")
    return rows.select(key, at, "__left.*", F.col(f"__seen.{at}").alias(f"{at}_found"), *[F.col(f"__seen.{v}").alias(f"{v}_found") for v in value])


def previous_before(daily: DataFrame, date: str, key: str, value: str) -> DataFrame:
    """The value of the last day before `date` of each key, by max_by: combined before the shuffle."""
    return daily.filter(F.col("snapshot_date") < date).groupBy(key).agg(F.max_by(value, "snapshot_date").alias("previous_price"), F.max("snapshot_date").alias("previous_date"))


def on_date_or_latest(daily: DataFrame, key: str, date: str | None = None) -> DataFrame:
    """The day's row if a day is given, else each key's latest row."""
    if date:
        return daily.filter(F.col("snapshot_date") == date).select(key, "snapshot_date", "price_min")
    return daily.groupBy(key).agg(F.max("snapshot_date").alias("snapshot_date"), F.max_by("price_min", "snapshot_date").alias("price_min"))


def drop_alerts(watchlist: DataFrame, daily: DataFrame, date: str, key: str) -> DataFrame:
    """Entries whose product dropped against its day before, or that are at or under their target."""
    today = daily.filter(F.col("snapshot_date") == date).select(key, F.col("price_min").alias("current_price"))
    rows = watchlist.join(today, key).join(previous_before(daily, date, key, "price_min"), key, "left")
    dropped = F.coalesce(F.col("current_price") < F.col("previous_price"), F.lit(False))
    hit = F.coalesce(F.col("current_price") <= F.col("target_price"), F.lit(False))
    amount = rounded(F.col("previous_price") - F.col("current_price"))
    percent = F.when(F.col("previous_price") > 0, rounded((F.col("previous_price") - F.col("current_price")) / F.col("previous_price") * 100))
    ident = F.sha2(F.concat_ws("|", "user_id", F.col(key).cast("string"), F.lit(date), F.format_string("%.2f", "current_price")), 256)
    return rows.filter(dropped | hit).select(ident.alias("alert_id"), "user_id", key, "current_price", "previous_price", "target_price", amount.alias("drop_amount"), percent.alias("drop_percent"), hit.alias("target_hit"))


def significance(amount: Column, percent: Column) -> Column:
    none = amount.isNull() | (amount <= 0)
    return F.when(none, "none").when((percent >= MAJOR_PERCENT) | (amount >= MAJOR_AMOUNT), "major").when((percent >= SOME_PERCENT) | (amount >= SOME_AMOUNT), "significant").otherwise("minor")


def nudge(target_hit: Column, level: Column, good_deal: Column, confidence: Column, interval: Column) -> Column:
    recurring = F.coalesce((confidence >= 0.7) & (interval > 0), F.lit(False))
    return F.when(target_hit, "target_price_hit").when(level.isin("major", "significant"), "significant_drop").when(good_deal, "good_deal").when(recurring, "recurring_window")


def in_cooldown(last_sent: Column, now: Column, days: int, kind: Column, last_kind: Column) -> Column:
    """Suppressed if the last nudge was less than `days` ago and of this type, or of a type unknown."""
    recent = F.datediff(now, last_sent) < days
    return F.coalesce(kind.isNotNull() & last_sent.isNotNull() & recent & (last_kind.isNull() | (last_kind == kind)), F.lit(False))


def recurrence(daily: DataFrame, key: str, least_drop: float = 1.0) -> DataFrame:
    """Days whose least price fell by at least a percent against the day before, the mean gap between such days, and how regular the gaps are: 1 - variance / mean²."""
    w = Window.partitionBy(key).orderBy("snapshot_date")
    before = F.lag("price_min").over(w)
    rows = daily.select(key, "snapshot_date", "price_min", before.alias("before"))
    fell = (F.col("price_min") < F.col("before")) & ((F.col("before") - F.col("price_min")) / F.col("before") * 100 >= least_drop)
    rows = rows.withColumn("drop_date", F.when(F.col("before") > 0, F.when(fell, F.col("snapshot_date"))))
    last = F.last("drop_date", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.when(F.col("drop_date").isNotNull(), F.datediff("drop_date", last)))
    n, s, ss = F.count("gap"), F.sum(F.col("gap").cast("long")), F.sum((F.col("gap") * F.col("gap")).cast("long"))
    g = rows.groupBy(key).agg(F.count("*").alias("price_observation_count"), F.count("drop_date").alias("trigger_event_count"), F.max("drop_date").alias("latest_trigger_date"), n.alias("n"), s.alias("s"), ss.alias("ss"))
    mean = F.col("s") / F.col("n")
    spread = F.when(F.col("n") <= 1, 1.0).when(F.col("s") == 0, 1.0).otherwise(F.least(F.lit(1.0), (F.col("n") * F.col("ss") - F.col("s") * F.col("s")).cast("double") / (F.col("s") * F.col("s"))))
    return g.select(key, F.when(F.col("n") > 0, F.floor(mean + 0.5)).cast("long").alias("recurring_interval_days"), F.when(F.col("n") > 0, rounded(1 - spread, 4)).otherwise(0.0).alias("recurrence_confidence"), "price_observation_count", "trigger_event_count", "latest_trigger_date")


def history_stats(daily: DataFrame, key: str) -> DataFrame:
    return daily.groupBy(key).agg(rounded(exact_avg(F.col("price_min"))).alias("average_price"), rounded(F.min("price_min")).alias("lowest_price"), F.count("*").alias("days"))


def user_summaries(alerts: DataFrame) -> DataFrame:
    """Counts and the three largest drops per user."""
    top = first_few(alerts, ["user_id"], [F.desc(F.coalesce("drop_amount", F.lit(0.0))), F.col("alert_id")], F.col("alert_id"), 3, "top_alerts")
    g = alerts.groupBy("user_id").agg(F.count("*").alias("alert_count"), F.count_if("target_hit").alias("target_hits"), F.max("drop_amount").alias("largest_drop"))
    return g.join(top, "user_id", "left")


def dispatch(alerts: DataFrame, tiers: DataFrame) -> DataFrame:
    """What becomes of each alert: blocked without the entitlement, queued without a device, else sent. Delivery itself isn't done here."""
    rows = alerts.join(tiers, "user_id", "left")
    status = F.when(F.coalesce("tier", F.lit("free")) == "free", "blocked").when(F.col("device_token").isNull(), "queued").otherwise("sent")
    return rows.withColumn("notification_status", status)


def dedupe_last(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last entry of each key by order."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__e")).select(*keys, "__e.*")


def home_view(deals: DataFrame, watchlist: DataFrame, top_deals: int = 10, highlights: int = 5) -> DataFrame:
    """Sections of a home page: `deals`, the best good deals of all products (user_id null), and `watchlist`, each user's watched products with their best offer, those that reached their target first, then the best deals.

    deals: canonical_product_id, offer_id, current_price, deal_level, deal_score. watchlist: user_id, canonical_product_id, target_price. A product's offer is its cheapest (ties: smaller identifier). Watched products
    without an offer come last, without a price. Gives section, user_id, place, canonical_product_id, price, deal_level, deal_score, target_hit.
    """
    best = deals.groupBy("canonical_product_id").agg(F.min(F.struct("current_price", "offer_id", "deal_level", "deal_score")).alias("b")).select("canonical_product_id", F.col("b.current_price").alias("price"), "b.deal_level", "b.deal_score")
    good = best.filter("deal_level = 'good'").orderBy(F.desc("deal_score"), "canonical_product_id").limit(top_deals)
    first = Window.orderBy(F.desc("deal_score"), "canonical_product_id")  # over the few rows of the report
    front = good.select(F.lit("deals").alias("section"), F.lit(None).cast("string").alias("user_id"), F.row_number().over(first).alias("place"), "canonical_product_id", "price", "deal_level", "deal_score", F.lit(None).cast("boolean").alias("target_hit"))
    rows = watchlist.join(best, "canonical_product_id", "left").withColumn("target_hit", F.coalesce(F.col("price") <= F.col("target_price"), F.lit(False)))
    w = Window.partitionBy("user_id").orderBy(F.desc("target_hit"), F.desc_nulls_last("deal_score"), "canonical_product_id")
    own = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= highlights)
    return front.unionByName(own.select(F.lit("watchlist").alias("section"), "user_id", "place", "canonical_product_id", "price", "deal_level", "deal_score", "target_hit"))
