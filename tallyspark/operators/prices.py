"""Daily aggregates, latest observations, current offers, price lookup, deals and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import effective_price, exact_avg, positive, rate, rounded

GOOD_DEAL, EXPENSIVE, UP, DOWN = 0.8, 1.2, 0.03, -0.03


def with_price(rows: DataFrame, strict: bool = True) -> DataFrame:
    return rows.withColumn("price", effective_price(F.col("retail_price"), F.col("promo_price"), strict))


def daily_prices(snapshots: DataFrame, key: str = "source_product_id") -> DataFrame:
    """Average, least and greatest price (4 places), stores and observations per key and day: one partial and one final aggregation."""
    rows = with_price(snapshots, strict=False)
    stores = F.countDistinct(F.concat_ws("|", F.coalesce("locality_code", F.lit("")), F.coalesce("store_name", F.lit(""))))
    return rows.groupBy(key, "snapshot_date").agg(
        rounded(exact_avg(F.col("price")), 4).alias("price_avg"), rounded(F.min("price"), 4).alias("price_min"), rounded(F.max("price"), 4).alias("price_max"), stores.alias("store_count"), F.count("*").alias("snapshot_count")
    )


def category_prices(snapshots: DataFrame) -> DataFrame:
    rows = with_price(snapshots, strict=False)
    return rows.groupBy("category_code", "snapshot_date").agg(
        rounded(exact_avg(F.col("price")), 4).alias("avg_price"), rounded(F.min("price"), 4).alias("min_price"), rounded(F.max("price"), 4).alias("max_price"), F.countDistinct("source_product_id").alias("product_count"), F.count("*").alias("snapshot_count")
    )


def missing_days(built: DataFrame, snapshots: DataFrame, key: str = "source_product_id") -> DataFrame:
    """Idempotent build: aggregates of the days that `built` doesn't hold."""
    days = built.select("snapshot_date").distinct()
    return daily_prices(snapshots.join(days, "snapshot_date", "left_anti"), key)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the columns of order, by max over a struct: rows are combined before the shuffle, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*keys, "__best.*").select(*rows.columns)


def current_offers(snapshots: DataFrame, *only: str) -> DataFrame:
    """The latest observation of each source product that has a price. only: the columns of the result; the others don't move."""
    rows = with_price(snapshots)
    if only:
        made_of = {"offer_id": (), "chain_id": ("locality_code",), "store_id": ("store_name",), "current_price": (), "is_sale": ("retail_price", "promo_price")}
        needed = ["source_product_id", "snapshot_date", "ingested_at", "snapshot_id", "canonical_product_id", *(x for c in only for x in made_of.get(c, (c,))), "price"]
        rows = rows.select(*dict.fromkeys(needed))
    last = latest_per_key(rows, ["source_product_id"], ["snapshot_date", "ingested_at", "snapshot_id"]).filter("price IS NOT NULL")
    out = {c: F.col(c) for c in ("canonical_product_id", "source_product_id", "category_code", "brand", "product_name", "retail_price", "promo_price", "snapshot_date")}
    out |= {"offer_id": F.concat(F.lit("offer_"), F.col("source_product_id")), "chain_id": F.col("locality_code"), "store_id": F.col("store_name"), "current_price": F.col("price")}
    out["is_sale"] = (F.col("promo_price") > 0) & (F.col("promo_price") < F.col("retail_price"))
    every = ("offer_id", "canonical_product_id", "source_product_id", "chain_id", "store_id", "category_code", "brand", "product_name", "current_price", "retail_price", "promo_price", "is_sale", "snapshot_date")
    return last.select(*[out[c].alias(c) for c in only or every])


def latest_prices(snapshots: DataFrame) -> DataFrame:
    """Products, chains and prices of the current offers."""
    return current_offers(snapshots, "canonical_product_id", "chain_id", "current_price")


def offer_summary(offers: DataFrame) -> DataFrame:
    """Per canonical product; the cheapest offer by price, then the later date, then the identifier."""
    newest_first = F.datediff(F.lit("9999-12-31"), F.col("snapshot_date"))
    cheapest = F.min(F.struct(F.col("current_price"), newest_first.alias("age"), F.col("offer_id"), F.col("chain_id"), F.col("source_product_id")))
    return (
        offers.groupBy("canonical_product_id")
        .agg(rounded(F.min("current_price")).alias("min_current_price"), rounded(F.max("current_price")).alias("max_current_price"), rounded(exact_avg(F.col("current_price"))).alias("avg_current_price"),
             F.count("*").alias("offer_count"), F.array_sort(F.collect_set("chain_id")).alias("available_chains"), cheapest.alias("c"), F.max("snapshot_date").alias("snapshot_date"))
        .select("canonical_product_id", "min_current_price", "max_current_price", "avg_current_price", "offer_count", F.size("available_chains").cast("long").alias("chain_count"), "available_chains",
                F.col("c.offer_id").alias("cheapest_offer_id"), F.col("c.chain_id").alias("cheapest_chain_id"), F.col("c.current_price").alias("cheapest_price"), "snapshot_date")
    )


def is_stale(date: Column, as_of: str, max_age_days: int) -> Column:
    """Older than max_age_days on the day as_of; a missing or malformed date is stale."""
    day = F.try_to_date(date, "yyyy-MM-dd")
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), day) > max_age_days, F.lit(True))


def price_lookup(requested: DataFrame, offers: DataFrame, as_of: str, max_age_days: int = 30, chains: list[str] | None = None, stores: list[str] | None = None) -> DataFrame:
    """Status of each requested canonical product: priced (some fresh record), stale (only old ones) or missing, with its best record.
    Records rank by staleness, price, later date, source product."""
    rows = offers.join(requested, "canonical_product_id", "left_semi")
    if chains:
        rows = rows.filter(F.col("chain_id").isin(chains))
    if stores:
        rows = rows.filter(F.col("store_id").isin(stores))
    rows = rows.withColumn("is_stale", is_stale(F.col("snapshot_date"), as_of, max_age_days))
    age = F.datediff(F.lit("9999-12-31"), F.col("snapshot_date"))
    best = rows.groupBy("canonical_product_id").agg(F.min(F.struct("is_stale", "current_price", age.alias("age"), "source_product_id", "snapshot_date")).alias("b"), F.count("*").alias("record_count"), F.count_if(~F.col("is_stale")).alias("fresh_count"))
    out = requested.join(best, "canonical_product_id", "left")
    status = F.when(F.coalesce("record_count", F.lit(0)) == 0, "missing").when(F.col("fresh_count") > 0, "priced").otherwise("stale")
    return out.select("canonical_product_id", status.alias("price_status"), F.col("b.current_price").alias("best_price"), F.col("b.source_product_id").alias("best_source_product_id"), F.coalesce("record_count", F.lit(0)).alias("record_count"))


def lookup_summary(items: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("price_status") == s)
    return items.agg(F.count("*").alias("requested_count"), is_("priced").alias("priced_count"), is_("stale").alias("stale_count"), is_("missing").alias("missing_count"))


def deal_columns(current: Column, average: Column, least: Column, target: Column | None = None) -> dict[str, Column]:
    """How a current price stands to the rounded average of what was observed."""
    diff = F.when(average > 0, rounded((current - average) / average, 4)).otherwise(0.0)
    level = F.when(current.isNull() | average.isNull(), "normal").when(current <= average * GOOD_DEAL, "good").when(current >= average * EXPENSIVE, "expensive").otherwise("normal")
    half = F.least(F.abs(diff), F.lit(0.5)) / 2
    score = F.when(level == "good", rounded(0.75 + half, 4)).when(level == "expensive", rounded(0.25 - half, 4)).otherwise(0.5)
    percent = F.floor(F.abs(diff) * 100 + 0.5).cast("string")
    reason = (
        F.when(current.isNull() | average.isNull(), "not enough recent price history")
        .when(level == "good", F.concat(F.lit("price is "), percent, F.lit("% below recent average")))
        .when(level == "expensive", F.concat(F.lit("price is "), percent, F.lit("% above recent average")))
        .otherwise("price is close to recent average")
    )
    hit = F.coalesce(current <= target, F.lit(False)) if target is not None else F.lit(False)
    known = current.isNotNull() & average.isNotNull()
    return {"deal_level": level, "deal_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "reason": reason, "target_hit": hit, "avg_price": F.when(known, average), "min_price": F.when(known, least), "percent_difference": F.when(known, diff)}


def deals(offers: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Each offer against all offers of its canonical product, itself included. Statistics are aggregated and joined back, so no group is gathered."""
    stats = offers.groupBy("canonical_product_id").agg(rounded(exact_avg(positive(F.col("current_price")))).alias("a"), rounded(F.min(positive(F.col("current_price")))).alias("m"))
    rows = offers.join(stats, "canonical_product_id")
    if targets is not None:
        rows = rows.join(targets, "canonical_product_id", "left")
    cols = deal_columns(positive(F.col("current_price")), F.col("a"), F.col("m"), F.col("target_price") if targets is not None else None)
    return rows.select("offer_id", "canonical_product_id", "current_price", *[c.alias(k) for k, c in cols.items()])


def market_trends(products: DataFrame, daily: DataFrame, group_by: str, days: int | None = 30) -> DataFrame:
    """Groups of products: mean of each product's latest price in the window and in the window before, and the change between them.

    products: canonical_product_id and group columns. daily: canonical_product_id, snapshot_date, price_avg. days None: all
    history, where the earlier price is the one before a product's latest day.
    """
    rows = daily.filter(positive(F.col("price_avg")).isNotNull())
    end = rows.agg(F.max("snapshot_date").alias("end"))
    rows = rows.crossJoin(F.broadcast(end))  # one row
    by_day = rows.groupBy("canonical_product_id", "snapshot_date", "end").agg(rounded(exact_avg(F.col("price_avg"))).alias("p"), F.sum(F.col("price_avg").cast("decimal(18,4)")).alias("total"), F.count("*").alias("n"), F.min("price_avg").alias("low"))
    if days:
        day = F.col("snapshot_date").cast("date")
        now = day >= F.date_sub(F.col("end").cast("date"), days - 1)
        before = (day >= F.date_sub(F.col("end").cast("date"), 2 * days - 1)) & ~now
        per = by_day.groupBy("canonical_product_id").agg(F.max_by(F.when(now, F.col("p")), F.when(now, F.col("snapshot_date"))).alias("current_price"), F.max_by(F.when(before, F.col("p")), F.when(before, F.col("snapshot_date"))).alias("previous_price"), F.sum(F.when(now, F.col("total"))).cast("double").alias("total"), F.sum(F.when(now, F.col("n"))).alias("n"))
    else:
        w = Window.partitionBy("canonical_product_id").orderBy(F.desc("snapshot_date"))
        last = by_day.withColumn("k", F.row_number().over(w))
        per = last.groupBy("canonical_product_id").agg(F.max(F.when(F.col("k") == 1, F.col("p"))).alias("current_price"), F.max(F.when(F.col("k") == 2, F.col("p"))).alias("previous_price"), F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"))
    average = rounded(F.col("total") / F.col("n"))
    per = per.withColumn("good", F.col("current_price") <= average * GOOD_DEAL)
    key = F.coalesce(F.nullif(F.trim(F.col(group_by).cast("string")), F.lit("")), F.lit("Uncategorized"))
    g = products.select("canonical_product_id", key.alias("key")).join(per, "canonical_product_id", "left").groupBy("key").agg(
        F.count("*").alias("product_count"), F.count("current_price").alias("priced_product_count"), rounded(exact_avg(F.col("current_price"))).alias("average_price_current"),
        rounded(exact_avg(F.col("previous_price"))).alias("average_price_previous"), F.count_if(F.col("good")).alias("deal_count"),
    )
    g = g.withColumn("change_amount", rounded(F.col("average_price_current") - F.col("average_price_previous")))
    g = g.withColumn("change_percent", F.when(F.col("average_price_previous") > 0, rounded(F.col("change_amount") / F.col("average_price_previous"), 4)))
    trend = F.when(F.col("change_percent").isNull(), "insufficient_data").when(F.col("change_percent") >= UP, "up").when(F.col("change_percent") <= DOWN, "down").otherwise("flat")
    return g.withColumn("trend", trend).withColumn("deal_density", rate(F.col("deal_count"), F.col("priced_product_count")))
