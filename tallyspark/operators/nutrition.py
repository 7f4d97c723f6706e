"""Nutrition, recipes and meal plans: pivots, rollups, ladders, requirements, netting, candidates, taste, greedy plans, units."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_avg, exact_sum, rate, rounded

MACROS = ("kcal", "protein", "fat", "carbs", "fiber")


def macro_pivot(rows: DataFrame, ids: dict[str, list[int]]) -> DataFrame:
    """food_id and one column per macro; a macro of several ids takes the first that has a value. The ids are given, so one pass suffices."""
    flat = [i for xs in ids.values() for i in xs]
    wide = rows.filter(F.col("nutrient_id").isin(flat)).groupBy("food_id").pivot("nutrient_id", flat).agg(F.max("amount"))
    return wide.select("food_id", *[F.coalesce(*[F.col(f"`{i}`") for i in xs]).alias(m) for m, xs in ids.items()])


def recipe_rollup(recipes: DataFrame, lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sums per 100 g times grams / 100, per serving, with how many lines had grams and a profile, and a confidence from that.

    recipes: recipe_id, servings. lines: recipe_id, ingredient_id, grams. profiles: ingredient_id and MACROS per 100 g.
    """
    j = lines.join(profiles, "ingredient_id", "left")
    known = F.col("grams").isNotNull() & F.col("kcal").isNotNull()
    part = lambda m: F.coalesce(exact_sum(F.when(known, rounded(F.col(m) * F.col("grams") / 100, 4))), F.lit(0.0))
    g = j.groupBy("recipe_id").agg(F.count("*").alias("ingredient_count"), F.count_if(known).alias("covered"), *[part(m).alias(f"total_{m}") for m in MACROS])
    out = recipes.join(g, "recipe_id").withColumn("coverage", rate(F.col("covered"), F.col("ingredient_count")))
    for m in MACROS:
        out = out.withColumn(f"serving_{m}", rounded(F.col(f"total_{m}") / F.col("servings")))
    confidence = F.when(F.col("covered") == 0, "none").when(F.col("covered") == F.col("ingredient_count"), "high").when(F.col("coverage") >= 0.5, "medium").otherwise("low")
    return out.withColumn("confidence", confidence)


def readiness(rates: DataFrame) -> DataFrame:
    """The first step of the ladder that a recipe doesn't pass."""
    status = (
        F.when(F.col("ingredient_count") == 0, "no_ingredients").when(F.col("match_rate") < 1, "ingredients_unmatched").when(F.col("grams_rate") < 1, "grams_missing")
        .when(F.col("nutrition_rate") < 0.8, "nutrition_incomplete").when(F.col("product_rate") < 0.5, "products_missing").otherwise("ready")
    )
    return rates.withColumn("readiness", status)


def requirements(plan_items: DataFrame, lines: DataFrame) -> DataFrame:
    """Grams that a plan needs of each ingredient (by identifier, else by name): recipes' occurrences are counted before the join."""
    times = plan_items.groupBy("plan_id", "recipe_id").agg(F.count("*").alias("times"))
    key = F.coalesce(F.col("ingredient_id").cast("string"), F.concat(F.lit("name:"), F.lower(F.trim("name"))))
    rows = times.join(lines, "recipe_id").withColumn("ingredient_key", key)
    return rows.groupBy("plan_id", "ingredient_key").agg(exact_sum(F.coalesce("grams", F.lit(0.0)) * F.col("times")).alias("required_grams"), F.sum("times").alias("uses"), F.count_if(F.col("grams").isNull()).alias("lines_without_grams"))


def net_requirements(required: DataFrame, inventory: DataFrame) -> DataFrame:
    """What is left to buy: applied = min(required, available), the rest is net. Identifiers match first; names only where no identifier does."""
    by_id = inventory.filter(F.col("ingredient_key").isNotNull()).groupBy("plan_id", "ingredient_key").agg(exact_sum(F.col("available")).alias("by_id"))
    by_name = inventory.filter(F.col("ingredient_key").isNull()).groupBy("plan_id", F.col("name").alias("ingredient_name")).agg(exact_sum(F.col("available")).alias("by_name"))
    rows = required.withColumn("ingredient_name", F.concat(F.lit("item "), "ingredient_key")).join(by_id, ["plan_id", "ingredient_key"], "left").join(by_name, ["plan_id", "ingredient_name"], "left")
    have = F.coalesce("by_id", "by_name", F.lit(0.0))
    rows = rows.withColumn("applied_grams", F.least(F.col("required_grams"), have)).withColumn("net_grams", F.greatest(F.col("required_grams") - F.col("applied_grams"), F.lit(0.0)))
    status = F.when(F.col("net_grams") == 0, "covered").when(F.col("applied_grams") > 0, "partial").otherwise("missing")
    return rows.select("plan_id", "ingredient_key", "required_grams", "applied_grams", "net_grams", status.alias("inventory_status"))


def product_candidates(net: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages that fill a net requirement: units (at least one), what is left over, cost, and a confidence of what is known."""
    rows = net.join(packages, "ingredient_key")
    units = F.greatest(F.lit(1.0), F.ceil(F.col("net_grams") / F.col("package_grams")))
    rows = rows.withColumn("units_needed", units.cast("long")).withColumn("overage_grams", F.col("units_needed") * F.col("package_grams") - F.col("net_grams"))
    known = F.when(F.col("product_id").isNotNull(), 10).otherwise(0) + F.when(F.col("package_grams").isNotNull(), 10).otherwise(0) + F.when(F.col("unit_price").isNotNull(), 10).otherwise(0)
    return rows.withColumn("line_cost", rounded(F.col("units_needed") * F.col("unit_price"))).withColumn("confidence", F.least(F.lit(1.0), F.floor(F.col("mapping_confidence") * 100 + known + 0.5) / 100))


def price_envelope(candidates: DataFrame) -> DataFrame:
    """Per plan, the sums of each item's least and greatest cost."""
    per = candidates.groupBy("plan_id", "ingredient_key").agg(F.min("line_cost").alias("low"), F.max("line_cost").alias("high"))
    return per.groupBy("plan_id").agg(F.count("*").alias("items"), rounded(exact_sum(F.col("low"))).alias("min_total"), rounded(exact_sum(F.col("high"))).alias("max_total"))


def taste_vectors(signals: DataFrame) -> DataFrame:
    """Weighted mean of the scores of each profile, family and key, held to [-1, 1]; zeros are dropped."""
    g = signals.groupBy("profile_id", "family", "key").agg(exact_sum(F.col("score") * F.col("weight")).alias("s"), exact_sum(F.col("weight")).alias("w"))
    score = rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / F.col("w"))), 4)
    return g.filter("w > 0").withColumn("score", score).filter("score != 0").select("profile_id", "family", "key", "score")


def as_maps(vectors: DataFrame) -> DataFrame:
    """One map per profile and family; the keys are a small vocabulary."""
    return vectors.groupBy("profile_id", "family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "score")))).alias("vector"))


def recipe_scores(recipes: DataFrame) -> DataFrame:
    """0.45 taste, 0.40 nutrition and 0.15 time, less the variety penalty."""
    return recipes.withColumn("score", rounded(0.45 * F.col("taste") + 0.40 * F.col("nutrition") + 0.15 * F.col("time") - F.col("penalty"), 4))


def greedy_plan(recipes: DataFrame, days: int = 3, meals: int = 2, same_day: float = 1.0, repeat: float = 0.2) -> DataFrame:
    """A plan per profile, one meal after another: the best score less 0.2 for each earlier use and 1 if used that day; ties to the smaller recipe.

    Each choice depends on those before, so a profile's recipes are one group. recipes: profile_id, recipe_id, base_score.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("recipe_id", kind="stable")
        ids, base = group["recipe_id"].tolist(), group["base_score"].to_numpy(dtype=float)
        uses, out = [0] * len(ids), []
        for day in range(days):
            today = [False] * len(ids)
            for meal in range(meals):
                scores = [b - repeat * u - same_day * t for b, u, t in zip(base, uses, today)]
                best = max(range(len(ids)), key=lambda i: (scores[i], -i))
                uses[best] += 1
                today[best] = True
                out.append((group["profile_id"].iloc[0], day, meal, ids[best], round(scores[best], 6)))
        return pd.DataFrame(out, columns=["profile_id", "day", "meal", "recipe_id", "score"])

    return recipes.groupBy("profile_id").applyInPandas(run, "profile_id long, day int, meal int, recipe_id long, score double")


# --- scores of the planner: each in [0, 1], to three places; what is unknown counts a half ---------------------------------


def _mean(values: list[Column]) -> Column:
    """Mean of the known values, a half if none is."""
    known = F.array_compact(F.array(*values))
    return rounded(F.when(F.size(known) == 0, 0.5).otherwise(F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)), 3)


def family_score(keys: Column, vector: Column) -> Column:
    """How a profile likes a recipe's keys of one family: the mean of its signed scores of them, moved to [0, 1]; null if it has none of them."""
    known = F.filter(F.array_distinct(keys), lambda k: F.map_contains_key(vector, k))
    signed = F.transform(known, lambda k: rounded((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vector[k])) + 1) / 2, 3))
    return F.when(F.size(known) > 0, rounded(F.aggregate(signed, F.lit(0.0), lambda a, v: a + v) / F.size(known), 3))


def meal_fit(tags: Column, meal: Column) -> Column:
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, 0.5).when(F.array_contains(tags, meal), 1.0).otherwise(0.2)


def taste_score(families: list[Column], fit: Column) -> Column:
    return _mean([*families, fit])


def target_score(pairs: list[tuple[Column, Column]]) -> Column:
    """How near values are to their targets; values or targets that are missing don't count."""
    near = lambda v, t: F.when(v.isNotNull() & (t > 0), rounded(F.greatest(F.lit(0.0), 1 - F.abs(v - t) / t), 3))
    return _mean([near(v, t) for v, t in pairs])


def time_score(pairs: list[tuple[Column, Column]]) -> Column:
    """How much of the time allowed is left; bounds that aren't set don't count, unknown times count a half."""
    left = lambda v, most: F.when(most > 0, F.when(v.isNull(), 0.5).otherwise(rounded(F.greatest(F.lit(0.0), 1 - v / most), 3)))
    return _mean([left(v, most) for v, most in pairs])


#: What repeats cost: used that day; each earlier use, and at most; right before; the same meal the day before; each earlier use of the cuisine, and at most; all together at most.
SAME_DAY, USED, USED_MOST, BEFORE, DAY_BEFORE, CUISINE, CUISINE_MOST, MOST = 0.45, 0.08, 0.25, 0.25, 0.12, 0.03, 0.12, 0.9


def meal_plans(scored: DataFrame, days: int, meals: list[str]) -> DataFrame:
    """A plan per profile, meal after meal: of the recipes that fit the meal's type (of all, if none does) the best score less what repeats cost; recipes not used yet
    come first, then those not used that day; ties to the smaller recipe.

    scored: profile_id, recipe_id, meal_type, fits, cuisine (null: none), score. Unused recipes of one cuisine differ only by their score, so of each profile, meal type and
    cuisine no more than one recipe a planned meal and one over can be chosen; the others are dropped by rank first, and a profile's group is bounded.
    """
    picks = days * len(meals) + 1
    # all that follows is by profile, so rows move once
    rows = scored.select("profile_id", "recipe_id", "meal_type", "fits", "cuisine", "score").filter(F.col("meal_type").isin(meals)).repartition("profile_id")
    any_fits = F.max("fits").over(Window.partitionBy("profile_id", "meal_type"))
    rows = rows.withColumn("__any", any_fits).filter("fits or not __any").drop("__any")
    rank = F.row_number().over(Window.partitionBy("profile_id", "meal_type", "cuisine").orderBy(F.desc("score"), "recipe_id"))
    rows = rows.withColumn("__rank", rank).filter(F.col("__rank") <= picks)
    pools = rows.groupBy("profile_id").agg(F.collect_list(F.struct("meal_type", "recipe_id", "cuisine", F.col("score").cast("double").alias("score"))).alias("pool"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for profile, pool in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(profile, *row) for row in _plan([tuple(r.values()) for r in pool], days, meals)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64())
            cols = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["profile_id", "day", "meal_type", "recipe_id", "selection_score"])

    return pools.mapInArrow(run, "profile_id long, day int, meal_type string, recipe_id long, selection_score double")


def _plan(pool: list[tuple[str, int, str | None, float]], days: int, meals: list[str]) -> Iterator[tuple[int, str, int, float]]:
    """One profile's plan: day, meal, recipe, score. pool: meal, recipe, cuisine, score."""
    third = lambda x: round(x * 1000.0) / 1000.0
    of = {m: sorted((r[1:] for r in pool if r[0] == m), key=lambda r: r[0]) for m in meals}
    uses, cuisines, before = Counter(), Counter(), None
    at_meal: dict[tuple[str, int], int] = {}
    for day in range(days):
        today: set[int] = set()
        for meal in meals:
            best = None
            for recipe, cuisine, base in of[meal]:
                used, same_day = uses[recipe], recipe in today
                cost = SAME_DAY * same_day + min(USED_MOST, USED * used) + BEFORE * (recipe == before) + DAY_BEFORE * (recipe == at_meal.get((meal, day - 1)))
                cost = third(min(MOST, cost + min(CUISINE_MOST, CUISINE * (cuisines[cuisine] if cuisine is not None else 0))))
                # the class that comes first, then the score; of equal ones the smaller recipe, which is met first
                found = (2 if same_day else 1 if used else 0, -third(max(0.0, (base or 0.0) - cost)))
                if best is None or found < best[0]:
                    best = found, recipe, cuisine
            if best is None:
                continue
            (_, minus), before, cuisine = best
            today.add(before)
            uses[before] += 1
            at_meal[meal, day] = before
            if cuisine is not None:
                cuisines[cuisine] += 1
            yield day, meal, before, -minus if minus else 0.0


def unit_closure(edges: DataFrame) -> DataFrame:
    """Factors between all connected units, by shortest path (then the least path's factor), from edges unit, other, factor; conversions go both ways.

    A recursive query over the few units there are.
    """
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("other").alias("unit"), F.col("unit").alias("other"), (1 / F.col("factor")).alias("factor")))
    both.createOrReplaceTempView("__unit_edges")
    walked = spark.sql("""
        WITH RECURSIVE walk(unit, other, factor, path, steps) AS (
          SELECT unit, other, factor, array(unit, other), 1 FROM __unit_edges
          UNION ALL
          SELECT w.unit, e.other, w.factor * e.factor, array_append(w.path, e.other), w.steps + 1 FROM walk w JOIN __unit_edges e ON w.other = e.unit
          WHERE NOT array_contains(w.path, e.other) AND w.steps < 8
        ) SELECT unit, other, factor, steps FROM walk""")
    best = Window.partitionBy("unit", "other").orderBy("steps", "factor")
    return walked.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def cost_with_fallback(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each wanted ingredient: its store's price (0.95), any store's (0.8), its category's mean (0.6), else an estimate of 1 (0.4).

    prices: ingredient_id, category, store_id, price. Each level is aggregated first, so each join is by key to one row.
    """
    exact = prices.groupBy("ingredient_id", "store_id").agg(F.min("price").alias("p1"))
    anywhere = prices.groupBy("ingredient_id").agg(F.min("price").alias("p2"))
    category = prices.groupBy("category").agg(rounded(exact_avg(F.col("price"))).alias("p3"))
    rows = wanted.join(exact, ["ingredient_id", "store_id"], "left").join(anywhere, "ingredient_id", "left").join(category, "category", "left")
    confidence = F.when(F.col("p1").isNotNull(), 0.95).when(F.col("p2").isNotNull(), 0.8).when(F.col("p3").isNotNull(), 0.6).otherwise(0.4)
    return rows.select("ingredient_id", "store_id", F.coalesce("p1", "p2", "p3", F.lit(1.0)).alias("unit_cost"), confidence.alias("confidence"))


def per_basis(price: Column, quantity: Column, unit: Column) -> Column:
    """Price per kilogram or litre of a size in grams or millilitres, per piece otherwise; null without a size."""
    return F.when((quantity > 0) & unit.isin("g", "ml"), rounded(price / quantity * 1000)).when(quantity > 0, rounded(price / quantity))


def pick_one(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order of several columns (DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def allowed(transitions: DataFrame, requests: DataFrame) -> DataFrame:
    """A review's requests with whether the state machine allows them."""
    t = transitions.withColumn("ok", F.lit(True))
    return requests.join(F.broadcast(t), ["from_status", "to_status"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
