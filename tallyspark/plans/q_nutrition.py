"""Queries over nutrition and plans: parts are foods, order lines nutrient amounts and recipe lines, orders recipes, customers planners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import exact_avg, rounded
from tallyspark.operators import nutrition as N
from tallyspark.operators.quality import first_reason
from tallyspark.plans.adapter import read, sql_avg, sql_round, sql_sum
from tallyspark.plans.registry import query

R = sql_round
IDS = {"kcal": [1, 2, 3], "protein": [4], "fat": [5], "carbs": [6], "fiber": [7]}

BASE = f"""wide AS (SELECT l_partkey AS food_id, {', '.join(f'max(l_quantity) FILTER (l_linenumber = {i}) AS n{i}' for i in range(1, 8))} FROM lineitem GROUP BY 1),
profiles AS (SELECT food_id, coalesce(n1, n2, n3) AS kcal, n4 AS protein, n5 AS fat, n6 AS carbs, n7 AS fiber FROM wide),
recipes AS (SELECT o_orderkey AS recipe_id, o_orderkey % 4 + 1 AS servings FROM orders),
rlines AS (SELECT l_orderkey AS recipe_id, l_partkey AS ingredient_id, 'item ' || l_partkey AS name, CASE WHEN l_discount > 0 THEN l_quantity * 10 END AS grams FROM lineitem)"""


def profiles(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("food_id"), F.col("l_linenumber").alias("nutrient_id"), F.col("l_quantity").alias("amount"))
    return N.macro_pivot(rows, IDS)


def recipe_tables(spark, d):
    recipes = read(spark, d, "orders").select(F.col("o_orderkey").alias("recipe_id"), (F.col("o_orderkey") % 4 + 1).alias("servings"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("ingredient_id"), F.concat(F.lit("item "), "l_partkey").alias("name"), F.when(F.col("l_discount") > 0, F.col("l_quantity") * 10).alias("grams"))
    return recipes, lines


@query("nutrient_pivot", f"WITH {BASE} SELECT * FROM profiles")
def nutrient_pivot(spark, d):
    return profiles(spark, d)


def _total(m):
    return f"coalesce({sql_sum(f'CASE WHEN known THEN {R(f'{m} * grams / 100', 4)} END')}, 0)"


ROLLUP = f"""{BASE}, j AS (SELECT r.*, p.*, grams IS NOT NULL AND kcal IS NOT NULL AS known FROM rlines r LEFT JOIN (SELECT * FROM profiles WHERE food_id % 5 <> 0) p ON food_id = ingredient_id),
g AS (SELECT recipe_id, count(*) AS ingredient_count, count(*) FILTER (known) AS covered, {', '.join(f'{_total(m)} AS total_{m}' for m in N.MACROS)} FROM j GROUP BY 1),
rollup_ AS (SELECT recipe_id, servings, ingredient_count, covered, {', '.join(f'total_{m}' for m in N.MACROS)}, {R('covered::DOUBLE / ingredient_count', 4)} AS coverage, {', '.join(f'{R(f'total_{m} / servings')} AS serving_{m}' for m in N.MACROS)} FROM recipes JOIN g USING (recipe_id))"""


@query("recipe_nutrition", f"WITH {ROLLUP} SELECT *, CASE WHEN covered = 0 THEN 'none' WHEN covered = ingredient_count THEN 'high' WHEN coverage >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM rollup_")
def recipe_nutrition(spark, d):
    recipes, lines = recipe_tables(spark, d)
    return N.recipe_rollup(recipes, lines, profiles(spark, d).filter("food_id % 5 != 0").withColumnRenamed("food_id", "ingredient_id"))


@query("recipe_readiness", f"""WITH {BASE}, r AS (SELECT recipe_id, count(*) AS ingredient_count, {R('count(*) FILTER (ingredient_id % 97 <> 0)::DOUBLE / count(*)', 4)} AS match_rate, {R('count(grams)::DOUBLE / count(*)', 4)} AS grams_rate,
    {R('count(*) FILTER (ingredient_id % 5 <> 0)::DOUBLE / count(*)', 4)} AS nutrition_rate, {R('count(*) FILTER (ingredient_id % 2 = 0)::DOUBLE / count(*)', 4)} AS product_rate FROM rlines GROUP BY 1)
  SELECT *, CASE WHEN ingredient_count = 0 THEN 'no_ingredients' WHEN match_rate < 1 THEN 'ingredients_unmatched' WHEN grams_rate < 1 THEN 'grams_missing' WHEN nutrition_rate < 0.8 THEN 'nutrition_incomplete' WHEN product_rate < 0.5 THEN 'products_missing' ELSE 'ready' END AS readiness FROM r""")
def recipe_readiness(spark, d):
    from tallyspark.functions.money import rate

    part = lambda test: rate(F.count_if(test), F.count("*"))
    k = F.col("ingredient_id")
    rates = recipe_tables(spark, d)[1].groupBy("recipe_id").agg(F.count("*").alias("ingredient_count"), part(k % 97 != 0).alias("match_rate"), part(F.col("grams").isNotNull()).alias("grams_rate"), part(k % 5 != 0).alias("nutrition_rate"), part(k % 2 == 0).alias("product_rate"))
    return N.readiness(rates)


REQUIRED = f"""{BASE}, times AS (SELECT o_custkey AS plan_id, o_orderkey AS recipe_id, count(*) AS times FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0) GROUP BY ALL),
required AS (SELECT plan_id, CASE WHEN ingredient_id % 11 = 0 THEN 'name:' || name ELSE ingredient_id::VARCHAR END AS ingredient_key, {sql_sum('coalesce(grams, 0) * times')} AS required_grams, sum(times)::BIGINT AS uses, count(*) FILTER (grams IS NULL) AS lines_without_grams FROM times JOIN rlines USING (recipe_id) GROUP BY ALL)"""


def _required(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("recipe_id"))
    lines = recipe_tables(spark, d)[1].withColumn("ingredient_id", F.when(F.col("ingredient_id") % 11 != 0, F.col("ingredient_id")))
    return N.requirements(orders.unionByName(orders.filter("recipe_id % 3 = 0")), lines)


@query("meal_requirements", f"WITH {REQUIRED} SELECT * FROM required")
def meal_requirements(spark, d):
    return _required(spark, d)


NET = f"""{REQUIRED}, inventory AS (SELECT o_custkey AS plan_id, CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR END AS ingredient_key, 'item ' || l_partkey AS name, l_quantity * 20 AS available FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
by_id AS (SELECT plan_id, ingredient_key, {sql_sum('available')} AS a FROM inventory WHERE ingredient_key IS NOT NULL GROUP BY ALL), by_name AS (SELECT plan_id, name, {sql_sum('available')} AS b FROM inventory WHERE ingredient_key IS NULL GROUP BY ALL),
applied AS (SELECT r.*, least(required_grams, coalesce(a, b, 0)) AS applied_grams FROM required r LEFT JOIN by_id USING (plan_id, ingredient_key) LEFT JOIN by_name n ON n.plan_id = r.plan_id AND n.name = 'item ' || r.ingredient_key),
net AS (SELECT plan_id, ingredient_key, required_grams, applied_grams, greatest(required_grams - applied_grams, 0) AS net_grams FROM applied)"""


def _net(spark, d):
    lines = read(spark, d, "lineitem").filter("l_returnflag = 'R'").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    inventory = lines.select(F.col("o_custkey").alias("plan_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey").cast("string")).alias("ingredient_key"), F.concat(F.lit("item "), "l_partkey").alias("name"), (F.col("l_quantity") * 20).alias("available"))
    return N.net_requirements(_required(spark, d).select("plan_id", "ingredient_key", "required_grams"), inventory)


@query("inventory_netting", f"WITH {NET} SELECT *, CASE WHEN net_grams = 0 THEN 'covered' WHEN applied_grams > 0 THEN 'partial' ELSE 'missing' END AS inventory_status FROM net")
def inventory_netting(spark, d):
    return _net(spark, d)


CANDIDATES = f"""{NET}, packages AS (SELECT p_partkey::VARCHAR AS ingredient_key, p_partkey AS product_id, p_size * 10.0::DOUBLE AS package_grams, p_retailprice AS unit_price, 0.65::DOUBLE AS mapping_confidence FROM part
  UNION ALL SELECT p_partkey::VARCHAR, p_partkey + 1000000, p_size * 25.0::DOUBLE, p_retailprice * 2, 0.85::DOUBLE FROM part WHERE p_partkey % 3 = 0),
candidates AS (SELECT plan_id, ingredient_key, product_id, greatest(1, ceil(net_grams / package_grams))::BIGINT AS units_needed, package_grams, net_grams, unit_price, mapping_confidence FROM net JOIN packages USING (ingredient_key)),
costed AS (SELECT plan_id, ingredient_key, product_id, units_needed, units_needed * package_grams - net_grams AS overage_grams, {R('units_needed * unit_price')} AS line_cost, least(1.0::DOUBLE, floor(mapping_confidence * 100 + 30 + 0.5) / 100) AS confidence FROM candidates)"""


def _candidates(spark, d):
    p = read(spark, d, "part")
    key = F.col("p_partkey").cast("string").alias("ingredient_key")
    one = p.select(key, F.col("p_partkey").alias("product_id"), (F.col("p_size") * 10.0).alias("package_grams"), F.col("p_retailprice").alias("unit_price"), F.lit(0.65).alias("mapping_confidence"))
    two = p.filter("p_partkey % 3 = 0").select(key, (F.col("p_partkey") + 1000000).alias("product_id"), (F.col("p_size") * 25.0).alias("package_grams"), (F.col("p_retailprice") * 2).alias("unit_price"), F.lit(0.85).alias("mapping_confidence"))
    return N.product_candidates(_net(spark, d), one.unionByName(two))


@query("product_candidates", f"WITH {CANDIDATES} SELECT * FROM costed")
def product_candidates(spark, d):
    return _candidates(spark, d).select("plan_id", "ingredient_key", "product_id", "units_needed", "overage_grams", "line_cost", "confidence")


@query("price_envelope", f"WITH {CANDIDATES}, per AS (SELECT plan_id, ingredient_key, min(line_cost) AS low, max(line_cost) AS high FROM costed GROUP BY ALL) SELECT plan_id, count(*) AS items, {R(sql_sum('low'))} AS min_total, {R(sql_sum('high'))} AS max_total FROM per GROUP BY 1")
def price_envelope(spark, d):
    return N.price_envelope(_candidates(spark, d))


TASTE = f"""s AS (SELECT user_id AS profile_id, CASE WHEN event_id % 2 = 0 THEN 'cuisine' ELSE 'tag' END AS family, event_type AS key, CASE event_type WHEN 'error' THEN -1.0 WHEN 'view' THEN 0.0 ELSE {R('value / 20')} END::DOUBLE AS score, {R('1 + value / 100')} AS weight FROM events),
t AS (SELECT profile_id, family, key, {sql_sum('score * weight')} AS s, {sql_sum('weight')} AS w FROM s GROUP BY ALL), vectors AS (SELECT profile_id, family, key, {R('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s / w))', 4)} AS score FROM t WHERE w > 0)"""


def _taste(spark, d):
    e = read(spark, d, "events")
    score = F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "view", 0.0).otherwise(rounded(F.col("value") / 20))
    s = e.select(F.col("user_id").alias("profile_id"), F.when(F.col("event_id") % 2 == 0, "cuisine").otherwise("tag").alias("family"), F.col("event_type").alias("key"), score.alias("score"), rounded(1 + F.col("value") / 100).alias("weight"))
    return N.taste_vectors(s)


@query("taste_vectors", f"WITH {TASTE} SELECT * FROM vectors WHERE score <> 0")
def taste_vectors(spark, d):
    return _taste(spark, d)


@query("taste_maps", f"WITH {TASTE} SELECT profile_id, family, count(*) AS keys FROM vectors WHERE score <> 0 GROUP BY ALL")
def taste_maps(spark, d):
    return N.as_maps(_taste(spark, d)).select("profile_id", "family", F.size("vector").cast("long").alias("keys"))


@query("feedback_summary", f"""SELECT user_id, count(*) AS events, {', '.join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ('click', 'error', 'purchase', 'signup', 'view'))}, {R(sql_avg(R('value')))} AS mean_value, count(DISTINCT props) AS distinct_items FROM events GROUP BY 1""")
def feedback_summary(spark, d):
    from tallyspark.functions.money import exact_avg

    is_ = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), *[is_(t) for t in ("click", "error", "purchase", "signup", "view")], rounded(exact_avg(rounded(F.col("value")))).alias("mean_value"), F.countDistinct("props").alias("distinct_items"))


@query("hard_constraints_first_reason", f"""WITH {BASE}, m AS (SELECT recipe_id, bool_or(ingredient_id % 41 = 0) AS hit, count(*) AS steps FROM rlines GROUP BY 1), x AS (SELECT recipe_id, CASE WHEN hit THEN 'constraint' WHEN steps > 6 THEN 'time_limit' WHEN recipe_id % 9 = 0 THEN 'missing_equipment' END AS excluded_by FROM m)
  SELECT coalesce(excluded_by, 'kept') AS outcome, count(*) AS recipes FROM x GROUP BY 1""")
def hard_constraints(spark, d):
    m = recipe_tables(spark, d)[1].groupBy("recipe_id").agg(F.bool_or(F.col("ingredient_id") % 41 == 0).alias("hit"), F.count("*").alias("steps"))
    rows = first_reason(m, {"constraint": F.col("hit"), "time_limit": F.col("steps") > 6, "missing_equipment": F.col("recipe_id") % 9 == 0})
    return rows.groupBy(F.coalesce("excluded_by", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("recipes"))


@query("recipe_scores", f"WITH {ROLLUP} SELECT recipe_id, {R('0.45::DOUBLE * (recipe_id % 10 / 10.0::DOUBLE) + 0.40::DOUBLE * coverage + 0.15::DOUBLE * (servings / 4.0::DOUBLE) - 0.0::DOUBLE', 4)} AS score FROM rollup_")
def recipe_scores(spark, d):
    rows = recipe_nutrition(spark, d).select("recipe_id", ((F.col("recipe_id") % 10) / F.lit(10.0)).alias("taste"), F.col("coverage").alias("nutrition"), (F.col("servings") / F.lit(4.0)).alias("time"), F.lit(0.0).alias("penalty"))
    return N.recipe_scores(rows).select("recipe_id", "score")


MEALS = ["F", "O", "P"]
#: Recipes are orders: kinds of their parts are what tastes, the status is the meal type (none where the priority isn't specified), the priority the cuisine, lines take time.
PLANNER = f"""{ROLLUP}, kinds AS (SELECT DISTINCT l_orderkey AS recipe_id, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
liked AS (SELECT o_custkey AS profile_id, p_type, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
vectors AS (SELECT profile_id, p_type, {R('2.0::DOUBLE * n / sum(n) OVER (PARTITION BY profile_id) - 1', 3)} AS s FROM liked),
family AS (SELECT o_orderkey AS recipe_id, {R(f"{sql_sum(R('(s + 1) / 2', 3))} / count(*)", 3)} AS f FROM orders JOIN kinds ON recipe_id = o_orderkey JOIN vectors v ON v.profile_id = o_custkey AND v.p_type = kinds.p_type GROUP BY 1),
aims AS (SELECT o_custkey AS profile_id, {R(sql_avg('serving_kcal'))} AS aim FROM rollup_ JOIN orders ON o_orderkey = recipe_id GROUP BY 1),
facts AS (SELECT o_custkey AS profile_id, o_orderkey AS recipe_id, o_orderpriority AS cuisine, meal_type, f, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 WHEN o_orderstatus = meal_type THEN 1.0 ELSE 0.2 END::DOUBLE AS fit,
  o_orderpriority = '4-NOT SPECIFIED' OR o_orderstatus = meal_type AS fits, CASE WHEN aim > 0 THEN {R('greatest(0.0::DOUBLE, 1 - abs(serving_kcal - aim) / aim)', 3)} END AS near, {R('greatest(0.0::DOUBLE, 1 - ingredient_count / 6.0::DOUBLE)', 3)} AS time
  FROM orders JOIN rollup_ ON recipe_id = o_orderkey JOIN aims ON profile_id = o_custkey LEFT JOIN family USING (recipe_id), (SELECT unnest(['F', 'O', 'P']) AS meal_type)),
parts_ AS (SELECT *, CASE WHEN f IS NULL THEN {R('fit', 3)} ELSE {R('(f + fit) / 2', 3)} END AS taste, coalesce(near, 0.5) AS nutrition FROM facts)"""


def _planner(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("cuisine"), "o_orderstatus")
    kinds = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe_id"), "l_partkey").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    liked = kinds.join(o.select("recipe_id", "profile_id"), "recipe_id").groupBy("profile_id", "p_type").agg(F.count("*").alias("n"))
    whole = liked.groupBy("profile_id").agg(F.sum("n").alias("all"))
    likes = liked.join(whole, "profile_id").withColumn("s", rounded(2.0 * F.col("n") / F.col("all") - 1, 3))
    vectors = likes.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "s"))).alias("vector"))
    rolled = recipe_nutrition(spark, d).select("recipe_id", "serving_kcal", "ingredient_count")
    aims = rolled.join(o, "recipe_id").groupBy("profile_id").agg(rounded(exact_avg(F.col("serving_kcal"))).alias("aim"))
    rows = o.join(rolled, "recipe_id").join(kinds.groupBy("recipe_id").agg(F.collect_set("p_type").alias("keys")), "recipe_id", "left").join(aims, "profile_id").join(vectors, "profile_id", "left")
    tags = F.when(F.col("cuisine") == "4-NOT SPECIFIED", F.array().cast("array<string>")).otherwise(F.array("o_orderstatus"))
    rows = rows.withColumn("tags", tags).withColumn("meal_type", F.explode(F.array(*[F.lit(m) for m in MEALS])))
    fit = N.meal_fit(F.col("tags"), F.col("meal_type"))
    rows = rows.withColumn("taste", N.taste_score([N.family_score(F.col("keys"), F.col("vector"))], fit)).withColumn("nutrition", N.target_score([(F.col("serving_kcal"), F.col("aim"))]))
    rows = rows.withColumn("time", N.time_score([(F.col("ingredient_count"), F.lit(6.0))])).withColumn("penalty", F.lit(0.0)).withColumn("fits", (F.size("tags") == 0) | F.array_contains("tags", F.col("meal_type")))
    return N.recipe_scores(rows)


@query("planner_scores", f"WITH {PLANNER} SELECT profile_id, recipe_id, meal_type, fits, taste, nutrition, time, {R('0.45::DOUBLE * taste + 0.40::DOUBLE * nutrition + 0.15::DOUBLE * time', 4)} AS score FROM parts_")
def planner_scores(spark, d):
    """Each order scored for its customer and each meal type by taste, nutrition and time."""
    return _planner(spark, d).select("profile_id", "recipe_id", "meal_type", "fits", "taste", "nutrition", "time", "score")


@query("meal_plans")
def meal_plans(spark, d):
    """Three days of three meals for each customer; sequential by nature, so the tests state it by a plain loop."""
    return N.meal_plans(_planner(spark, d), 3, MEALS)


@query("meal_plan")
def meal_plan(spark, d):
    """Sequential by nature; the tests state it by a plain loop."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("recipe_id"), (F.col("o_orderkey") % 17 / F.lit(17.0)).alias("base_score"))
    return N.greedy_plan(o)


@query("unit_conversion", """WITH RECURSIVE e(unit, other, factor) AS (VALUES ('kg', 'g', 1000.0::DOUBLE), ('g', 'mg', 1000.0), ('l', 'ml', 1000.0), ('cup', 'ml', 250.0)), b AS (SELECT * FROM e UNION ALL SELECT other, unit, 1 / factor FROM e),
  walk(unit, other, factor, path, steps) AS (SELECT unit, other, factor, [unit, other], 1 FROM b UNION ALL SELECT w.unit, b.other, w.factor * b.factor, list_append(w.path, b.other), w.steps + 1 FROM walk w JOIN b ON w.other = b.unit WHERE NOT list_contains(w.path, b.other) AND w.steps < 8)
  SELECT unit, other, factor, steps, coalesce(products, 0) AS products FROM (SELECT *, row_number() OVER (PARTITION BY unit, other ORDER BY steps, factor) AS k FROM walk) LEFT JOIN (SELECT CASE p_partkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'cup' ELSE 'bunch' END AS unit, count(*) AS products FROM part GROUP BY 1) USING (unit) WHERE k = 1""")
def unit_conversion(spark, d):
    """What each known unit leads to, by which factor and in how many steps, and how many products have it; units that no product has stay, with 0."""
    k = F.col("p_partkey") % 5
    used = read(spark, d, "part").select(F.when(k == 0, "g").when(k == 1, "kg").when(k == 2, "ml").when(k == 3, "cup").otherwise("bunch").alias("unit")).groupBy("unit").agg(F.count("*").alias("products"))
    known = N.unit_closure(spark.createDataFrame([("kg", "g", 1000.0), ("g", "mg", 1000.0), ("l", "ml", 1000.0), ("cup", "ml", 250.0)], "unit string, other string, factor double"))
    return known.join(used, "unit", "left").select("unit", "other", "factor", "steps", F.coalesce("products", F.lit(0).cast("long")).alias("products"))


@query("ingredient_cost_fallback", f"""WITH p AS (SELECT l_partkey AS ingredient_id, p_type AS category, l_suppkey AS store_id, {R('l_extendedprice / l_quantity')} AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 3 <> 0 AND l_partkey % 10 <> 7),
  w AS (SELECT p_partkey AS ingredient_id, CASE WHEN p_partkey % 8 = 0 THEN 'UNKNOWN' ELSE p_type END AS category, p_partkey % 10 + 1 AS store_id FROM part),
  a AS (SELECT ingredient_id, store_id, min(price) AS p1 FROM p GROUP BY ALL), b AS (SELECT ingredient_id, min(price) AS p2 FROM p GROUP BY ALL), c AS (SELECT category, {R(sql_avg('price'))} AS p3 FROM p GROUP BY ALL)
  SELECT ingredient_id, store_id, coalesce(p1, p2, p3, 1.0) AS unit_cost, CASE WHEN p1 IS NOT NULL THEN 0.95 WHEN p2 IS NOT NULL THEN 0.8 WHEN p3 IS NOT NULL THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM w LEFT JOIN a USING (ingredient_id, store_id) LEFT JOIN b USING (ingredient_id) LEFT JOIN c USING (category)""")
def ingredient_cost_fallback(spark, d):
    part = read(spark, d, "part")
    prices = read(spark, d, "lineitem").filter("l_partkey % 3 != 0 and l_partkey % 10 != 7").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("ingredient_id"), F.col("p_type").alias("category"), F.col("l_suppkey").alias("store_id"), rounded(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    k = F.col("p_partkey")
    wanted = part.select(k.alias("ingredient_id"), F.when(k % 8 == 0, "UNKNOWN").otherwise(F.col("p_type")).alias("category"), (k % 10 + 1).alias("store_id"))
    return N.cost_with_fallback(wanted, prices)


@query("price_per_basis", f"SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 < 2 THEN {R('p_retailprice / p_size * 1000')} ELSE {R('p_retailprice / p_size')} END AS price_per_basis FROM part")
def price_per_basis(spark, d):
    unit = F.when(F.col("p_partkey") % 3 == 0, "g").when(F.col("p_partkey") % 3 == 1, "ml").otherwise("piece")
    return read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), N.per_basis(F.col("p_retailprice"), F.col("p_size"), unit).alias("price_per_basis"))


@query("alias_collisions", """WITH a AS (SELECT p_partkey, unnest(from_json(json_object('a', string_split(p_name, ' ')), '{"a": ["VARCHAR"]}').a) AS alias FROM part) SELECT alias, count(DISTINCT p_partkey) AS products, min(p_partkey) AS first_product FROM a GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""")
def alias_collisions(spark, d):
    """Aliases kept as JSON, parsed (null and nothing if malformed) and laid out one a row."""
    p = read(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.split("p_name", " ").alias("a"))).alias("j"))
    rows = p.select("p_partkey", F.explode(F.coalesce(F.from_json("j", "a array<string>")["a"], F.array())).alias("alias"))
    return rows.groupBy("alias").agg(F.countDistinct("p_partkey").alias("products"), F.min("p_partkey").alias("first_product")).filter("products > 1")


@query("not_exists_mapping", "SELECT p_partkey AS ingredient_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate > TIMESTAMP '2001-01-01')")
def not_exists_mapping(spark, d):
    recent = read(spark, d, "lineitem").filter(F.col("l_shipdate") > F.lit("2001-01-01").cast("timestamp")).select("l_partkey")
    p = read(spark, d, "part")
    return p.join(recent, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("ingredient_id"))


@query("coalesced_key_join", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON p_partkey = coalesce(CASE WHEN l_partkey % 2 = 0 THEN l_partkey END, l_suppkey)")
def coalesced_key_join(spark, d):
    key = F.coalesce(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")), F.col("l_suppkey"))
    return read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == key, "left").select("l_orderkey", "l_linenumber", "p_name")


@query("preferred_mapping", "SELECT l_partkey AS ingredient_id, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def preferred_mapping(spark, d):
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return N.pick_one(read(spark, d, "lineitem"), ["l_partkey"], rank, F.desc_nulls_last("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).select(F.col("l_partkey").alias("ingredient_id"), "l_orderkey", "l_linenumber")


@query("cluster_report", f"""SELECT p_brand AS cluster, count(*) AS members, count(*) FILTER (p_size < 25) AS small, count(DISTINCT p_type) AS kinds, {R(sql_avg(R('p_retailprice')))} AS mean_price, array_to_string(list_slice(list(p_name || '#' || p_partkey ORDER BY p_size DESC, p_partkey), 1, 5), ',') AS top FROM part GROUP BY 1 HAVING count(*) > 5""")
def cluster_report(spark, d):
    from tallyspark.functions.money import exact_avg
    from tallyspark.operators.ranking import first_few

    p = read(spark, d, "part").withColumn("cluster", F.col("p_brand"))
    g = p.groupBy("cluster").agg(F.count("*").alias("members"), F.count_if(F.col("p_size") < 25).alias("small"), F.countDistinct("p_type").alias("kinds"), rounded(exact_avg(rounded(F.col("p_retailprice")))).alias("mean_price"))
    top = first_few(p, ["cluster"], [F.desc("p_size"), F.col("p_partkey")], F.concat("p_name", F.lit("#"), "p_partkey"), 5, "top")
    return g.filter("members > 5").join(top, "cluster").withColumn("top", F.array_join("top", ","))


@query("cluster_materialisation", "SELECT p_brand, p_type, count(*) AS members, arg_min(p_partkey, (-p_size, p_partkey)) AS representative FROM part GROUP BY ALL")
def cluster_materialisation(spark, d):
    return read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("members"), F.min_by("p_partkey", F.struct(-F.col("p_size"), "p_partkey")).alias("representative"))


@query("decision_precedence", "SELECT user_id, event_type AS source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id) AS k FROM events) WHERE k = 1")
def decision_precedence(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return N.pick_one(read(spark, d, "events"), ["user_id"], rank, F.desc("ts"), F.col("event_id")).select("user_id", F.col("event_type").alias("source"), "event_id")


@query("review_transitions", "SELECT event_id, CASE WHEN (event_type, CASE WHEN user_id % 2 = 0 THEN 'approved' ELSE 'rejected' END) IN (('view', 'approved'), ('view', 'rejected'), ('click', 'approved')) THEN true ELSE false END AS ok FROM events")
def review_transitions(spark, d):
    t = spark.createDataFrame([("view", "approved"), ("view", "rejected"), ("click", "approved")], "from_status string, to_status string")
    r = read(spark, d, "events").select("event_id", F.col("event_type").alias("from_status"), F.when(F.col("user_id") % 2 == 0, "approved").otherwise("rejected").alias("to_status"))
    return N.allowed(t, r).select("event_id", "ok")
