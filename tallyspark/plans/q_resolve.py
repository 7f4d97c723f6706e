"""Queries over parsing, rewriting, list resolution, mappings, merges and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import exact_avg, rate, rounded
from tallyspark.operators import resolve as Z
from tallyspark.plans.adapter import read, sql_avg, sql_round, sql_sum
from tallyspark.plans.q_nutrition import CANDIDATES, _candidates
from tallyspark.plans.registry import query

R = sql_round
ASKED = "asked AS (SELECT p_partkey AS query_id, p_name || ' ' || lower(replace(p_brand, '#', '')) || CASE p_partkey % 4 WHEN 0 THEN ' under ' || p_size || ',5' WHEN 1 THEN ' cheapest' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' varna' ELSE '' END AS text FROM part)"


def asked(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, F.concat(F.lit(" under "), "p_size", F.lit(",5"))).when(k % 4 == 1, " cheapest").otherwise("")
    return read(spark, d, "part").select(k.alias("query_id"), F.concat("p_name", F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), tail, F.when(k % 3 == 0, " varna").otherwise("")).alias("text"))


@query("query_parsing", f"""WITH {ASKED}, t AS (SELECT *, regexp_extract(text, 'under\\s+(\\d+(?:[.,]\\d+)?)', 1) AS m, string_split(text, ' ') AS w FROM asked)
  SELECT query_id, CASE WHEN m <> '' THEN replace(m, ',', '.')::DOUBLE END AS price_max, CASE WHEN list_contains(w, 'varna') THEN 'varna' END AS location, CASE WHEN list_contains(w, 'brand2') THEN 'brand2' WHEN list_contains(w, 'brand7') THEN 'brand7' END AS brand,
    CASE WHEN list_contains(w, 'cheapest') THEN 'cheapest' WHEN m <> '' THEN 'price_limit' ELSE 'search' END AS intent FROM t""")
def query_parsing(spark, d):
    cols = Z.parse_query(F.col("text"), ("varna", "sofia"), ("brand2", "brand7"), ("cheapest", "cheap"))
    return asked(spark, d).select("query_id", *[c.alias(k) for k, c in cols.items()])


CONCEPTS = "concepts(word, expanded) AS (VALUES ('gear', 'cog'), ('gear', 'wheel'), ('bolt', 'screw'), ('ring', 'washer'))"


@query("query_expansion", f"WITH {ASKED}, {CONCEPTS} SELECT DISTINCT query_id, word, expanded FROM (SELECT query_id, unnest(string_split(text, ' ')) AS word FROM asked) JOIN concepts USING (word)")
def query_expansion(spark, d):
    return Z.expand(asked(spark, d), spark.createDataFrame([("gear", "cog"), ("gear", "wheel"), ("bolt", "screw"), ("ring", "washer")], "word string, expanded string"))


@query("query_rewrite", f"""WITH {ASKED}, w AS (SELECT query_id, generate_subscripts(string_split(text, ' '), 1) AS pos, unnest(string_split(text, ' ')) AS word FROM asked), o AS (SELECT *, CASE word WHEN 'gear' THEN 'cog' WHEN 'hot' THEN 'warm' WHEN 'gizmo' THEN 'gadget' ELSE word END AS out FROM w)
  SELECT query_id, string_agg(out, ' ' ORDER BY pos) AS rewritten, count(*) FILTER (out <> word) AS rewrites FROM o GROUP BY 1""")
def query_rewrite(spark, d):
    return Z.rewrite(asked(spark, d), spark.createDataFrame([("gear", "cog"), ("hot", "warm")], "word string, term string"), spark.createDataFrame([("gear", "never"), ("gizmo", "gadget")], "word string, fixed string"))


@query("translate_prefix", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'small ring') THEN 'Ringlein' || substr(p_name, 11) WHEN starts_with(p_name, 'small') THEN 'klein' || substr(p_name, 6) WHEN starts_with(p_name, 'red') THEN 'rot' || substr(p_name, 4) ELSE p_name END AS shown FROM part")
def translate_prefix(spark, d):
    return read(spark, d, "part").select("p_partkey", Z.translate_prefix(F.col("p_name"), {"small": "klein", "small ring": "Ringlein", "red": "rot"}).alias("shown"))


LISTED = f"""c AS (SELECT o_custkey AS query_id, l_partkey AS product_id, min(l_linenumber) AS n, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT query_id, product_id, (n % 5) / 4.0::DOUBLE AS coverage, n = 1 AS exact, n = 2 AS phrase, q > 25 AS base_match, q % 2 = 0 AS category_match, n % 3 = 0 AS brand_match, CASE WHEN q > 40 THEN 1 WHEN q < 10 THEN -1 ELSE 0 END AS volume, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS count, 0.8::DOUBLE AS confidence FROM c),
s AS (SELECT query_id, product_id, {R("coverage * 0.55::DOUBLE + CASE WHEN exact THEN 0.12::DOUBLE WHEN phrase THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN base_match THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN category_match THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN brand_match THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + (volume + count) * 0.18::DOUBLE + 0.8::DOUBLE * 0.05::DOUBLE", 4)} AS score FROM f)"""


def _listed(spark, d):
    n, q = F.col("n"), F.col("q")
    c = read(spark, d, "lineitem").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("product_id")).agg(F.min("l_linenumber").alias("n"), F.max("l_quantity").alias("q"))
    f = c.select("query_id", "product_id", (n % 5 / F.lit(4.0)).alias("coverage"), (n == 1).alias("exact"), (n == 2).alias("phrase"), (q > 25).alias("base_match"), (q % 2 == 0).alias("category_match"), (n % 3 == 0).alias("brand_match"), F.when(q > 40, 1).when(q < 10, -1).otherwise(0).alias("volume"), F.when(n % 4 == 0, 1).otherwise(0).alias("count"), F.lit(0.8).alias("confidence"))
    return Z.list_score(f).select("query_id", "product_id", "score")


@query("shopping_list_scores", f"WITH {LISTED} SELECT * FROM s")
def shopping_list_scores(spark, d):
    return _listed(spark, d)


@query("shopping_list_status", f"""WITH {LISTED}, b AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, product_id))
  SELECT query_id, product_id, score, CASE WHEN score < 0.45 THEN 'unresolved' WHEN score >= 0.75 AND (next IS NULL OR next < 0.75 OR score - next >= 0.15) THEN 'resolved' ELSE 'ambiguous' END AS status FROM b WHERE k = 1""")
def shopping_list_status(spark, d):
    return Z.list_status(_listed(spark, d))


@query("family_intent", f"""WITH {ASKED}, t(family, term, weight) AS (VALUES ('fastener', 'bolt', 1.0::DOUBLE), ('fastener', 'ring', 0.9), ('drive', 'gear', 1.0), ('drive', 'hot', 0.7), ('fastener', 'small', 0.2)),
  g AS (SELECT query_id, family, {sql_sum('weight')} AS score FROM (SELECT DISTINCT query_id, unnest(string_split(text, ' ')) AS term FROM asked) JOIN t USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM g WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, family))
  SELECT query_id, family, score, CASE WHEN score - coalesce(next, 0) < 0.4 THEN 'ambiguous' ELSE 'resolved' END AS status FROM b WHERE k = 1""")
def family_intent(spark, d):
    terms = spark.createDataFrame([("fastener", "bolt", 1.0), ("fastener", "ring", 0.9), ("drive", "gear", 1.0), ("drive", "hot", 0.7), ("fastener", "small", 0.2)], "family string, term string, weight double")
    return Z.families(asked(spark, d), terms)


@query("representative_food_score", """WITH s AS (SELECT p_partkey, (CASE WHEN p_type = 'ECONOMY' THEN 50 ELSE 0 END + CASE WHEN p_type = 'SMALL' THEN 35 ELSE 0 END + CASE WHEN p_size > 20 THEN 20 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 10 ELSE 0 END + CASE WHEN p_size % 9 <= 5 THEN 8 ELSE 0 END
    - CASE WHEN p_size % 4 = 0 THEN 8 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 8 ELSE 0 END - CASE WHEN p_size % 7 = 0 THEN 12 ELSE 0 END - CASE WHEN p_size % 11 = 0 THEN 15 ELSE 0 END)::INTEGER AS score FROM part)
  SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS band FROM s""")
def representative_food_score(spark, d):
    n = F.col("p_size")
    score, band = Z.representative_score(F.col("p_type") == "ECONOMY", F.col("p_type") == "SMALL", n > 20, F.contains("p_name", F.lit("red")), n % 9, n % 4 == 0, n % 5 == 0, n % 7 == 0, n % 11 == 0)
    return read(spark, d, "part").select("p_partkey", score.alias("score"), band.alias("band"))


@query("ingredient_product_confidence", """WITH b AS (SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 96 WHEN contains(p_name, 'gear') THEN 88 WHEN contains(p_name, 'ring') THEN 84 ELSE 0 END AS x, p_size % 2 = 0 AS c, p_size % 3 = 0 AS a FROM part), y AS (SELECT *, CASE WHEN c THEN least(99, x + 6) ELSE x END AS z FROM b)
  SELECT p_partkey, CASE WHEN a THEN least(99, z + 4) ELSE z END::DOUBLE / 100 AS confidence FROM y""")
def ingredient_product_confidence(spark, d):
    n = F.col("p_size")
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_name") == "small ring").alias("exact"), F.contains("p_name", F.lit("gear")).alias("alias"), F.contains("p_name", F.lit("ring")).alias("contained"), (n % 2 == 0).alias("category"), (n % 3 == 0).alias("attribute"))
    return Z.ingredient_confidence(rows).select("p_partkey", "confidence")


@query("package_to_grams", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN p_size * 1.03::DOUBLE END WHEN 3 THEN p_size * 55.0 END::DOUBLE AS grams FROM part")
def package_to_grams(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    unit = F.when(k % 5 == 0, "G").when(k % 5 == 1, "kilogram").when(k % 5 == 2, "ml").when(k % 5 == 3, "pcs").otherwise("bunch")
    return read(spark, d, "part").select("p_partkey", Z.package_grams(n, unit, F.when(F.col("p_size") % 2 == 0, 1.03), F.lit(55.0)).alias("grams"))


@query("edible_to_purchase", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 0 ELSE ceil(l_quantity / coalesce(CASE WHEN l_discount > 0 THEN 1 - l_discount END, 1.0)) END::DOUBLE AS purchase FROM lineitem")
def edible_to_purchase(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Z.to_purchase(F.col("l_quantity"), F.when(F.col("l_discount") > 0, 1 - F.col("l_discount"))).alias("purchase"))


@query("merge_decisions", """SELECT a.p_partkey, CASE WHEN a.p_partkey % 3 = 0 THEN 'kept_apart' WHEN coalesce(CASE WHEN a.p_size % 2 = 0 THEN a.p_size END <> CASE WHEN b.p_size % 2 = 0 THEN b.p_size END, false) OR a.p_type <> b.p_type THEN 'vetoed' ELSE 'merged' END AS outcome FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def merge_decisions(spark, d):
    side = lambda p: [F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias(f"{p}_volume"), F.col("p_type").alias(f"{p}_kind")]
    p = read(spark, d, "part")
    rows = p.select("p_partkey", *side("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), *side("b")), "p_partkey").withColumn("decision", F.when(F.col("p_partkey") % 3 == 0, "keep").otherwise("merge"))
    return Z.merge_decisions(rows, ["volume", "kind"]).select("p_partkey", "outcome")


@query("recipe_usability", f"""WITH m AS (SELECT l_orderkey AS recipe_id, count(*) AS total, {R('count(*) FILTER (l_partkey % 2 = 0)::DOUBLE / count(*)', 4)} AS match_rate, count(*) FILTER (l_partkey % 2 = 0 AND l_partkey % 5 = 0) AS with_nutrition FROM lineitem GROUP BY 1)
  SELECT *, CASE WHEN total = 0 THEN 'rejected' WHEN match_rate < 0.4 THEN 'dormant' WHEN match_rate < 0.7 THEN 'needs_ingredient_mapping' WHEN with_nutrition <= 0 THEN 'needs_nutrition' ELSE 'usable' END AS usability FROM m""")
def recipe_usability(spark, d):
    k = F.col("l_partkey")
    return Z.usability(read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.count("*").alias("total"), rate(F.count_if(k % 2 == 0), F.count("*")).alias("match_rate"), F.count_if((k % 2 == 0) & (k % 5 == 0)).alias("with_nutrition")))


@query("enrichment_pilot", """WITH h AS (SELECT p_partkey, contains(p_name, 'red')::INT + contains(p_name, 'gear')::INT AS q, contains(p_name, 'hot')::INT AS c, contains(p_name, 'small')::INT AS g, (p_type = 'ECONOMY')::INT AS groups, p_size, p_brand FROM part), s AS (SELECT *, q * 12 + c * 8 + g * 5 + groups * 8 AS n FROM h)
  SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 0 ELSE n + CASE WHEN p_size > 25 AND n > 0 THEN 10 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END END::INTEGER AS score FROM s ORDER BY score DESC, p_partkey LIMIT 40""")
def enrichment_pilot(spark, d):
    has = lambda w: F.contains("p_name", F.lit(w)).cast("int")
    rows = read(spark, d, "part").select("p_partkey", (has("red") + has("gear")).alias("query_hits"), has("hot").alias("concept_hits"), has("small").alias("group_hits"), (F.col("p_type") == "ECONOMY").cast("int").alias("groups"), (F.col("p_size") > 25).alias("aligned"), (F.col("p_size") % 2 == 0).alias("enriched"), (F.col("p_brand") == "Brand#2").alias("excluded"))
    return Z.pilot_scores(rows).select("p_partkey", "score").orderBy(F.desc("score"), "p_partkey").limit(40)


@query("inventory_merge", f"""WITH i AS (SELECT l_suppkey AS owner, l_partkey % 50 AS ingredient, l_quantity AS quantity, {R('1 - l_discount')} AS remaining, strftime(l_shipdate, '%Y-%m-%d') AS expires FROM lineitem)
  SELECT owner, ingredient, {sql_sum('quantity')} AS quantity, {R(f"{sql_sum('quantity * remaining')} / {sql_sum('quantity')}", 4)} AS remaining, max(expires) AS expires, count(*) AS merged FROM i GROUP BY ALL""")
def inventory_merge(spark, d):
    i = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 50).alias("ingredient"), F.col("l_quantity").alias("quantity"), rounded(1 - F.col("l_discount")).alias("remaining"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("expires"))
    return Z.merge_inventory(i, ["owner", "ingredient"])


@query("analytics_window_summary", f"""WITH w AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS ORDER BY ts DESC, event_id DESC LIMIT 500)
  SELECT count(*) AS records, {R("count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*)", 4)} AS purchase_rate, {R(sql_avg(R('value')))} AS mean_value FROM w""")
def analytics_window_summary(spark, d):
    w = Z.last_records(read(spark, d, "events"), "ts", "event_id", 10, 500)
    return w.agg(F.count("*").alias("records"), rate(F.count_if(F.col("event_type") == "purchase"), F.count("*")).alias("purchase_rate"), rounded(exact_avg(rounded(F.col("value")))).alias("mean_value"))


@query("coordinate_diagnostics", f"""WITH c AS (SELECT s_nationkey, s_suppkey % 3 AS kind, {R('(s_suppkey % 10) / 10.0::DOUBLE')} AS confidence FROM supplier)
  SELECT s_nationkey, count(*) AS locations, count(*) FILTER (kind = 0) AS reviewed, {R('count(*) FILTER (kind < 2)::DOUBLE / count(*)', 4)} AS coverage, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM c GROUP BY 1""")
def coordinate_diagnostics(spark, d):
    c = read(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 3).alias("kind"), rounded(F.col("s_suppkey") % 10 / F.lit(10.0)).alias("confidence"))
    q = F.col("confidence")
    return c.groupBy("s_nationkey").agg(F.count("*").alias("locations"), F.count_if(F.col("kind") == 0).alias("reviewed"), rate(F.count_if(F.col("kind") < 2), F.count("*")).alias("coverage"), F.count_if(q >= 0.8).alias("high"), F.count_if((q >= 0.5) & (q < 0.8)).alias("medium"), F.count_if(q < 0.5).alias("low"))


@query("shopping_pipeline", f"""WITH {CANDIDATES}, b AS (SELECT *, row_number() OVER (PARTITION BY plan_id, ingredient_key ORDER BY line_cost, product_id) AS k FROM costed)
  SELECT plan_id, count(*) AS items, {R(sql_sum('line_cost'))} AS basket_total, sum(units_needed)::BIGINT AS units FROM b WHERE k = 1 GROUP BY 1""")
def shopping_pipeline(spark, d):
    """Requirements, inventory, candidates and the cheapest candidate of each item, summed to one basket a plan: the steps of a plan's shopping in one go."""
    c = _candidates(spark, d)
    best = c.groupBy("plan_id", "ingredient_key").agg(F.min(F.struct("line_cost", "product_id", "units_needed")).alias("b"))
    return best.groupBy("plan_id").agg(F.count("*").alias("items"), rounded(F.sum(F.col("b.line_cost").cast("decimal(18,4)")).cast("double")).alias("basket_total"), F.sum("b.units_needed").alias("units"))
