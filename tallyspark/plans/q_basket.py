"""Queries over baskets: every order is one, its parts the items, nations the chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import basket as B
from tallyspark.operators import prices as P
from tallyspark.plans.adapter import LATEST, read, snapshots, sql_avg, sql_round, sql_sum
from tallyspark.plans.registry import query

R = sql_round

BASE = f"""{LATEST}, items AS (SELECT l_orderkey AS basket_id, l_partkey AS canonical_product_id, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
prices AS (SELECT canonical_product_id, chain_id, min(current_price) AS price FROM offers GROUP BY ALL), sizes AS (SELECT basket_id, count(*) AS item_count FROM items GROUP BY 1),
totals AS (SELECT basket_id, chain_id, count(*) AS priced_item_count, {R(sql_sum(R('price * quantity')))} AS actual_total FROM items JOIN prices USING (canonical_product_id) GROUP BY ALL),
options AS (SELECT *, item_count - priced_item_count AS missing_item_count, {R('actual_total + (item_count - priced_item_count) * 999.0::DOUBLE')} AS score_total, {R('priced_item_count::DOUBLE / item_count', 4)} AS coverage_ratio FROM totals JOIN sizes USING (basket_id)),
single AS (SELECT basket_id, chain_id, score_total, actual_total, priced_item_count, missing_item_count, coverage_ratio FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY score_total, coverage_ratio DESC, actual_total, chain_id) AS k FROM options) WHERE k = 1)"""

def _multi(chains: str) -> str:
    """SQL up to the table multi, for combinations of the chains of one table: selling (all) or chosen (the legacy plan's four)."""
    return f"""{BASE}, selling AS (SELECT basket_id, chain_id FROM options), chosen AS (SELECT basket_id, chain_id FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY priced_item_count DESC, actual_total, chain_id) AS k FROM options) WHERE k <= 4),
combos AS (SELECT a.basket_id, [a.chain_id, b.chain_id] AS chains FROM {chains} a JOIN {chains} b ON a.basket_id = b.basket_id AND a.chain_id < b.chain_id
  UNION ALL SELECT a.basket_id, [a.chain_id, b.chain_id, c.chain_id] FROM {chains} a JOIN {chains} b ON a.basket_id = b.basket_id AND a.chain_id < b.chain_id JOIN {chains} c ON a.basket_id = c.basket_id AND b.chain_id < c.chain_id),
slots AS (SELECT basket_id, array_to_string(chains, '|') AS combo, len(chains)::INTEGER AS store_count, unnest(chains) AS chain_id FROM combos),
cheapest AS (SELECT basket_id, combo, store_count, canonical_product_id, min(price) AS price, any_value(quantity) AS quantity FROM items JOIN prices USING (canonical_product_id) JOIN slots USING (basket_id, chain_id) GROUP BY ALL),
mtotals AS (SELECT basket_id, combo, store_count, count(*) AS priced_item_count, {R(sql_sum(R('price * quantity')))} AS actual_total FROM cheapest GROUP BY ALL),
moptions AS (SELECT *, item_count - priced_item_count AS missing_item_count, {R('actual_total + (item_count - priced_item_count) * 999.0::DOUBLE')} AS score_total, {R('priced_item_count::DOUBLE / item_count', 4)} AS coverage_ratio FROM mtotals JOIN sizes USING (basket_id)),
mbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY score_total, coverage_ratio DESC, actual_total, store_count, combo) AS k FROM moptions) WHERE k = 1),
multi AS (SELECT m.basket_id, combo, store_count, m.score_total, m.actual_total, m.coverage_ratio, {R('s.actual_total - m.actual_total')} AS savings,
  m.coverage_ratio >= s.coverage_ratio AND {R('s.actual_total - m.actual_total')} >= 0.5 AND m.score_total <= s.score_total AS recommended FROM mbest m JOIN single s USING (basket_id))"""


LEGACY = _multi("chosen")

#: The same for all selling chains, with each basket's prices in one row (p: a list over chains), as the combinations are many.
MULTI = f"""{BASE}, numbered AS (SELECT chain_id, row_number() OVER (ORDER BY chain_id) AS k FROM (SELECT DISTINCT chain_id FROM prices)),
wide AS (SELECT canonical_product_id, list(price ORDER BY k) AS p FROM (SELECT DISTINCT canonical_product_id FROM prices) CROSS JOIN numbered LEFT JOIN prices USING (canonical_product_id, chain_id) GROUP BY 1),
lines_ AS (SELECT basket_id, list({{'q': quantity, 'p': p}}) AS lines FROM items JOIN wide USING (canonical_product_id) GROUP BY 1),
selling AS (SELECT basket_id, chain_id, k FROM options JOIN numbered USING (chain_id)),
combos AS (SELECT a.basket_id, [a.chain_id, b.chain_id] AS chains, a.k AS ka, b.k AS kb, b.k AS kc FROM selling a JOIN selling b ON a.basket_id = b.basket_id AND a.chain_id < b.chain_id
  UNION ALL SELECT a.basket_id, [a.chain_id, b.chain_id, c.chain_id], a.k, b.k, c.k FROM selling a JOIN selling b ON a.basket_id = b.basket_id AND a.chain_id < b.chain_id JOIN selling c ON a.basket_id = c.basket_id AND b.chain_id < c.chain_id),
costs AS (SELECT basket_id, chains, list_filter(list_transform(lines, lambda l: {R('least(l.p[ka], l.p[kb], l.p[kc]) * l.q')}), lambda x: x IS NOT NULL) AS c FROM combos JOIN lines_ USING (basket_id)),
mtotals AS (SELECT basket_id, chains, len(c) AS priced_item_count, {R('list_sum(c)')} AS actual_total FROM costs),
moptions AS (SELECT basket_id, chains, actual_total, {R('actual_total + (item_count - priced_item_count) * 999.0::DOUBLE')} AS score_total, {R('priced_item_count::DOUBLE / item_count', 4)} AS coverage_ratio FROM mtotals JOIN sizes USING (basket_id)),
mbest AS (SELECT basket_id, min({{'score': score_total, 'cover': -coverage_ratio, 'total': actual_total, 'stores': len(chains), 'combo': array_to_string(chains, '|')}}) AS b FROM moptions GROUP BY 1),
multi AS (SELECT m.basket_id, b.combo AS combo, b.stores::INTEGER AS store_count, b.score AS score_total, b.total AS actual_total, -b.cover AS coverage_ratio, {R('s.actual_total - b.total')} AS savings,
  -b.cover >= s.coverage_ratio AND {R('s.actual_total - b.total')} >= 0.5 AND b.score <= s.score_total AS recommended FROM mbest m JOIN single s USING (basket_id))"""


def _items(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("canonical_product_id")).agg(F.max("l_quantity").alias("quantity"))


def parts(spark, d):
    return _items(spark, d), B.chain_prices(P.latest_prices(snapshots(spark, d)))


def coded(spark, d):
    """The same with chains as their places in the order of their names, and the names: numbers are what moves. Chains are nations, a fixed dimension."""
    names = sorted(r[0] for r in read(spark, d, "nation").select("n_name").distinct().collect() if r[0] is not None)
    place = (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("chain_id")) - 1).cast("short" if len(names) < 1 << 15 else "int")
    return _items(spark, d), B.chain_prices(P.latest_prices(snapshots(spark, d)).withColumn("chain_id", place)), names


def _options(spark, d):
    items, prices, names = coded(spark, d)
    return B.chain_options(items, prices), names


def _named(rows, names):
    return rows.withColumn("chain_id", B.named(F.col("chain_id"), names))


@query("basket_chain_options", f"WITH {BASE} SELECT basket_id, chain_id, priced_item_count, missing_item_count, actual_total, score_total, coverage_ratio FROM options")
def basket_chain_options(spark, d):
    return _named(*_options(spark, d)).drop("item_count").select("basket_id", "chain_id", "priced_item_count", "missing_item_count", "actual_total", "score_total", "coverage_ratio")


@query("basket_single_chain", f"WITH {BASE} SELECT * FROM single")
def basket_single_chain(spark, d):
    options, names = _options(spark, d)
    return _named(B.best_single(options), names)


@query("store_coverage_ranking", f"WITH {LEGACY} SELECT * FROM chosen")
def store_coverage_ranking(spark, d):
    options, names = _options(spark, d)
    return _named(B.candidate_chains(options), names)


@query("store_combinations", f"WITH {MULTI} SELECT basket_id, len(chains)::INTEGER AS store_count, count(*) AS combinations, min(array_to_string(chains, '|')) AS first_combo, max(array_to_string(chains, '|')) AS last_combo FROM combos GROUP BY ALL")
def store_combinations(spark, d):
    """How many pairs and triples of selling chains each basket has, with the first and the last of them."""
    return B.basket_combinations(*coded(spark, d))


@query("basket_multi_store", f"WITH {MULTI} SELECT * FROM multi")
def basket_multi_store(spark, d):
    return B.best_multi(B.best_options(*coded(spark, d)))


@query("basket_convenience", f"""WITH {MULTI}, p AS (SELECT basket_id, combo, score_total, {R("greatest(store_count - 1, 0) * 1.5::DOUBLE + CASE WHEN store_count > 1 THEN 1.5::DOUBLE ELSE 0 END + greatest(store_count - 2, 0) * 1.5::DOUBLE + len(list_filter(string_split(combo, '|'), lambda c: c NOT IN ('NATION_1', 'NATION_2', 'NATION_3'))) * 0.75::DOUBLE + len(list_filter(string_split(combo, '|'), lambda c: c IN ('NATION_9'))) * 999.0::DOUBLE")} AS penalty_total FROM multi)
  SELECT basket_id, combo, penalty_total, {R('score_total + penalty_total')} AS convenience_score FROM p""")
def basket_convenience(spark, d):
    rows = basket_multi_store(spark, d)
    return B.convenience(rows, F.split("combo", r"\|"), F.col("store_count"), ["NATION_1", "NATION_2", "NATION_3"], ["NATION_9"], 2, True).select("basket_id", "combo", "penalty_total", "convenience_score")


@query("basket_legacy_plan", f"WITH {LEGACY} SELECT basket_id, combo, {R('actual_total + 0.75::DOUBLE * store_count + 1000.0::DOUBLE * missing_item_count + 0.2::DOUBLE * (1 - coverage_ratio)', 4)} AS plan_score FROM moptions")
def basket_legacy_plan(spark, d):
    return B.legacy_plan(B.legacy_options(*coded(spark, d))).select("basket_id", "combo", "plan_score")


METRICS = f"""{BASE}, metrics AS (SELECT count(*) AS baskets, {R(sql_avg('coverage_ratio'), 4)} AS mean_coverage, {R(sql_avg('actual_total'))} AS mean_total, {R('count(*) FILTER (missing_item_count = 0)::DOUBLE / count(*)', 4)} AS complete_rate, max(missing_item_count) AS most_missing FROM single)"""


@query("basket_quality_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def basket_quality_metrics(spark, d):
    return B.quality_metrics(basket_single_chain(spark, d))


@query("basket_health", f"""WITH {METRICS}, a AS (SELECT list_filter([CASE WHEN mean_coverage < 0.6 THEN 'low_coverage' END, CASE WHEN complete_rate < 0.5 THEN 'incomplete_baskets' END, CASE WHEN most_missing > 5 THEN 'many_missing' END], lambda t: t IS NOT NULL) AS x FROM metrics)
  SELECT array_to_string(x, ',') AS alerts, CASE len(x) WHEN 0 THEN 'healthy' WHEN 1 THEN 'warning' ELSE 'critical' END AS status FROM a""")
def basket_health(spark, d):
    return B.health(basket_quality_metrics(spark, d))


@query("basket_explanation", f"WITH {MULTI} SELECT basket_id, CASE WHEN recommended THEN printf('Split over %d stores to save %.2f.', store_count, savings) ELSE 'One store is the better choice.' END AS headline FROM multi")
def basket_explanation(spark, d):
    return B.explanation(basket_multi_store(spark, d))


@query("basket_plan", f"""WITH {BASE}, s AS (SELECT canonical_product_id, count(*) AS sellers FROM prices GROUP BY 1), t AS (SELECT basket_id, CASE WHEN sellers IS NULL THEN 'unresolved' WHEN sellers < 3 THEN 'clarify' ELSE 'ready' END AS status FROM items LEFT JOIN s USING (canonical_product_id))
  SELECT basket_id, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'clarify') AS clarify, count(*) FILTER (status = 'unresolved') AS unresolved, bool_and(status = 'ready') AS is_ready FROM t GROUP BY 1""")
def basket_plan(spark, d):
    return B.plan(*parts(spark, d))


@query("tier_view", f"WITH {MULTI} SELECT basket_id, coalesce(tier, 'free') AS tier, CASE WHEN tier = 'premium' THEN combo END AS combo, CASE WHEN tier = 'premium' THEN savings END AS savings FROM multi LEFT JOIN (SELECT o_orderkey AS basket_id, CASE WHEN o_custkey % 2 = 0 THEN 'premium' END AS tier FROM orders) USING (basket_id)")
def tier_view(spark, d):
    tiers = read(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.when(F.col("o_custkey") % 2 == 0, "premium").alias("tier"))
    return B.tier_view(basket_multi_store(spark, d), tiers)


#: Candidates of each order line: its part, and the part after it at a worse match, at the chains that sell them.
MATCHED = f"""{BASE}, cand AS (SELECT basket_id, i.canonical_product_id AS item_id, p.canonical_product_id AS product_id, chain_id AS store, price, CASE WHEN p.canonical_product_id = i.canonical_product_id THEN 0.9::DOUBLE ELSE 0.3 + (chain_id = 'NATION_3')::INT * 0.65::DOUBLE END AS match_score
  FROM items i JOIN prices p ON p.canonical_product_id IN (i.canonical_product_id, i.canonical_product_id + 1)),
kept AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY basket_id, item_id ORDER BY match_score DESC, price, product_id, store) <= 4),
st AS (SELECT basket_id, store, count(DISTINCT item_id) AS cover, {sql_sum('price')} AS total, {sql_sum('match_score')} AS match FROM kept GROUP BY ALL), ch AS (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY cover DESC, total, match DESC, store) AS r FROM st QUALIFY r <= 4),
pl AS (SELECT basket_id, [store] AS stores FROM ch UNION ALL SELECT a.basket_id, list_sort([a.store, b.store]) FROM ch a JOIN ch b ON a.basket_id = b.basket_id AND a.r < b.r UNION ALL SELECT a.basket_id, list_sort([a.store, b.store, c.store]) FROM ch a JOIN ch b ON a.basket_id = b.basket_id AND a.r < b.r JOIN ch c ON a.basket_id = c.basket_id AND b.r < c.r),
per AS (SELECT basket_id, stores, item_id, min({{'price': price, 'm': -match_score, 'store': store, 'product': product_id}}) AS b FROM (SELECT basket_id, stores, unnest(stores) AS store FROM pl) JOIN kept USING (basket_id, store) GROUP BY ALL),
pg AS (SELECT basket_id, stores, count(*) AS matched, {sql_sum('b.price')} AS cost, -{sql_sum('b.m')} / count(*) AS mean FROM per GROUP BY ALL),
sc AS (SELECT basket_id, array_to_string(stores, '|') AS stores, len(stores)::INTEGER AS store_count, {R('cost')} AS total_cost, matched, item_count - matched AS unmatched, {R('mean', 4)} AS match_average, {R('cost + len(stores) * 0.75::DOUBLE + (item_count - matched) * 1000.0::DOUBLE + (1 - mean) * 0.2::DOUBLE', 4)} AS score FROM pg JOIN sizes USING (basket_id))"""


@query("match_plans", f"WITH {MATCHED} SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY unmatched, score, total_cost, store_count, stores) = 1 AS best FROM sc")
def match_plans(spark, d):
    """Plans of the legacy optimiser, with its limits and the match term; substitutes match less, but at one chain better."""
    items, prices = parts(spark, d)
    p = prices.select(F.col("canonical_product_id").alias("product_id"), F.col("chain_id").alias("store"), "price")
    asked = items.select("basket_id", F.col("canonical_product_id").alias("item_id"), F.explode(F.array(F.col("canonical_product_id"), F.col("canonical_product_id") + 1)).alias("product_id"))
    score = F.when(F.col("product_id") == F.col("item_id"), 0.9).otherwise(F.lit(0.3) + F.when(F.col("store") == "NATION_3", 1).otherwise(0) * F.lit(0.65))
    found = asked.join(p, "product_id", "left").withColumn("match_score", F.when(F.col("store").isNotNull(), score)).withColumn("product_id", F.when(F.col("store").isNotNull(), F.col("product_id")))
    return B.match_plans(found)
