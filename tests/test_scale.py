"""How queries are run on large tables: what moves between tasks, and what a group costs."""

import re

from pyspark.sql import functions as F


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_meal_plans_start_no_group_in_python(spark):
    """A profile's plan was a pandas group of its own; now a task's profiles go through in batches, and a recipe's rows move once for the plan."""
    from tallyspark.operators import nutrition as N

    rows = [(p, r, m, True, "c" if r % 2 else None, (r * 7 + p) % 10 / 10) for p in range(3) for r in range(6) for m in ("a", "b")]
    plan = planned(N.meal_plans(spark.createDataFrame(rows, "profile_id long, recipe_id long, meal_type string, fits boolean, cuisine string, score double"), 2, ["a", "b"]))
    assert "FlatMapGroups" not in plan and plan.count("Exchange ") == 1


ITEMS = [(1, 10, 2.0), (1, 11, 1.0), (1, 12, 3.0), (2, 10, 1.0), (3, 13, 1.0)]
PRICES = [(10, "A", 1.25), (10, "B", 0.125), (11, "B", 2.0), (11, "C", 3.5), (12, "C", 9.99), (13, "B", 4.0)]


def basket_tables(spark):
    return spark.createDataFrame(ITEMS, "basket_id long, canonical_product_id long, quantity double"), spark.createDataFrame(PRICES, "canonical_product_id long, chain_id string, price double")


def moved_by(plan: str) -> list[str]:
    return re.findall(r"hashpartitioning\(([^)]*)", re.sub(r"#\d+L?", "", plan))


def test_basket_lines_never_move_by_chain(spark):
    """Lines were multiplied by the chains of their products first and then shuffled by basket and chain."""
    from tallyspark.operators import basket as B

    items, prices = basket_tables(spark)
    for df in (B.chain_options(items, prices), B.best_single(B.chain_options(items, prices)), B.candidate_chains(B.chain_options(items, prices)), B.legacy_options(items, prices), B.basket_combinations(items, prices)):
        assert not [k for k in moved_by(planned(df)) if "chain_id" in k or "combo" in k]
    got = {(r["basket_id"], r["chain_id"]): (r["priced_item_count"], r["actual_total"], r["missing_item_count"]) for r in B.chain_options(items, prices).collect()}
    # 0.125 isn't whole cents, and stays what it is
    assert got == {(1, "A"): (1, 2.5, 2), (1, "B"): (2, 2.25, 1), (1, "C"): (2, 33.47, 1), (2, "A"): (1, 1.25, 0), (2, "B"): (1, 0.13, 0), (3, "B"): (1, 4.0, 0)}


def test_basket_options_by_places_of_names(spark):
    """Chains as places in their names' order give what the names give, and the single chain comes with its counts."""
    from tallyspark.operators import basket as B

    items, prices = basket_tables(spark)
    names = ["A", "B", "C"]
    coded = prices.withColumn("chain_id", (F.ascii("chain_id") - 65).cast("short"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(B.best_options(items, prices)) == rows(B.best_options(items, coded, names))
    assert rows(B.legacy_options(items, prices)) == rows(B.legacy_options(items, coded, names))
    assert rows(B.basket_combinations(items, prices)) == rows(B.basket_combinations(items, coded, names))
    single = B.best_single(B.chain_options(items, prices))
    assert rows(B.single_of(B.best_options(items, prices)).select(*single.columns)) == rows(single)


def test_plans_lines_never_move_by_chain(spark):
    from tallyspark.operators.intent import plan_shopping

    required = spark.createDataFrame([(1, "a", 10.0), (1, "b", 0.0), (2, "a", 25.0)], "plan_id long, ingredient_key string, net_grams double")
    packages = spark.createDataFrame([("a", 7, 10.0)], "ingredient_key string, product_id long, package_grams double")
    prices = spark.createDataFrame([(7, "A", 1.5), (7, "B", 1.4)], "product_id long, chain_id string, price double")
    found = plan_shopping(required, packages, prices)
    assert not [k for k in moved_by(planned(found)) if "chain_id" in k]
    assert sorted(map(tuple, found.collect())) == [(1, "B", 1, 1, 0, 1.4), (2, "B", 1, 1, 0, 4.2)]


def test_pairs_are_those_of_the_join(spark):
    """Pairs scored in a task are those of candidates and match_score; none of them moves."""
    from tallyspark.operators import matching as M
    from tallyspark.operators import pairs as V

    qs = [(1, "red gear", ["red", "gear"], 5.0, None, ["gearx", "red g"]), (2, "b x", ["b", "x", "b"], None, 1.5, None), (3, "none", ["none"], 1.0, 1.0, []), (4, "empty", None, None, None, None), (5, "red gear", ["red", "gear"], 5.0, None, ["gearx", "red g"])]
    ps = [(i, ["red gear", "b x", "blue red gear", None][i % 4], [["b x"], [], None, ["red gear"]][i % 4], ["b", "red", None][i % 3], [5.0, None][i % 2], [1.5, None, 2.0][i % 3], [0.7, None, 1.3][i % 3], [["red", "gear", "red"], ["b"], ["x", "b"], None][i % 4]) for i in range(40)]
    q = spark.createDataFrame(qs, "query_id long, q_name string, q_tokens array<string>, q_size double, q_percent double, canonical_terms array<string>")
    p = spark.createDataFrame(ps, "product_id long, name string, aliases array<string>, brand string, size double, percent double, confidence double, tokens array<string>")
    joined = M.match_score(M.candidates(q.withColumnRenamed("q_tokens", "tokens"), p).join(q, "query_id").join(p, "product_id"))
    rows = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    got = V.pairs(q, p)
    assert "hashpartitioning" not in planned(got)
    assert rows(got, "query_id", "product_id", "shared", "score") == rows(joined, "query_id", "product_id", "shared", "score")
    assert rows(M.top_n(V.pairs(q, p, top=3), 3), "query_id", "product_id", "rank") == rows(M.top_n(joined, 3), "query_id", "product_id", "rank")
    tests = [F.col("brand") == "b", F.col("shared") >= 2]
    assert rows(V.soft_filtered(q, p.withColumn("flag", F.col("brand") == "b"), 2), "query_id", "product_id") == rows(M.soft_filter(joined.select("query_id", "product_id", "brand", "shared"), tests), "query_id", "product_id")
    least = joined.groupBy("query_id").agg(F.min("product_id").alias("least"))
    assert rows(V.least_of(q, p, "product_id"), "query_id", "least") == rows(least, "query_id", "least")
    assert V.pairs(q.limit(0), p).count() == 0 and V.pairs(q, p.limit(0)).count() == 0


def test_origins_of_one_file_are_dealt_out(spark):
    """All pairs of a small file of origins were one task's work; the cheap test of chords loses none at any distance."""
    from tallyspark.operators import places as G

    near = [(i, 42.0 + i * 0.0013, 23.0 + i * 0.0007) for i in range(120)] + [(500, 89.9, 10.0), (501, 89.95, -170.0), (502, 0.0, 179.99), (503, 0.0, -179.99), (504, 95.0, 1.0)]
    o = spark.createDataFrame(near, "origin_id long, lat double, lon double").coalesce(1)
    p = o.withColumnRenamed("origin_id", "place_id")
    assert "hashpartitioning(origin_id" in planned(G.within(o, p, 5.0))
    for km in (0.161, 5.0, 30.0, 15000.0):
        pairs = o.crossJoin(p.select("place_id", F.col("lat").alias("b"), F.col("lon").alias("c"))).withColumn("distance_km", G.haversine(F.col("lat"), F.col("lon"), F.col("b"), F.col("c")))
        want = sorted(map(tuple, pairs.filter(F.col("distance_km") <= km).select("origin_id", "place_id", "distance_km").collect()))
        assert sorted(map(tuple, G.within(o, p, km).collect())) == want


def test_distances_are_counted_before_they_are_ranked(spark):
    """The percentile kept every value of the pairs in an aggregate of objects."""
    from tallyspark.operators import places as G

    d = spark.createDataFrame([(float(x % 37) / 8,) for x in range(1000)] + [(None,)], "distance_km double")
    got = G.distance_summary(d)
    assert "percentile" not in planned(got)
    want = d.agg(F.count("distance_km"), F.max("distance_km"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY distance_km)"), F.avg("distance_km")).first()
    r = got.first()
    assert (r["count"], r["max_km"], r["p95_km"]) == tuple(want)[:3] and abs(r["mean_km"] - want[3]) < 0.001
    assert tuple(G.distance_summary(d.limit(0)).first()) == (0, None, None, None)


def test_lists_are_matched_where_the_products_lie(spark):
    """Pairs of items and products were joined by word and counted in a shuffle."""
    from tallyspark.operators import intent as I

    items = spark.createDataFrame([(1, "red ring", "ring", None, "5g", None), (2, "blue gear", None, "BIG", None, "2"), (3, "zzz", None, None, None, None)], "item_id long, name string, base_hint string, category_hint string, volume string, count string")
    ps = [(i, ["red ring", "blue gear x", "red gear"][i % 3], ["ring", "gear"][i % 2], ["BIG", None][i % 2], ["acme", "blue"][i % 2], ["5g", "6g", None][i % 3], ["2", None][i % 2], 0.01 * i) for i in range(12)]
    products = spark.createDataFrame(ps, "product_id long, name string, base_product string, category string, brand string, volume string, count string, confidence double")
    prices = products.select("product_id", (F.lit(20.0) - F.col("product_id") % 4).alias("price"))
    got = I.match_list(items, products)
    assert "hashpartitioning" not in planned(got)

    def score(item, p):
        words = item["name"].split()
        shared = len(set(words) & set(f"{p['name']} {p['base_product']} {p['brand']}".split()))
        sign = sum(0 if item[c] is None or p[c] is None else 1 if item[c] == p[c] else -1 for c in ("volume", "count"))
        name = 0.12 if item["name"] == p["name"] else 0.08 if item["name"] in p["name"] else 0.0
        s = shared / len(words) * 0.55 + name + 0.15 * (item["base_hint"] == p["base_product"]) + 0.08 * (item["category_hint"] is not None and item["category_hint"] == p["category"]) + 0.12 * (p["brand"] in words) + sign * 0.18 + p["confidence"] * 0.05
        return round(s, 4) if shared else 0

    rows = [(i["item_id"], p["product_id"], score(i, p)) for i in items.collect() for p in products.collect()]
    want = {r[:2]: r[2] for r in rows if r[2] > 0}
    assert {(r["item_id"], r["product_id"]): r["score"] for r in got.collect()} == want
    joined = got.join(prices, "product_id")
    policy = {p: {r["item_id"]: (r["status"], r["product_id"]) for r in I.ambiguity_policy(joined, p).collect()} for p in ("strict", "best", "cheapest")}
    found = I.list_policies(items, products, prices)
    assert {r["item_id"]: (r["strict_status"], r["strict_product"], r["best_product"], r["cheapest_product"]) for r in found.collect()} == {i: (*policy["strict"][i], policy["best"][i][1], policy["cheapest"][i][1]) for i in policy["best"]}


def test_runs_of_tokens_are_not_broadcast(spark):
    """Runs are many times the texts they are cut from, which the planner doesn't see."""
    from tallyspark.operators import vocabulary as V

    texts = spark.createDataFrame([(1, ["hot", "ring", "hot"]), (2, ["ring"])], "id long, tokens array<string>")
    aliases = spark.createDataFrame([("hot ring", "a"), ("ring", "b")], "alias string, target string")
    found = V.matches(texts, aliases, "id", "tokens", join=True)
    assert "Broadcast" not in planned(found)
    assert sorted(map(tuple, found.collect())) == [(1, 0, "hot ring", "a"), (1, 1, "ring", "b"), (2, 0, "ring", "b")]


def test_a_page_is_sorted_by_no_single_task(spark, tmp_path):
    """A page's rows were the first ones of a sort with a limit, which one task holds; rows of one key stay together."""
    from tallyspark.operators import prices as P
    from tallyspark.sources import replication as S

    rows = [(f"k{i % 40:02}", float(i + 1), "2020-01-01") for i in range(41)]  # k00 twice
    offers = spark.createDataFrame(rows, "source_product_id string, current_price double, snapshot_date string")
    seen, after = [], None
    while (last := S.export_baseline(offers, f"{tmp_path}/lines", after=after, limit=7)) is not None:
        seen.append(last)
        after = last
    assert seen == ["k05", "k12", "k19", "k26", "k33", "k39"]
    assert spark.read.json(f"{tmp_path}/lines").count() == 41
    assert not re.search("TakeOrdered|GlobalLimit|CollectLimit", planned(S.page_of(offers, 7)))
    few = P.current_offers(spark.createDataFrame([("a", "1", "x", "2020-01-01", "2020-01-01", "s", "st", "n", "b", "c", 2.0, 1.0)], "source_product_id string, canonical_product_id string, locality_code string, snapshot_date string, ingested_at string, snapshot_id string, store_name string, product_name string, brand string, category_code string, retail_price double, promo_price double"), "source_product_id", "current_price")
    structs = re.findall(r"max\(struct\((.*?)\)\)", planned(few))
    assert structs and not [x for x in structs if "product_name" in x] and few.columns == ["source_product_id", "current_price"] and tuple(few.first()) == ("a", 1.0)
