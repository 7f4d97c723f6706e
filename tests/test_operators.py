"""Facts about single operators on small tables: thresholds, ties, nulls, empty input."""

import io
import zipfile

from pyspark.sql import functions as F

from tallyspark.functions import money, text
from tallyspark.operators import changes, demand, nutrition, places, prices, watch
from tallyspark.sources import snapshots, tables


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_effective_price(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0), (None, 1.0)], "retail double, promo double")
    got = rows.select(money.effective_price(F.col("retail"), F.col("promo")).alias("s"), money.effective_price(F.col("retail"), F.col("promo"), False).alias("l")).collect()
    assert [r["s"] for r in got] == [1.0, 2.0, 2.0, None, None]
    assert [r["l"] for r in got] == [1.0, 2.0, 2.0, 0.0, None]


def test_rounding(spark):
    r = one(spark, a=money.rounded(F.lit(1.005)), b=money.rounded(F.lit(2.5), 0), c=money.rounded(F.lit(None).cast("double")))
    assert (r["a"], r["b"], r["c"]) == (1.01, 3.0, None)


def test_deal_levels(spark):
    rows = spark.createDataFrame([("a", 1, 8.0), ("b", 1, 12.0), ("c", 1, 10.0), ("d", 2, 5.0)], "offer_id string, canonical_product_id int, current_price double")
    got = {r["offer_id"]: r for r in prices.deals(rows).collect()}
    assert [got[k]["deal_level"] for k in "abcd"] == ["good", "expensive", "normal", "normal"]
    assert got["a"]["deal_score"] == 0.85 and got["b"]["deal_score"] == 0.15
    assert got["a"]["reason"] == "price is 20% below recent average"


def test_latest_per_key_ties_and_empty(spark):
    rows = spark.createDataFrame([("p", "2020-01-01", "1", 1.0), ("p", "2020-01-01", "2", 2.0), ("q", None, "1", 3.0)], "k string, d string, s string, price double")
    got = {r["k"]: r["price"] for r in prices.latest_per_key(rows, ["k"], ["d", "s"]).collect()}
    assert got == {"p": 2.0, "q": 3.0}
    assert prices.latest_per_key(rows.limit(0), ["k"], ["d", "s"]).count() == 0


def test_stale(spark):
    rows = spark.createDataFrame([("2020-01-01",), ("2019-12-01",), ("x",), (None,)], "d string")
    got = [r[0] for r in rows.select(prices.is_stale(F.col("d"), "2020-01-10", 30)).collect()]
    assert got == [False, True, True, True]


def test_change_classes(spark):
    schema = "source_product_id string, canonical_product_id int, current_price double, retail_price double, promo_price double, is_sale boolean, is_available boolean, chain_id string, store_id string, category_code string, product_name string, snapshot_date string"
    base = ("a", 1, 1.0, 1.0, 0.0, False, True, "c", "s", "k", "n", "2020-01-01")
    alter = lambda i, **kw: tuple(kw.get(k.split()[0], v) if k.split()[0] != "source_product_id" else i for k, v in zip(schema.split(", "), base))
    old = [alter(i) for i in ("same", "price", "promo", "avail", "map", "meta", "gone")]
    new = [alter("same", snapshot_date="2020-01-02"), alter("price", current_price=2.0, is_sale=True), alter("promo", is_sale=True), alter("avail", is_available=False), alter("map", canonical_product_id=2), alter("meta", product_name="m"), alter("new")]
    diff = changes.diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    got = {r["source_product_id"]: r["change_class"] for r in diff.collect()}
    assert got == {"same": "unchanged", "price": "price_changed", "promo": "promo_changed", "avail": "availability_changed", "map": "canonical_mapping_changed", "meta": "metadata_changed_only", "gone": "missing_removed", "new": "new_offers"}
    plan = changes.writer_plan(changes.manifest(diff, "2020-01-02"), threshold=3).first()
    assert plan["high_write"] and not plan["allowed"]
    assert changes.events(diff, "2020-01-02", "none").count() == 0


def test_gap_ladder(spark):
    rows = [("q", "unresolved", "c", "l", "x", "search", 1.0)] * 11 + [("r", "ambiguous", "c", "l", "x", "search", 9.0)] * 10 + [("s", "resolved", None, None, None, "search", None)] * 10 + [("t", "resolved", "c", "l", "x", "search", None)]
    signals = spark.createDataFrame(rows, "normalized_query string, status string, category_l2 string, locality_code string, chain_id string, source string, avg_price double")
    got = {r["key"]: r["opportunity_type"] for r in demand.opportunities(signals).collect()}
    assert got == {"q": "missing_supply", "r": "poor_match_quality", "s": "emerging_interest"}
    assert demand.opportunities(signals.limit(0)).count() == 0


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("p", "2020-01-02", 1), ("p", "2020-01-01", 2), ("q", "2020-01-05", 3)], "k string, d string, i int")
    right = spark.createDataFrame([("p", "2020-01-01", 5.0), ("p", "2020-01-02", 6.0), ("q", "2020-01-09", 7.0)], "k string, d string, v double")
    got = {r["i"]: r["v_found"] for r in watch.as_of(left, right, "k", "d", ["v"]).collect()}
    assert got == {1: 5.0, 2: None, 3: None}
    loose = {r["i"]: r["v_found"] for r in watch.as_of(left, right, "k", "d", ["v"], strict=False).collect()}
    assert loose == {1: 6.0, 2: 5.0, 3: None}


def test_recurrence(spark):
    days = [("p", f"2020-01-{d:02d}", v) for d, v in ((1, 10.0), (2, 9.0), (3, 10.0), (4, 9.0), (5, 10.0), (6, 9.0), (7, 8.99))]
    r = watch.recurrence(spark.createDataFrame(days, "p string, snapshot_date string, price_min double"), "p").first()
    assert (r["recurring_interval_days"], r["recurrence_confidence"], r["trigger_event_count"], r["latest_trigger_date"]) == (2, 1.0, 3, "2020-01-06")


def test_distance(spark):
    r = one(spark, d=places.haversine(F.lit(42.6977), F.lit(23.3219), F.lit(42.1354), F.lit(24.7453)), n=places.haversine(F.lit(91.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert abs(r["d"] - 132.7) < 1 and r["n"] is None


def test_markers(spark):
    size = text.size_of(F.lit("Milk 1,5 L 3.6%"))
    r = one(spark, v=size["value"], q=text.base_quantity(size), p=text.percent_of(F.lit("Milk 1,5 L 3.6%")), d=text.name_drift(F.lit("Milk 1 l"), F.lit("MILK 2 l")), j=text.name_drift(F.lit("Milk"), F.lit("Bread loaf")), s=text.slug(F.lit("  Ab  c!")))
    assert (r["v"], r["q"], r["p"], r["d"], r["j"], r["s"]) == (1.5, 1500.0, 3.6, "minor", "major", "ab-c")


def test_delimited_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"Locality Code";"Store Name";"Product Code";"Category Code";"Retail Price";"Promo Price"\n1;"S; one";7;k;1,50;\n;T;8;k;x;2,0\n3;short\n', encoding="utf-8")
    assert snapshots.detect_delimiter('"a,b";c;d') == ";"
    raw = snapshots.read_delimited(spark, str(tmp_path / "a.csv"))
    got = snapshots.snapshot_rows(raw, "2020-01-01", "a.csv").orderBy("product_code").collect()
    by = {r["product_code"]: r for r in got}
    assert by["7"]["store_name"] == "S; one" and by["7"]["retail_price"] == 1.5 and by["7"]["promo_price"] == 0.0 and by["7"]["reject_reason"] is None
    assert by["8"]["reject_reason"] == "blank_locality" and by["8"]["retail_price"] is None
    assert by[None]["reject_reason"] == "malformed"
    counts = snapshots.ingest_counts(snapshots.snapshot_rows(raw, "2020-01-01", "a.csv")).first()
    assert (counts["imported_rows"], counts["malformed_rows"], counts["rejected_rows"]) == (1, 1, 2)


def test_archive_source(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("Big Chain_12.csv", "﻿h\nx\n")
        z.writestr("skip.pdf", "no")
    (tmp_path / "day.zip").write_bytes(raw.getvalue())
    got = snapshots.read_archive(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["entry"], r["line"]) for r in got] == [("Big Chain_12.csv", "h"), ("Big Chain_12.csv", "x")]
    chain, number = snapshots.entry_parts(F.lit("Big Chain_12.csv"))
    r = one(spark, c=chain, n=number)
    assert (r["c"], r["n"]) == ("Big Chain", 12)


def test_latest_partition(spark, tmp_path):
    for d in ("2020-01-01", "2020-01-05", "2020-01-20"):
        (tmp_path / f"snapshot_date={d}").mkdir()
    assert snapshots.latest_partition(spark, str(tmp_path), "2020-01-07") == "2020-01-05"
    assert snapshots.latest_partition(spark, str(tmp_path), "2021-01-07") is None


def test_table_versions(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), ["k"])
    t.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"))
    t.upsert(spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string"))
    t.delete(spark.createDataFrame([(3,)], "k int"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (2, "d")]


def test_diff_classes_partition_the_keys(spark):
    from __spark_entry__ import SMOKE_DIR
    from tallyspark.plans.q_changes import sides

    old, new = sides(spark, SMOKE_DIR)
    diff = changes.diff(old, new)
    assert diff.count() == old.select("source_product_id").union(new.select("source_product_id")).distinct().count()


def test_netting_names_only_without_identifier(spark):
    req = spark.createDataFrame([(1, "5", 100.0), (1, "6", 100.0)], "plan_id int, ingredient_key string, required_grams double")
    inv = spark.createDataFrame([(1, "5", "item 5", 30.0), (1, None, "item 5", 90.0), (1, None, "item 6", 250.0)], "plan_id int, ingredient_key string, name string, available double")
    got = {r["ingredient_key"]: (r["net_grams"], r["inventory_status"]) for r in nutrition.net_requirements(req, inv).collect()}
    assert got == {"5": (70.0, "partial"), "6": (0.0, "covered")}


def test_split_over_all_selling_chains(spark):
    """The best pair or triple may need chains that sell few of the items; brute force over all subsets."""
    import random
    from itertools import combinations

    from tallyspark.operators import basket

    rng = random.Random(5)
    # two cheap specialists rank last by coverage, behind five chains that sell all
    prices_ = [(p, f"big{c}", 10.0 + c) for p in range(4) for c in range(5)] + [(0, "few_a", 1.0), (1, "few_a", 1.0), (2, "few_b", 1.0), (3, "few_b", 1.0)]
    prices_ += [(p, f"r{c}", rng.randint(5, 400) / 100) for p in range(10, 30) for c in range(9) if rng.random() < 0.5]
    items_ = [(1, p, 1.0) for p in range(4)] + [(b, p, float(rng.randint(1, 5))) for b in range(2, 12) for p in rng.sample(range(10, 33), 6)] + [(99, 500, 1.0)]
    items = spark.createDataFrame(items_, "basket_id long, canonical_product_id long, quantity double")
    table = spark.createDataFrame(prices_, "canonical_product_id long, chain_id string, price double")
    options = basket.chain_options(items, table)
    got = {r["basket_id"]: r for r in basket.best_multi(basket.best_options(items, table), basket.best_single(options)).collect()}
    assert (got[1]["combo"], got[1]["actual_total"], got[1]["savings"], got[1]["recommended"]) == ("few_a|few_b", 4.0, 36.0, True)
    price, cents = {(p, c): x for p, c, x in prices_}, lambda x: int((x + 2.220446049250313e-16) * 100 + 0.5)
    for b in {b for b, _, _ in items_}:
        mine = [(p, q) for k, p, q in items_ if k == b]
        chains = sorted({c for p, c in price if p in {i for i, _ in mine}})
        want = []
        for size in (2, 3):
            for combo in combinations(chains, size):
                lines = [cents(min(x) * q) for p, q in mine if (x := [price[p, c] for c in combo if (p, c) in price])]
                want.append((sum(lines) + 99900 * (len(mine) - len(lines)), -len(lines), sum(lines), size, "|".join(combo)))
        if not want:
            assert b not in got
            continue
        best = min(want)
        assert (got[b]["combo"], cents(got[b]["score_total"]), cents(got[b]["actual_total"])) == (best[4], best[0], best[2])
        assert got[b]["coverage_ratio"] == round(-best[1] / len(mine), 4)
    assert {b: tuple(r) for b, r in got.items()} == {r["basket_id"]: tuple(r) for r in basket.best_multi(basket.best_options(items, table)).collect()}


def test_all_combinations_are_listed(spark):
    from tallyspark.operators import basket

    options = spark.createDataFrame([(1, f"c{i}") for i in range(7)], "basket_id long, chain_id string")
    chains = basket.selling_chains(options)
    assert (basket.combinations(chains, 2).count(), basket.combinations(chains, 3).count()) == (21, 35)


def test_ends_of_combinations_without_making_them(spark):
    """Names of which one is the start of another, and of signs on both sides of the bar."""
    import random
    from itertools import combinations

    from tallyspark.operators import basket

    rng = random.Random(8)
    names = ["N", "N_1", "N_10", "N_2", "N~", "N}", "M", "a", "~"]
    held = {b: set(rng.sample(names, b % 8)) for b in range(1, 30)}
    rows = spark.createDataFrame([(b, c) for b, cs in held.items() for c in cs] + [(1, c) for c in held[1]], "basket_id int, chain_id string")
    got = {(r["basket_id"], r["store_count"]): (r["combinations"], r["first_combo"], r["last_combo"]) for r in basket.combination_ends(rows).collect()}
    want = {}
    for b, cs in held.items():
        for size in (2, 3):
            combos = ["|".join(c) for c in combinations(sorted(cs), size)]
            if combos:
                want[b, size] = (len(combos), min(combos), max(combos))
    assert got == want


def test_blocks_hold_every_subset_once():
    from tallyspark.operators.basket import _blocks

    for chains, items in ((1, 3), (25, 400_000), (43, 3)):
        rows = [tuple(r) for part in _blocks(chains, items) for r in part]
        assert len(rows) == len(set(rows)) == chains * (chains - 1) // 2 + chains * (chains - 1) * (chains - 2) // 6


def test_matching_asks_with_every_product(spark):
    """Candidates, scores and best matches of all names of a small part table, against loops over all pairs."""
    from tallyspark.operators import matching
    from __spark_entry__ import SMOKE_DIR
    from tallyspark.plans import q_text

    assert {r["query_id"] for r in q_text._parsed(spark, SMOKE_DIR)[0].collect()} == {0, 50, 100, 150, 900000001}
    queries, products = q_text._parsed(spark, SMOKE_DIR, step=1)
    asked = {r["query_id"]: set(r["q_tokens"]) for r in queries.collect()}
    held = {r["product_id"]: r for r in products.collect()}
    assert set(asked) == set(held) | {900000001}
    want = {(q, p): n for q, mine in asked.items() for p, r in held.items() if (n := len(mine & set(r["tokens"])))}
    pairs = matching.candidates(queries.withColumnRenamed("q_tokens", "tokens"), products).collect()
    assert len(pairs) == len(want) and {(r["query_id"], r["product_id"]): r["shared"] for r in pairs} == want
    detail = {r["query_id"]: r for r in queries.collect()}

    def score(q, p):
        a, b = detail[q], held[p]
        exact = 0.45 if a["q_name"] == b["name"] else 0.12 if a["q_name"] in b["aliases"] else 0.0
        same = lambda x, y, w: w if x is not None and x == y else 0.0
        exact += 0.08 if any(len(t) >= 5 and (t in b["aliases"] or t in b["name"]) for t in a["q_name"].split(" ")) else 0.0
        s = exact + want[q, p] / max(len(asked[q]), 1) * 0.35 + (0.14 if b["brand"] in asked[q] else 0.0)
        return s + same(a["q_size"], b["size"], 0.12) + same(a["q_percent"], b["percent"], 0.10) + 0.7 * 0.05

    scores = {(r["query_id"], r["product_id"]): r["score"] for r in q_text._scored(spark, SMOKE_DIR, step=1)[1].collect()}
    assert set(scores) == set(want) and all(abs(scores[k] - score(*k)) < 6e-5 for k in want)
    best = {}
    for (q, p), x in scores.items():
        best.setdefault(q, []).append((-x, p))
    top = {}
    for r in matching.top_n(q_text._scored(spark, SMOKE_DIR, step=1)[1], 5).collect():
        top.setdefault(r["query_id"], []).append((-r["score"], r["product_id"]))
    assert {q: sorted(v) for q, v in top.items()} == {q: sorted(v)[:5] for q, v in best.items()}


def test_radius_join_over_the_globe(spark):
    """All pairs by the formula, near poles and across the date line."""
    import random

    rng = random.Random(5)
    points = [(75.0, 0.0), (75.0, 0.9), (0.0, 179.99), (0.0, -179.99), (89.9, 10.0), (89.9, -170.0), (-89.95, 0.0), (90.0, 5.0), (60.0, 180.0), (60.0, -180.0), (10.0, 20.0), (10.1, 20.1)]
    points += [(rng.choice([-1, 1]) * rng.uniform(60, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(178, 180)) for _ in range(60)]
    rows = [(i, *p) for i, p in enumerate(points)] + [(900, None, 1.0), (901, 1.0, None), (902, 95.0, 0.0)]
    a = spark.createDataFrame(rows, "origin_id int, lat double, lon double")
    b = a.withColumnRenamed("origin_id", "place_id")
    both = a.select("origin_id", F.col("lat").alias("y"), F.col("lon").alias("x")).crossJoin(b).select("origin_id", "place_id", places.haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("d"))
    for km in (26.0, 300.0, 12000.0):
        got = [(r[0], r[1], r[2]) for r in places.within(a, b, km).collect()]
        assert sorted(got) == sorted((r[0], r[1], r[2]) for r in both.filter(F.col("d") <= km).collect())


def test_upsert_of_repeated_keys(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    rows = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (3, "n", 1), (3, None, 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in changes.upsert(base, rows, ["k"], ["at"]).collect()) == [(1, "a", 1), (2, "x", 5), (3, "n", 1)]
    assert sorted(r["v"] for r in changes.upsert(base, rows, ["k"]).collect()) == ["a", "n", "y"]
    assert changes.upsert(base, rows.limit(0), ["k"]).count() == 2


def test_brand_guess_and_core_tokens(spark):
    names = ["ВЕРЕЯ Прясно мляко 3,6% 1л", "Мляко Верея", "fresh MILK-A 5% 250 g", "AB cola 2 l", "7UP 500 ml", None]
    skip = F.array(F.lit("прясно"), F.lit("мляко"))
    t = text.tokens(text.normalise_name(F.col("n")))
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r["b"] for r in d.select("i", text.brand_guess(F.col("n"), t, skip).alias("b")).orderBy("i").collect()]
    assert got == ["ВЕРЕЯ", "Верея", None, None, None, None]
    row = one(spark, c=text.core_tokens(F.array(*[F.lit(x) for x in ("nice", "milk", "5%", "250", "g", "1l", "2-3", "best", "milk")]), F.lit("Best")))
    assert row["c"] == ["milk", "nice"]


def test_weighted_search_by_hand(spark):
    from tallyspark.operators import matching

    d = spark.createDataFrame([(1, "Blue  Gear", "x"), (2, "gear", None), (3, None, "hot small ring"), (4, "none", "other"), (5, "blue gear", "bad")], "i int, a string, b string")
    guard = F.when(F.col("b") == "bad", -1000.0)
    got = {r["i"]: r["search_score"] for r in matching.weighted_search(d, {"a": 1.0, "b": 0.5}, "blue gear", ["blue", "gear"], ["small ring"], [guard]).collect()}
    assert got == {1: 30 + 18 + 10 + 3 + 2, 2: 5 + 1, 3: 1.6 * 2 + 4 + 0.3}
    assert matching.weighted_search(d, {"a": 1.0}, "", []).count() == 5


def test_providers(spark):
    from tallyspark.operators import providers

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, t string")
    table = spark.createDataFrame([("a", "A"), ("a", "AA")], "text string, answer string")
    assert {r["i"]: r["translated"] for r in providers.translated(rows, "t", lambda asked: table).collect()} == {1: "AA", 2: "b", 3: None}
    assert providers.translated(rows, "t", None).filter("translated <=> t").count() == 3
    cache = spark.createDataFrame([("a", 1.0, 2.0)], "t string, lat double, lon double")
    assert sorted(r["path"] for r in providers.geocoded(rows, "t", cache, None).collect()) == ["cache", "none", "none"]


def test_meal_plans_by_loop(spark):
    """The plan over all recipes, with nothing dropped by rank."""
    import random

    rng = random.Random(3)
    rows = [(p, r, m, rng.random() < 0.5, rng.choice(["it", "fr", None]), round(rng.random(), 2)) for p in range(4) for r in range(30) for m in ("lunch", "dinner")]
    rows += [(9, r, "lunch", False, None, 0.5) for r in range(2)]
    d = spark.createDataFrame(rows, "profile_id long, recipe_id long, meal_type string, fits boolean, cuisine string, score double")
    got = {(r["profile_id"], r["day"], r["meal_type"]): (r["recipe_id"], r["selection_score"]) for r in nutrition.meal_plans(d, 3, ["lunch", "dinner"]).collect()}
    want = {}
    for p in {r[0] for r in rows}:
        uses, cuisines, before, chosen = {}, {}, None, {}
        for day in range(3):
            today = set()
            for meal in ("lunch", "dinner"):
                pool = [r for r in rows if r[0] == p and r[2] == meal]
                pool = [r for r in pool if r[3]] or pool
                if not pool:
                    continue

                def cost(r):
                    c = 0.45 * (r[1] in today) + min(0.25, 0.08 * uses.get(r[1], 0)) + 0.25 * (r[1] == before) + 0.12 * (chosen.get((meal, day - 1)) == r[1])
                    return round(min(0.9, c + (min(0.12, 0.03 * cuisines.get(r[4], 0)) if r[4] else 0)), 3)

                for some in ([r for r in pool if r[1] not in uses], [r for r in pool if r[1] not in today], pool):
                    if some:
                        break
                best = max(some, key=lambda r: (round(max(0.0, r[5] - cost(r)), 3), -r[1]))
                want[p, day, meal] = (best[1], round(max(0.0, best[5] - cost(best)), 3))
                before = best[1]
                today.add(best[1])
                uses[best[1]] = uses.get(best[1], 0) + 1
                chosen[meal, day] = best[1]
                if best[4]:
                    cuisines[best[4]] = cuisines.get(best[4], 0) + 1
    assert got == want and nutrition.meal_plans(d.limit(0), 2, ["lunch"]).count() == 0


def test_unit_conversion_has_units_without_products(spark):
    from tallyspark.plans import catalogue  # noqa: F401
    from tallyspark.plans.registry import QUERIES

    rows = QUERIES["unit_conversion"](spark, "/root/testdata/sf0.001").collect()
    assert {r["unit"] for r in rows} == {"kg", "g", "mg", "l", "ml", "cup"} and len(rows) == 12
    assert {r["unit"] for r in rows if r["products"] == 0} == {"mg", "l"}
