"""Lists, intents, policies, plans and copies on small tables: nulls, ties, empty tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import differ_much
from tallyspark.operators import catalogue_search as G
from tallyspark.operators import intent as I
from tallyspark.sources import replication as S


def test_intents(spark):
    q = spark.createDataFrame([(1, 10, "Red Milk"), (2, 10, "milk bread"), (3, None, "milk"), (4, 10, None), (5, 10, "what"), (6, 11, "milk low whole")], "query_id int, owner_id int, text string")
    terms = spark.createDataFrame([("dairy", "milk", 1.0), ("bakery", "bread", 0.8)], "family string, term string, weight double")
    values = spark.createDataFrame([("dairy", "fat", "whole", "3.5"), ("dairy", "fat", "low", "1.5"), ("dairy", "cap", "red", "RED")], "family string, attribute string, word string, value string")
    required = spark.createDataFrame([("dairy", "fat"), ("dairy", "size")], "family string, attribute string")
    prefs = spark.createDataFrame([(10, "dairy", "fat", "b", 0.9), (10, "dairy", "fat", "a", 0.9), (10, "dairy", "size", "1l", 0.5), (11, "dairy", "size", "2l", 0.8), (11, "dairy", "fat", "x", 1.0)], "owner_id int, family string, attribute string, value string, confidence double")
    got = {r["query_id"]: tuple(r)[1:] for r in I.resolve_intent(q, terms, values, required, prefs).collect()}
    assert got == {
        1: ("needs_clarification", "dairy", "cap=RED", "fat=a", "size"),
        2: ("family_ambiguous", None, "", "", ""),
        3: ("needs_clarification", "dairy", "", "", "fat,size"),
        4: ("unresolved", None, "", "", ""),
        5: ("unresolved", None, "", "", ""),
        6: ("ready_for_product_selection", "dairy", "fat=1.5", "size=2l", ""),
    }
    assert I.resolve_intent(q.limit(0), terms, values, required, prefs).count() == 0


def test_policies(spark):
    c = spark.createDataFrame([(1, 7, 0.9, 3.0), (1, 5, 0.85, 2.0), (1, 9, 0.2, 0.1), (2, 4, 0.5, 1.0), (3, 8, 0.6, 1.0), (3, 6, 0.6, 1.0)], "item_id int, product_id int, score double, price double")
    got = {p: {r["item_id"]: (r["status"], r["product_id"]) for r in I.ambiguity_policy(c, p).collect()} for p in ("strict", "best", "cheapest")}
    assert got["strict"] == {1: ("clarify", None), 2: ("ready", 4), 3: ("clarify", None)}
    assert got["best"] == {1: ("ready", 7), 2: ("ready", 4), 3: ("ready", 6)} and got["cheapest"] == {1: ("ready", 5), 2: ("ready", 4), 3: ("ready", 6)}
    with pytest.raises(ValueError):
        I.ambiguity_policy(c, "none")


def test_plans_and_chains(spark):
    need = spark.createDataFrame([(1, "a", 250.0), (1, "b", 10.0), (1, "c", 0.0), (2, "z", 5.0)], "plan_id int, ingredient_key string, net_grams double")
    packs = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 300.0), ("b", 3, 50.0)], "ingredient_key string, product_id int, package_grams double")
    prices = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.5), (3, "x", 9.0), (1, "y", 0.1)], "product_id int, chain_id string, price double")
    got = {r["plan_id"]: tuple(r)[1:] for r in I.plan_shopping(need, packs, prices).collect()}
    assert got == {1: ("x", 2, 2, 0, 11.5), 2: (None, 1, 0, 1, None)}


def test_ingredients_by_terms(spark):
    i = spark.createDataFrame([("m", "milk", ["whole milk"], "dairy", "organic"), ("n", None, None, None, None), ("o", "oat milk", None, "dairy", None)], "ingredient_id string, name string, aliases array<string>, category string, attribute string")
    p = spark.createDataFrame([(1, "milk", "dairy", ["organic"]), (2, "whole milk", "x", None), (3, "oat milk drink", "dairy", []), (4, "milkshake", "dairy", []), (5, None, None, None)], "product_id int, name string, category string, attributes array<string>")
    got = {(r["ingredient_id"], r["product_id"]): r["confidence"] for r in I.ingredient_products(i, p).collect()}
    assert got == {("m", 1): 0.99, ("m", 2): 0.88, ("m", 3): 0.90, ("o", 3): 0.90}


def test_names_that_differ(spark):
    cases = [("Red Milk 1", "red, milk 1!", False), ("a b c", "a b d", True), ("milk", "milk extra", True), ("long name here", "long name here x", False), ("", "x", False), (None, "x", False), ("ab cd ef gh", "ab cd ef ghijklmnopqr", True)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    assert [r[0] for r in rows.select(differ_much(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_concepts_by_the_rules(spark):
    concepts = spark.createDataFrame([("milk", "milk"), ("milk", "dairy drink"), ("formula", "baby milk"), ("cola", "co"), ("none", " ")], "concept string, term string")
    q = spark.createDataFrame([(1, "MILK"), (2, "fresh milk"), (3, "milk for baby"), (4, "cola"), (5, "drink dairy  now"), (6, None)], "query_id int, text string")
    got = {r["query_id"]: (sorted(r["concepts"]), sorted(r["expanded"])) for r in G.with_concepts(q, concepts).collect()}
    assert got[1] == (["milk"], ["dairy drink", "milk"]) and got[2] == ([], []) and got[3] == (["formula"], ["baby milk"])
    assert got[4] == (["cola"], ["co"]) and got[5][0] == ["milk"] and got[6] == ([], [])


def test_fingerprint_is_that_of_sorted_json(spark):
    o = spark.createDataFrame([("p1", 7, 1.23456, -1.0, None, True, ' a "q" \\ é\n', None), (None, None, float("nan"), 3.0, 2.5, None, None, 4.0)], "source_product_id string, canonical_product_id int, current_price double, retail_price double, promo_price double, is_sale boolean, chain_name string, unit_price double")
    got = [r[0] for r in o.select(S.offer_fingerprint(o)).collect()]
    empty = dict.fromkeys(S.TEXT, "") | dict.fromkeys((*S.MONEY, *S.NUMBER)) | dict.fromkeys(S.FLAGS, False) | {"is_available": True}
    want = [empty | {"source_product_id": "p1", "canonical_product_id": "7", "current_price": 1.2346, "is_sale": True, "chain_name": 'a "q" \\ é'}, empty | {"retail_price": 3, "promo_price": 2.5, "unit_price": 4}]
    assert got == [hashlib.sha256(json.dumps(w, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for w in want]


def test_baseline_resumes_from_its_cursor(spark, tmp_path):
    o = spark.createDataFrame([(f"p{i}", float(i), "2024-01-01") for i in range(7)], "source_product_id string, current_price double, snapshot_date string")
    cursors, after = [], None
    while (after := S.export_baseline(o, str(tmp_path), False, after, 3)) is not None:
        cursors.append(after)
    assert cursors == ["p2", "p5", "p6"]
    (tmp_path / "page=first" / "broken.json").write_text("{no json\n")
    got = S.load_baseline(spark, str(tmp_path), "source_product_id string, snapshot_date string, current_price double, baseline_mode string").collect()
    assert sorted((r["source_product_id"], r["current_price"], r["baseline_mode"]) for r in got) == [(f"p{i}", float(i), "compact") for i in range(7)]


def test_projections_are_merged(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("c1", "2024-01-01", v, v, v, 1, 1)], S.PROJECTIONS["sql_category_aggregates"][1])
    S.replicate(spark, str(tmp_path), {"sql_category_aggregates": rows(1.0)}, "a")
    assert S.replicate(spark, str(tmp_path), {"sql_category_aggregates": rows(2.0)}, "b") == {"sql_category_aggregates": {"created": 0, "updated": 1, "unchanged": 0}}
    S.replicate(spark, str(tmp_path), {"sql_category_aggregates": rows(3.0)}, "b")
    assert [r["avg_price"] for r in S.projection(spark, str(tmp_path), "sql_category_aggregates").collect()] == [2.0]
