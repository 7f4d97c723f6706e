"""Rules for markers, the token trie, and food descriptions on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import markers as K
from tallyspark.operators import vocabulary as V


def marked(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = K.with_markers(rows, "name", compose=True).withColumn("size", K.size_marker(K.variant_text(F.col("name")))).collect()
    return {r["name"]: r for r in got}


def test_markers_of_known_products(spark):
    milk, juice = "МЛЯКО APTAMIL PRONUTRA+  4 800 ГР НАД 24 МЕСЕЦА", "GANCHEV СОК ЯБЪЛКА И ГРОЗДЕ 4+ 750МЛ"
    got = marked(spark, [milk, juice, "TEST 100 гр", "TEST 100g", "TEST 0,5 кг", "TEST 1.5 л", "TEST 2x500 г", "TEST ½ кг", None, ""])
    m = got[milk]["markers"]
    assert (m["stage"], m["volume"], m["age_band"], m["age_statement"]) == ("stage_4", "800g", "24+m", None)
    assert (got[milk]["size"]["display"], got[milk]["size"]["quantity"], got[milk]["size"]["unit"]) == ("800 g", 800.0, "g")
    m = got[juice]["markers"]
    assert (m["volume"], m["age_band"], m["flavor"], got[juice]["size"]["display"]) == ("750ml", "4+m", "ябълка", "750 ml")
    shown = {n: got[n]["size"]["display"] for n in got if n and n.startswith("TEST 1") or n in ("TEST 0,5 кг", "TEST 2x500 г")}
    assert shown == {"TEST 100 гр": "100 g", "TEST 100g": "100 g", "TEST 0,5 кг": "500 g", "TEST 1.5 л": "1500 ml", "TEST 2x500 г": "2 pcs x 500 g / total 1000 g"}
    assert (got["TEST 2x500 г"]["size"]["pack_count"], got["TEST 2x500 г"]["size"]["total_quantity"]) == (2, 1000.0)
    assert all(v is None for v in got[None]["markers"]) and all(v is None for v in got[""]["markers"]) and got[""]["size"] is None


@pytest.mark.parametrize(
    "name,marker,value",
    [
        ("formula 3 etap no 2", "stage", "stage_2"),
        ("formula 12", "stage", None),
        ("milk 3", "stage", None),
        ("soap 6х100 g", "count", "6"),
        ("set of 04 cups", "count", "4"),
        ("snack 2-3 years kids", "age_band", "2-3y"),
        ("snack 6 m+", "age_band", "6+m"),
        ("snack 6+ m", "age_band", "6+m"),
        ("book 8 years", "age_statement", "8y"),
        ("book 8 years + 2", "age_statement", None),
        ("cheese 12 years", "reserve", None),
        ("gin 12 years", "reserve", "12"),
        ("cheese aged 09", "reserve", "9"),
        ("ginger 12 years", "reserve", None),
        ("beer 0,50", "volume", "500ml"),
        ("beer 11,50", "volume", None),
        ("bread 0,50", "volume", None),
        ("wine 12019", "year", None),
        ("bag 100-200л", "range", "100-200l"),
        ("bag 1-2", "range", None),
    ],
)
def test_rules_and_guards(spark, name, marker, value):
    assert marked(spark, [name])[name]["markers"][marker] == value


def test_core_tokens_leave_markers_out(spark):
    rows = spark.createDataFrame([("Acme whisky reserve 12 pack of 3 bottle 70 cl 700ml", "ACME")], "name string, brand string")
    rows = K.with_markers(rows, "name").withColumn("t", F.split(K.canonical_text(F.col("name")), " "))
    assert rows.select(K.core_tokens(F.col("t"), F.col("brand"), F.col("markers"))).first()[0] == ["bottle", "of", "whisky"]


def brute_all(tokens, aliases):
    return sorted((i, n) for n, a in enumerate(aliases) for i in range(len(tokens) - len(a) + 1) if a and tuple(tokens[i : i + len(a)]) == a)


def test_trie_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        aliases = list({tuple(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(rng.randint(1, 12))})
        tokens = rng.choices("abcd", k=rng.randint(0, 30))
        trie = V.TokenTrie(aliases)
        want = brute_all(tokens, aliases)
        assert sorted(trie.all(tokens)) == want
        walk, at = [], 0
        while at < len(tokens):
            here = [(len(aliases[n]), n) for i, n in want if i == at]
            if here:
                walk.append((at, max(here)[1]))
            at += max(here)[0] if here else 1
        assert list(trie.longest(tokens)) == walk
        assert list(trie.longest(tokens, True)) == [w for w in walk if w[0] == 0]


def test_both_ways_give_the_same(spark):
    rng = random.Random(4)
    texts = spark.createDataFrame([(i, rng.choices("abcd", k=rng.randint(0, 12)) if i else None) for i in range(50)], "id int, t array<string>")
    aliases = spark.createDataFrame([(" ".join(rng.choices("abc", k=rng.randint(1, 3))), rng.choice("xy")) for _ in range(15)] + [("", "x"), (" ", "y")], "alias string, target string")
    for f, how in ((V.matches, {}), (V.longest, {}), (V.longest, {"prefix": True})):
        a, b = (sorted(map(tuple, f(texts, aliases, "id", "t", join=j, **how).collect())) for j in (False, True))
        assert a == b and a
    assert V.matches(texts, aliases.limit(0), "id", "t").count() == 0 and V.longest(texts, aliases.limit(0), "id", "t", join=True).count() == 0
