import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup as X
from tallyspark.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, rate int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 1) for i, t, s in rows], SCHEMA)


ROWS = [(5, "a  b", "s"), (3, "a\tb", "s"), (9, "a b", "s"), (1, "A b", "s"), (7, None, "s"), (8, "", "t"), (6, " ", "t"), (2, "x" * 200_000, "u"), (4, "x" * 200_000, None), (None, "a b", None), (3, "a b", "s"), (3, "a b", "s"), (11, "a\u00a0b", "s")]


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    return {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("short", [False, True])
def test_groups_match_brute_force(spark, short):
    # a digest cut to one byte, or to nothing, joins texts wrongly; the bytes must part them again
    digest = (lambda sha: F.substring(sha, 1, 0)) if short else X.whole
    got = X.exact_groups(docs(spark, ROWS), digest=digest).collect()
    want = brute(ROWS)
    by_sha = {hashlib.sha256(k.encode()).digest(): v for k, v in want.items()}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[bytes(r["sha"])]
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(want) and len({bytes(r["sha"]) for r in kept}) == len(want)


def test_drop_copies_keeps_columns(spark):
    out = X.drop_exact_copies(docs(spark, ROWS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id", "rate"]
    rows = out.collect()
    assert sorted(norm(r["text"]) for r in rows) == sorted(brute(ROWS))
    assert {r["doc_id"] for r in rows if norm(r["text"]) == "a b"} == {3}


def test_empty_table(spark):
    empty = docs(spark, ROWS).limit(0)
    assert X.exact_groups(empty).count() == 0 and X.drop_exact_copies(empty).count() == 0
    assert M.mix_plan(empty).count() == 0 and M.mix(empty).count() == 0


def test_hot_group_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(X, "COPIES_PER_SALT", 5)
    rows = [(i, "same text", "s") for i in range(40)] + [(100 + i, f"own {i}", "s") for i in range(5)]
    got = X.exact_groups(docs(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 6 and {r["keep_id"] for r in got if r["id"] < 100} == {0}


def test_index_over_batches(spark, monkeypatch):
    monkeypatch.setattr(X, "MEMTABLE", 2)
    index = X.DigestIndex(spark)
    index.flush(docs(spark, ROWS[:6]))
    index.compact()
    index.flush(docs(spark, ROWS[6:]))
    level = index.compact()
    assert level.agg(F.sum("rows")).first()[0] == len(ROWS)
    sha = hashlib.sha256(b"a b").digest()
    assert index.lookup(sha).first()["keep"]["id"] == 3


def test_filter_has_no_false_no(spark):
    d = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"), "id")
    seen = X.Filter(d.filter("id < 500"))
    got = {r["id"]: r["maybe"] for r in seen.asked(d).collect()}
    assert len(got) == 3000 and all(got[i] for i in range(500)) and sum(got[i] for i in range(500, 3000)) < 400


def test_runs_merge_by_tiers(spark, monkeypatch):
    monkeypatch.setattr(X, "MEMTABLE", 3)
    rows = [(i, f"text {i % 50}", "s") for i in range(200)]
    got = X.exact_groups(docs(spark, rows).coalesce(1)).collect()
    assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, i % 50, 4, i < 50) for i in range(200)}


def test_repeated_identifier_with_unlike_texts(spark):
    """One identifier for two texts that a short digest joins: each text keeps its own row."""
    rows = [(2, "x", "s"), (2, "y", "s"), (5, "y", "s"), (6, "x", "s")]
    got = X.exact_groups(docs(spark, rows), digest=lambda sha: F.substring(sha, 1, 0)).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(2, 2, 2, True), (2, 2, 2, True), (5, 2, 2, False), (6, 2, 2, False)]


def fill(sizes, weights, share, most):
    """Repeat the sharing until nobody is above the cap."""
    total, left = share * sum(sizes.values()), dict(weights)
    target = {}
    while left:
        level = total / sum(left.values())
        over = [s for s in left if level * left[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in left.items()}
        for s in over:
            target[s] = most * sizes[s]
            total -= target[s]
            del left[s]
    return target


def test_targets_match_repeated_sharing(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {f"s{i}": rng.randint(0, 10 ** rng.randint(0, 4)) for i in range(rng.randint(1, 9))} | {None: 7}
        order = sorted((s for s in sizes if s is not None)) + [None]
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in M.source_targets(rows).collect()}
        want = fill(sizes, weights, 1.5, 2.0)
        assert got.keys() == want.keys()
        for s in got:
            assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_mix_takes_near_target_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 20))), f"s{i % 5}" if i % 7 else None) for i in range(3000)]
    d = docs(spark, rows)
    plan = M.mix_plan(d).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(lambda: [0, 0.0])
    for r in plan:
        assert r["size"] == size[r["id"]] and r["copies"] <= 2
        by[r["source"]][0] += r["size"] * r["copies"]
        by[r["source"]][1] = r["target"]
    for taken, target in by.values():
        assert abs(taken - target) < 0.12 * target
    again = {r["id"]: r["copies"] for r in M.mix_plan(d.repartition(3)).collect()}
    assert again == {r["id"]: r["copies"] for r in plan}
    out = M.mix(d)
    assert out.columns == d.columns and out.count() == sum(r["copies"] for r in plan)


@pytest.mark.parametrize("ids", [[None], [7, None]])
def test_mix_without_identifiers_comes_near_its_target(spark, ids):
    """Null and repeated identifiers, equal texts: each row draws for itself."""
    rows = [(ids[i % len(ids)], "w w w", "s" if i % 2 else "t") for i in range(2000)] + [(9, "long " * 60_000, "u")]
    plan = M.mix_plan(docs(spark, rows)).collect()
    for source in "st":
        own = [r for r in plan if r["source"] == source]
        assert len(own) == 1000 and abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 0.06 * max(own[0]["target"], 3000)
    assert M.mix(docs(spark, rows)).count() == sum(r["copies"] for r in plan)
    assert next(r["size"] for r in plan if r["source"] == "u") == 60_000
