"""Runs that break off and resume, providers that fail, queues and reviews in commits."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import workflow as W
from __spark_entry__ import SMOKE_DIR
from tallyspark.plans import q_workflow as Q
from tallyspark.sources.buckets import BucketTable


def stored(spark, root, days):
    """What a run has left: current rows, vectors, daily rows and alerts."""
    read = lambda name, day, *cols: sorted(map(tuple, spark.read.parquet(f"{root}/{name}/day={day}").select(*cols).collect()))
    run = W.DailyRun(spark, root, ())
    current = sorted((r["source_product_id"], r["snapshot_date"], r["price"]) for r in Q.current_table(run).read().collect())
    vectors = sorted((r["id"], tuple(r["vector"])) for r in BucketTable(spark, f"{root}/vectors", ["id"], W.VECTORS, 8).read().collect())
    return current, vectors, [read("daily", d, "canonical_product_id", "mean_price", "offers") for d in days], [read("alerts", d, "canonical_product_id", "before") for d in days]


@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_fails_at_each_stage_in_turn_resumes(spark, tmp_path, after):
    """after: the stage's work was done, but not recorded."""
    rows = Q.quarters(spark, SMOKE_DIR)
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").limit(2).collect()]
    rows = rows.filter(F.col("day").isin(days))
    Q.lay_out(spark, rows, str(tmp_path / "clean"))
    clean = W.DailyRun(spark, str(tmp_path / "clean"), Q.STAGES)
    want = {d: clean.run(d) for d in days}
    Q.lay_out(spark, rows, str(tmp_path / "broken"))
    failed = set()

    def failing(name, stage):
        def run(job, day):
            if (name, day) in failed:
                return stage(job, day)
            failed.add((name, day))
            if after:
                stage(job, day)
            raise RuntimeError(name)

        return run

    broken = W.DailyRun(spark, str(tmp_path / "broken"), [(n, failing(n, s)) for n, s in Q.STAGES])
    for d in days:
        for name, _ in Q.STAGES:
            with pytest.raises(RuntimeError, match=name):
                broken.run(d)
        got = broken.run(d)
        assert got == broken.run(d)
        for name in ("discover", "aggregate", "alert"):
            assert got[name] == want[d][name]
    assert stored(spark, str(tmp_path / "broken"), days) == stored(spark, str(tmp_path / "clean"), days)
    with pytest.raises(ValueError):
        clean.run("today")


def test_vectors_are_asked_for_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def provider(texts):
        import uuid

        tried = asked / f"tried-{'-'.join(texts)}"
        if not tried.exists():  # the first attempt fails
            tried.write_text("")
            raise OSError("busy")
        (asked / f"call-{uuid.uuid4().hex}").write_text("\n".join(texts))
        return [[float(len(t))] for t in texts]

    def calls():
        out = [t for f in asked.glob("call-*") for t in f.read_text().split("\n")]
        for f in asked.glob("call-*"):
            f.unlink()
        return sorted(out)

    items = lambda rows: spark.createDataFrame(rows, "id string, text string")
    t = BucketTable(spark, str(tmp_path / "t"), ["id"], W.VECTORS, 4)
    assert W.backfill_vectors(t, items([("a", "x"), ("b", "yy"), (None, "no")]), "c1", provider, batch=1) == {"created": 2, "updated": 0, "unchanged": 0}
    assert calls() == ["x", "yy"]
    assert W.backfill_vectors(t, items([("a", "x"), ("b", "yyy"), ("c", None)]), "c2", provider, batch=1) == {"created": 1, "updated": 1, "unchanged": 0}
    assert calls() == ["", "yyy"]
    assert W.backfill_vectors(t, items([("a", "x"), ("b", "yyy"), ("c", "")]), "c3", provider, batch=1) == {"created": 0, "updated": 0, "unchanged": 0} and calls() == []
    W.backfill_vectors(t, items([("a", "x")]), "c4", provider, version="v2", batch=1)
    assert calls() == ["x"] and {r["id"]: r["vector"] for r in t.read().collect()} == {"a": [1.0], "b": [3.0], "c": [0.0]}
    with pytest.raises(Exception, match="busy"):
        W.backfill_vectors(t, items([("d", "never")]), "c5", provider, attempts=1)
    assert t.read().count() == 3


def test_import_counts_once(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), ["k"], "k string, v int", 4)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 9)], "k string, v int")
    bad = F.when(F.col("v") == 9, "no")
    assert W.import_rows(t, rows, "d1", bad) == {"imported": 3, "rejected": 1, "unique": 2, "duplicates": 1, "created": 2, "updated": 0, "unchanged": 0}
    assert set(W.import_rows(t, rows, "d1", bad).values()) == {0}
    assert W.import_rows(t, rows.limit(0), "d2")["imported"] == 0


def test_reviews_follow_the_arrows(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), ["item_id"], W.REVIEWS, 4)
    t.merge(spark.createDataFrame([("a", "open", None, None), ("b", "open", None, None), ("c", "approved", None, None)], W.REVIEWS), "load")
    decisions = spark.createDataFrame([("a", "approved", "x", "2"), ("a", "rejected", "y", "1"), ("c", "open", "x", "1"), ("none", "open", "x", "1")], "item_id string, to_status string, reviewer string, decided_at string")
    assert W.review(t, decisions, [("open", "approved"), ("open", "rejected")], "r1") == {"created": 0, "updated": 1, "unchanged": 0}
    assert {r["item_id"]: r["status"] for r in t.read().collect()} == {"a": "rejected", "b": "open", "c": "approved"}
    assert [tuple(r) for r in W.transitions_of(t).filter("commit = 'r1'").select("item_id", "from_status", "status", "reviewer").collect()] == [("a", "open", "rejected", "y")]
