"""The pipeline's stages against brute force on the smallest table."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyspark.llm import mixing
from tests.llm.test_joins import brute_components, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    before, after = kept["language"]
    assert after.count() >= 0.98 * before.count()
    before, after = kept["exact"]
    first = {}
    for r in before.collect():
        key = re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(first.values())
    before, after = kept["near"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({root for _, root in want.values()})
    before, after = kept["mix"]
    plan = {r["id"]: r["copies"] for r in mixing.mix_plan(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in plan.items() if n})
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    used = check_packing(rows, 1024)
    assert used <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 2
    pieces = defaultdict(int)
    for r in rows:
        pieces[r["doc_id"]] += r["piece"] == 0
    assert pieces == dict(Counter(r["doc_id"] for r in docs.collect()))


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.filter(F.col("length") > 1024).count() == 0 and out.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_documents(spark):
    """Nulls in any column, repeated identifiers and rows, a very long text, and columns that bear the names of the operators' own."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in base.limit(60).collect()]
    text = next(t for _, t, *_ in rows if t and len(t.split()) > 80)
    odd = [(None, text, None, None, None), (None, None, "en", "s", 0), (7, "", None, "s", None), (7, "   ", "en", None, 1), (8, (text + " ") * 2000, "en", "s", 9), (9, text, "en", "s", 9), (9, text, "en", "s", 9), (10, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows + odd, base.schema)
    docs = docs.withColumns({"score": F.lit(1), "Verdict": F.lit("x"), "keep_id": F.lit(2), "a.b": F.lit(3), "sequence_id": F.lit(4), "size": F.lit(5)})
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns
        kept = docs.collect()
        assert all((r["score"], r["Verdict"], r["keep_id"], r["a.b"], r["size"]) == (1, "x", 2, 3, 5) for r in kept)
        own = [r["doc_id"] for r in kept if r["text"] == text]
        if name == "language":
            assert not any(r["text"] is None or not any(c.isalpha() for c in r["text"]) for r in kept) and len(own) == 4
        elif name in ("exact", "near"):
            assert len(own) == 1 and own[0] is not None
    out = P.packed(spark, docs, SF).collect()
    check_packing(out, 1024)
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}


def test_writes_count_their_rows(spark):
    """What was just written is not counted by a query of its own: each leaves its plan and jobs with the driver."""
    from tallyspark.llm.common import rows_in, save, small

    saved = save(spark.range(10), "counted", narrow=True, rows="true", even=F.col("id") % 2 == 0)
    none = save(spark.range(10).filter("id < 0"), "counted", rows="true")
    spark.sparkContext.setJobGroup("small", "")
    small(saved, 8)
    small(none, 8)
    assert (rows_in(saved), rows_in(saved, "even"), rows_in(none)) == (10, 5, 0)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("small")
    spark.sparkContext.setJobGroup("", "")
