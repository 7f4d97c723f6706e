"""Bucket tables, streams into them, and delimited files: files that stay, commits that come again, late rows, ranges that start anywhere."""

import datetime as dt
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import delimited as D
from tallyspark.sources.buckets import BucketTable
from tallyspark.streaming import capture as C
from tallyspark.streaming import events as E

SCHEMA = "k string, v int, w string"


def table(spark, path, buckets=8):
    return BucketTable(spark, str(path), ["k"], SCHEMA, buckets)


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def content(t):
    return {r["k"]: (r["v"], r["w"]) for r in t.read().collect()}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert content(t) == {}
    got = t.merge(rows(spark, [(f"k{i}", i, "a") for i in range(100)] + [("k1", 0, "a"), (None, 1, "x")]), "one")
    assert got == {"created": 100, "updated": 0, "unchanged": 0}
    before = files(tmp_path / "rows")
    assert len(before) == 8
    assert t.merge(rows(spark, [("k5", 55, "b"), ("k6", 6, "a")]), "two") == {"created": 0, "updated": 1, "unchanged": 1}
    after = files(tmp_path / "rows")
    assert len(set(before) - set(after)) == 1 and all(after[f] == before[f] for f in set(before) & set(after))
    assert content(t) == {f"k{i}": (i, "a") for i in range(100)} | {"k5": (55, "b")}


def test_commit_once_and_history(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, [("a", 1, None)]), "c1")
    assert t.merge(rows(spark, [("a", 9, "z"), ("b", 1, "z")]), "c1") == {"created": 0, "updated": 0, "unchanged": 0}
    t.merge(rows(spark, [("a", 2, None), ("b", 1, "x")]), "c2")
    t.merge(rows(spark, []), "c3")
    t.merge(rows(spark, [("a", 3, None), ("c", 3, None)]), "c4", replace=False)
    assert content(t) == {"a": (2, None), "b": (1, "x"), "c": (3, None)}
    got = sorted((r["commit"], r["k"], r["state"], r["v"]) for r in t.history().collect())
    assert got == [("c1", "a", "created", 1), ("c2", "a", "updated", 2), ("c2", "b", "created", 1), ("c4", "a", "unchanged", 3), ("c4", "c", "created", 3)]
    t.merge(rows(spark, [("b", None, None)]), "c5", delete=True)
    assert content(t) == {"a": (2, None), "c": (3, None)}
    with pytest.raises(ValueError):
        t.merge(rows(spark, []), "no/good")


def test_a_commit_that_broke_off_goes_on(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, [("a", 1, None), ("b", 1, None)]), "c1")
    patch = rows(spark, [("a", 2, None), ("d", 4, None)])
    t._write_changes(patch, f"{tmp_path}/changes/commit=c2", True)  # and then the driver was lost
    t.merge(patch, "c2")
    assert content(t) == {"a": (2, None), "b": (1, None), "d": (4, None)}
    os.remove(tmp_path / "commits" / "c2")  # lost after the buckets were written
    t.merge(patch, "c2")
    assert content(t) == {"a": (2, None), "b": (1, None), "d": (4, None)}
    assert sorted((r["k"], r["state"]) for r in t.history().filter("commit = 'c2'").collect()) == [("a", "updated"), ("d", "created")]


# --- streams ------------------------------------------------------------------------------------------------------------


def source(spark, folder, parts, schema):
    """A stream over files that come in order, one a batch."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{n}")
        os.utime(f"{folder}/{n}", (1_600_000_000 + n, 1_600_000_000 + n))
        for f in os.listdir(f"{folder}/{n}"):
            os.utime(f"{folder}/{n}/{f}", (1_600_000_000 + n, 1_600_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


SIGNALS = "source string, query string, status string, timestamp string, chain_id string"


def test_signals_of_repeated_and_late_batches(spark, tmp_path):
    rng = random.Random(1)
    made = [(rng.choice(["search", "watchlist", "odd"]), f" Q {rng.randint(0, 9)}", rng.choice(["resolved", "?"]), f"2024-01-{rng.randint(1, 28):02d}", rng.choice(["c", " ", None])) for _ in range(200)]
    parts = [made[:80], made[40:150], made[150:] + made[:5]]  # overlapping, and days out of order
    stream = source(spark, tmp_path / "in", parts, SIGNALS)
    t = BucketTable(spark, str(tmp_path / "t"), ["signal_id"], C.SIGNAL, 4)
    C.capture(C.gap_signals(stream, stream.withColumn("source", F.lit("shopping_list"))), t, str(tmp_path / "s1"))
    want = C.gap_signals(spark.createDataFrame(made, SIGNALS), spark.createDataFrame(made, SIGNALS).withColumn("source", F.lit("shopping_list"))).dropDuplicates(["signal_id"])
    key = lambda df: sorted(map(str, df.select("signal_id", "source", "normalized_query", "status", "chain_id").collect()))
    assert key(t.read()) == key(want)
    assert {r["source"] for r in t.read().collect()} == {"search", "watchlist", "shopping_list"}
    before = files(tmp_path / "t" / "rows")
    C.keep(t, "s1", False)(want, 0)  # the batch comes again
    C.capture(C.gap_signals(source(spark, tmp_path / "in2", [made], SIGNALS)), t, str(tmp_path / "s2"))  # another run over the same input
    assert files(tmp_path / "t" / "rows") == before


TIMES = "event_id long, user_id long, event_type string, ts timestamp"


def timed(seed, n=300):
    rng = random.Random(seed)
    at = [(i, rng.randint(0, 3), "view", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 30))) for i in range(n)]
    at.sort(key=lambda r: r[3])
    for i in range(0, n - 8, 8):  # out of order by some events
        part = at[i : i + 8]
        rng.shuffle(part)
        at[i : i + 8] = part
    return at


def test_nudges_over_several_batches_out_of_order(spark, tmp_path):
    made = timed(4)
    stream = source(spark, tmp_path / "in", [made[i : i + 53] for i in range(0, len(made), 53)], TIMES)
    got = {(r["user_id"], r["event_id"]) for r in E.run_to_table(E.nudges(stream, 3, "4 days")).collect()}
    passed = max(r[3] for r in made) - dt.timedelta(days=4)
    want, last = set(), {}
    for i, u, _, t in sorted((r for r in made if r[3] <= passed), key=lambda r: (r[3], r[0])):
        if u not in last or t - last[u] >= dt.timedelta(days=3):
            last[u] = t
            want.add((u, i))
    assert got == want


def test_windows_over_several_batches(spark, tmp_path):
    made = timed(5)
    stream = source(spark, tmp_path / "in", [made[:100], made[100:220], made[220:]], TIMES)
    t = BucketTable(spark, str(tmp_path / "t"), ["window_start", "event_type"], "window_start string, event_type string, n long", 4)
    C.capture(E.demand_windows(stream, "2 days", "1 day", "3 days"), t, str(tmp_path / "s"), "update", True)
    want = {}
    for _, _, kind, at in made:
        for back in range(2):
            k = (str((at - dt.timedelta(days=back)).date()), kind)
            want[k] = want.get(k, 0) + 1
    assert {(r["window_start"], r["event_type"]): r["n"] for r in t.read().collect()} == want


# --- delimited files ----------------------------------------------------------------------------------------------------


def test_cells_and_reasons():
    assert D.cells_of('a;"b; ""c""" ;d', ";") == (["a", 'b; "c"', "d"], [])
    assert D.cells_of('a"b;c"d', ";") == (["ab;cd"], ["text_after_closing_quote"])
    assert D.cells_of('"a" x;"b', ";") == (["ax", "b"], ["text_after_closing_quote", "unclosed_quote"])
    assert D.cells_of('"a" "b";c', ";") == (["ab", "c"], ["quote_after_closing_quote"])
    assert D.delimiter_of('"a,b";c,d') == ";" and D.delimiter_of("plain") == ","


def delimited_text(rng, n):
    out = ["﻿Name|Two Words|N"]
    for i in range(n):
        cell = rng.choice(["", "plain", "é" * rng.randint(0, 9), '"quoted | one"', '"two\nlines"', '"and\r\n""three""\r\nlines"', '"a"b'])
        out.append(f"{cell}|{rng.choice(['x', '', '1,5'])}|{i}" + rng.choice(["", "", "|more"]))
    return "".join(line + rng.choice(["\n", "\r\n", "\r"]) for line in out) + '\n\n"open|cell'


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_what_one_stream_gives(spark, tmp_path, size):
    rng = random.Random(7)
    texts = [delimited_text(rng, 40), "", "Name|Other\nonly|1", delimited_text(rng, 8)]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(t.encode())
    (tmp_path / "_hidden.csv").write_text("no")
    if size == 1:
        texts = texts[2:3]
        for i in (0, 1, 3):
            os.remove(tmp_path / f"f{i}.csv")
    got = sorted((os.path.basename(r["_file"]), r["_at"], r["name"], r["_columns"], r["_malformed"]) for r in D.read_delimited_files(spark, str(tmp_path), range_bytes=size).collect())
    want = []
    for f in sorted(os.listdir(tmp_path)):
        if not f.startswith("_"):
            want += [(f, at, cells[0], len(cells), ",".join(why) or None) for _, at, cells, why in D.rows_of(D.Piece(str(tmp_path / f)), None)]
    assert got == sorted(want) and len(got) == (51 if size > 1 else 1)


def test_archive_entries_are_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        for i in range(5):
            z.writestr(f"in/Chain_{i}.csv", f"Code;Price\n{i};1,5\n{i};2\n")
        z.writestr("read.me", "no")
    df = D.read_delimited_files(spark, str(tmp_path))
    assert df.columns[:2] == ["code", "price"] and df.rdd.getNumPartitions() == 5
    assert sorted((r["_entry"], r["code"], r["price"]) for r in df.collect()) == [(f"in/Chain_{i}.csv", str(i), p) for i in range(5) for p in ("1,5", "2")]


def test_sessions_of_batches_in_any_order(spark, tmp_path):
    """Late events join sessions, a batch that comes again changes nothing, and those at the end of the events are there too."""
    import datetime as dt

    from tallyspark.sources.buckets import BucketTable
    from tallyspark.streaming import capture as C

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, at(0)), (1, at(10)), (2, at(0)), (None, at(3))], [(1, at(5)), (2, at(6)), (3, None)], [(1, at(90)), (1, at(-7)), (1, at(-1)), (2, at(1))]]
    table = BucketTable(spark, str(tmp_path / "t"), ["who", "start"], C.SESSION, 4)
    write = C.merge_sessions(table, "s")
    for k in (0, 1, 1, 2):
        write(spark.createDataFrame(batches[k], "user_id long, ts timestamp"), k)
    want, last = {}, {}
    for user, t in sorted((e for b in batches for e in b if e[1]), key=lambda e: (str(e[0]), e[1])):
        if user not in last or t >= last[user][1] + dt.timedelta(hours=6):
            last[user] = [t, t]
            want[user, t] = 0
        last[user][1] = t
        want[user, last[user][0]] += 1
    got = {(r["user_id"], r["start"]): r["n"] for r in table.read().filter("n > 0").collect()}
    assert got == want and len(got) == 5


def test_sessions_hold_all_events(spark):
    from tallyspark.plans import catalogue  # noqa: F401
    from tallyspark.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    assert QUERIES["stream_sessions"](spark, d).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{d}/events.parquet").count()
