"""Sort-means, importance resampling and line dedup against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import line_dedup as L
from tallyspark.llm import resampling as R
from tallyspark.llm import sort_means as S

# --- sort-means ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, cluster int, id string"


def brute_means(rows, k, rounds, dim, scale=64):
    kept = [(i, [math.floor(v * scale) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest())
    cs = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        for j, xs in own.items():
            cs[j] = [sum(col) // len(xs) for col in zip(*xs)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), cs


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], VECTORS)


@pytest.mark.parametrize("size", [1.0, 1e7, 1e30])
def test_means_match_brute_force(spark, size):
    rng = random.Random(3)
    spread = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for _ in range(6)]
    rows = [(i, [c * size + rng.choice([-0.3, 0, 0.3]) for c in spread[i % 6]]) for i in range(200)]
    rows += [(500, None), (501, [1.0]), (502, [None, 1.0, 1.0, 1.0]), (503, [math.nan, 1.0, 1.0, 1.0]), (504, [math.inf, 1.0, 1.0, 1.0]), (505, [1e308] * 4), (506, []), (None, [0.5] * 4)]
    rows += [(510 + i, [0.25, -0.25, 0.5, 1.0]) for i in range(100)]  # one vector with a third of the rows
    sound = [r for r in rows if r[0] != 505]
    want, cs = brute_means(sound, 5, 3, 4)
    out = S.clusters(vectors(spark, rows), k=5, dim=4)
    got = out.collect()
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got), key=str) == [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    total = defaultdict(int)
    for _, c, d in want:
        total[c] += d
    for r in got:
        assert r["cluster_inertia"] == (total[r["cluster"]] if total[r["cluster"]] < 1 << 63 else None)
        assert r["inertia"] == (sum(total.values()) if sum(total.values()) < 1 << 63 else None)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cs[r["cluster"]])).encode()).hexdigest()


def test_means_scan_stops_and_ties(spark):
    rng = np.random.default_rng(1)
    cs = rng.integers(-400, 400, (16, 8)).astype(np.int64)
    cs[9] = cs[4]  # equal centroids: the smaller number wins
    x = np.repeat(cs, 50, axis=0) + rng.integers(-20, 20, (800, 8))
    order, far = S.neighbours(cs)
    seen = []
    want = ((x[:, None] - cs[None]) ** 2).sum(axis=2)
    best, least = S.assign(x, want.argmin(axis=1), cs, order, far, seen)
    assert (best == want.argmin(axis=1)).all() and (least == want.min(axis=1)).all()
    assert sum(seen) < 3 * len(x)  # of 16 centroids, from the one it had before, a vector looks at few
    best, least = S.assign(x, rng.integers(0, 16, 800), cs, order, far)
    assert (best == want.argmin(axis=1)).all() and (least == want.min(axis=1)).all()


def test_means_empty_and_few(spark):
    assert S.clusters(vectors(spark, []), k=3, dim=2).count() == 0
    assert S.clusters(vectors(spark, [(1, None), (2, [1.0])]), k=3, dim=2).count() == 0
    with pytest.raises(ValueError):
        S.clusters(vectors(spark, []), k=5000, dim=2)
    got = S.clusters(vectors(spark, [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [9.0, 9.0])]), k=16, dim=2).collect()
    assert len(got) == 3 and all(r["distance"] == 0 for r in got)


# --- importance resampling ----------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, rank int, `id` string, weight double"
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "clash", 0.5) for i, t in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def grams(t, n=1):
    w = re.findall(WORD, lower(t))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_scores(rows, target, buckets, n=1, least=3, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, grams(x, n)))
    for x in target:
        t.update(map(bucket, grams(x, n)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out, words = [], []
    for i, x in rows:
        f = grams(x, n)
        w = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        words.append(len(grams(x, 1)))
    able = sorted((r for r, k in zip(out, words) if k >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    rank = Counter()
    drawn = [(*r, k) for k, r in enumerate(able, 1) if k <= percent * len(able) // 100]
    left = Counter(out)
    left.subtract(r[:4] for r in drawn)
    return sorted([*drawn, *[(*r, None) for r, m in left.items() for _ in range(m)]], key=str)


def texts():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Apfel", "été", "q1", "x") for b in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))) + rng.choice(["", ".", "\n!"])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "..."), (None, "Apfel1 apfel2 x3 x4"), (7, "x1 x2 x3 x4"), (7, "x1 x2 x3 x4"), (203, "ÀB çd éf")]
    return rows + [(300, "Same text of all these")] * 80


@pytest.mark.parametrize("n", [1, 2])
def test_scores_match_brute_force(spark, n):
    rows, target = texts(), ["x1 x2 x3 q11 q12", None, "", "Apfel3 apfel4"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = R.scores(docs(spark, rows), bench, buckets=97, n=n, least_words=3)
    assert out.columns == ["id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_scores(rows, target, 97, n)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    t = " ".join(rng.choice(["a", "Bb", "ccc", "é"]) for _ in range(3000)) + "y" * 500
    for n in (1, 2, 3):
        whole = R.feature_counts(t.encode(), n)
        assert whole == Counter(g.encode() for g in grams(t, n))
        monkeypatch.setattr(R, "PIECE", 50)
        assert R.feature_counts(t.encode(), n) == whole
        monkeypatch.undo()


def test_blocks_are_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_COUNTS", 20)
    rows = texts()
    csr = R.matrix(docs(spark, rows), 97)
    got = csr.collect()
    assert sum(len(r["ids"]) for r in got) == len(rows) and len(got) > 10
    sums = R.column_sums(csr, 97)
    assert sums.tolist() == [Counter(zlib.crc32(f.encode()) % 97 for _, t in rows for f in grams(t))[b] for b in range(97)]


def test_resample_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "x1 x2 x3")], "item_id long, text string")
    base = docs(spark, texts())
    out = R.resample(base, bench, buckets=97, least_words=3)
    assert out.columns == base.columns
    drawn = {r["id"] for r in R.scores(base, bench, buckets=97, least_words=3).filter("rank is not null").collect()}
    assert {r["doc_id"] for r in out.collect()} == drawn
    empty = docs(spark, [])
    assert R.resample(empty, bench).count() == 0 and R.scores(base, bench.limit(0), buckets=97).count() == len(texts())


# --- line dedup ---------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    owner = {k: min(v, key=lambda i: (i is None, i)) for k, v in held.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def lined():
    rng = random.Random(9)
    pool = [f"  A common LINE number {i}\t" for i in range(12)] + ["short", "", "   ", "ééééééééé", "éééééééééé", "\r\x0b\x0cabcdefghij", "ABCDEFGHIJ \r", "Äbcdefghijk", "äbcdefghijk"]
    rows = [(i, "\n".join(rng.choices([*pool, f"only here in {i}", f"only here in {i}"], k=rng.randint(0, 12)))) for i in range(120)]
    rows += [(None, "a common line number 3\nanother of nobody"), (None, "another of nobody"), (5, rows[5][1]), (5, rows[5][1]), (200, None), (201, ""), (202, "\n"), (203, "x" * 300_000 + "\n" + "a common line number 1")]
    return rows + [(300 + i, "one line that is everywhere\nbut not this one " + str(i % 7)) for i in range(80)]


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_match_brute_force(spark, parts):
    rows = lined()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = L.line_report(docs(spark, rows).repartition(3)).collect()
        left = L.drop_lines(docs(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_lines(rows)
    assert Counter(tuple(r) for r in got) == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    assert Counter((r["doc_id"], r["text"] or "") for r in left) == Counter((i, t) for i, _, _, t in want)
    assert sum(r["text"] is None for r in left) == 1 and left[0].asDict().keys() == {"doc_id", "text", "lang", "rank", "id", "weight"}


def test_many_partitions_of_one_line(spark):
    # one key over all partitions: owners are carried over several ends
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        rows = [(i, "the same line again and again") for i in range(500, 0, -1)]
        got = L.line_report(docs(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r["id"] for r in got if not r["n_dropped"]} == {1} and len(got) == 500


def test_carried_owners():
    ends = [(0, b"a", 1, b"c", 4), (2, b"c", 6, b"c", 6), (3, b"c", 9, b"d", 2), (4, b"e", 5, b"e", 5)]
    assert {p: o for p, (o,) in L.carried(ends).items()} == {0: 1, 2: 4, 3: 4, 4: 5}


def test_bitmaps_round_trip():
    for places in ([0], [3, 8, 1], list(range(70))):
        assert L.places_of(L.bitmap(places), 100) == set(places)


def test_lines_of_an_empty_table(spark):
    empty = docs(spark, [])
    assert L.line_report(empty).count() == 0 and L.drop_lines(empty).count() == 0 and L.keep_bitmaps(empty).count() == 0
