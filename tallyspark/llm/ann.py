"""Nearest neighbours of a query set by a block matrix join.

Vectors are scaled to length one and rounded to int8 with a scale of their own. Rows are packed into blocks; each block
of candidates meets each block of queries in one tile: a product of the int8 matrices, exact in single precision as the
sums stay below 2^24 (in double beyond). The rounding errors of both sides bound how far a tile's cosine is from the true one;
a tile keeps the pairs whose upper bound reaches the k-th best lower bound that its task has seen for the query, and a query then those that reach the
k-th best of all tiles. These survivors, few more than k a query, meet their original vectors and are computed again in double precision, in the order
of the components; heaps of k per query merge them.

Of equal vectors a query can want those of the k + 1 smallest identifiers only (one may be its own), k rows of each at most. They are found by two 128-bit hashed keys before
blocks are made: ranks are limited in each task before its rows move, so a common vector costs a few rows a task, and stays few rows among the candidates however many blocks there are.

A task holds a group of some `GROUP` blocks of each side, as codes of one byte a component, and multiplies them tile by tile: a block travels once to each group of the other side, not to each
block. Vectors travel for survivors only. The product itself has the cost that exact search has.

Cases. Vectors that are null, empty, all zero, or hold null or non-finite components take no part, neither do those of another length
than the query's. Vectors of very large or very small components, whose squares a double can't hold, are divided by their largest one first. A null identifier takes no part. Ties go to the smaller identifier. Of rows repeated with one identifier each is a
candidate; a query that is repeated is asked once, and no row of the query's own identifier is a candidate. Other columns pass by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, parts_for, save, short_batches, small

BLOCK, QUERY_BLOCK = 4096, 1024
#: Blocks of a group, on average.
GROUP = 16
#: Largest components outside these bounds are scaled away, as sums of squares would leave a double's range.
SQUARES = (1e-140, 1e140)
PACKED = "block long, dim int, n int, ids binary, rows binary, codes binary, scale binary, error binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors of x, their scales, and the lengths of the rounding errors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def tile(codes_q: np.ndarray, scale_q: np.ndarray, error_q: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines, and how far each can be from the true one.

    |<a, b> - <a', b'>| <= |a - a'| |b| + |a'| |b - b'|, where |b| = 1 and |a'| <= 1 + |a - a'|.
    """
    kind = np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (codes_q.astype(kind) @ codes.astype(kind).T).astype(np.float64)
    near = product * scale_q[:, None] * scale[None, :]
    return near, error_q[:, None] + (1 + error_q[:, None]) * error[None, :] + 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, adding components in their order."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot = dot + a[:, j] * b[:, j]
        aa = aa + a[:, j] * a[:, j]
        bb = bb + b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def best_of_tile(q_ids, q_int8, c_ids, c_int8, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and candidates that may be among a query's k best, with lower and upper bounds; floor: a lower bound of each query's k-th best."""
    near, off = tile(*q_int8, *c_int8)
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, near - off)
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    rows, cols = np.nonzero((near + off >= floor[:, None]) & ~own)
    return rows, cols, low[rows, cols], (near + off)[rows, cols]


def wanted_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """Numbers of the rows (id, row, vector) that no query can want: of equal vectors all but those of the k + 1 smallest identifiers, k of each."""
    keyed = rows.select("id", "row", F.xxhash64("vector").alias("one"), F.xxhash64("vector", F.lit(7)).alias("two"))
    # vectors that occur once need no ranks
    many = keyed.groupBy("one", "two").agg(F.count("*").alias("n")).filter(F.col("n") > k).drop("n")
    keyed = save(keyed.join(small(many, 32), ["one", "two"], "left_semi"), "ann-equal", narrow=True)
    of_id = Window.partitionBy("one", "two", "id").orderBy("row")
    of_vector = Window.partitionBy("one", "two").orderBy("id")
    some = keyed.withColumn("place", F.row_number().over(of_id)).filter(F.col("place") <= k).drop("place")
    some = some.withColumn("place", F.dense_rank().over(of_vector)).filter(F.col("place") <= k + 1)
    out = save(keyed.join(small(some.select("row"), 16), "row", "left_anti").select("row"), "ann-unwanted", narrow=True)
    forget(keyed)
    return out


def _pack(ids: list[int], rows: list[int], vectors: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows of equal length become one packed row."""
    for dim in sorted({len(v) for v in vectors}):
        at = [i for i, v in enumerate(vectors) if len(v) == dim]
        codes, scale, error = quantise(np.stack([vectors[i] for i in at]).astype(np.float64))
        numbers = [np.array([x[i] for i in at], dtype=np.int64).tobytes() for x in (ids, rows)]
        yield pd.DataFrame([(0, dim, len(at), *numbers, codes.tobytes(), scale.tobytes(), error.tobytes())], columns=[c.split()[0] for c in PACKED.split(", ")])


def _unpack(row) -> tuple:
    n, dim = row.n, row.dim
    arr = lambda raw, kind: np.frombuffer(raw, dtype=kind)
    return arr(row.ids, np.int64), arr(row.rows, np.int64), (arr(row.codes, np.int8).reshape(n, dim), arr(row.scale, np.float64), arr(row.error, np.float64))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack rows (id, row, vector) into rows of at most `size` vectors, dealt evenly without a key."""
    parts = parts_for(rows.count(), size)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            for i, r, v in zip(b["id"], b["row"], b["vector"]):
                held.append((int(i), int(r), np.asarray(v, dtype=np.float64)))
                if len(held) == size:
                    yield from _pack(*map(list, zip(*held)))
                    held = []
        if held:
            yield from _pack(*map(list, zip(*held)))

    # dealt by the rows' numbers: a task that runs again packs the same block
    packed = rows.repartition(parts, F.xxhash64("row")).mapInPandas(pack, PACKED)
    return packed.withColumn("block", F.monotonically_increasing_id())


def sound(x: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)


def in_range(x: Column) -> Column:
    """The vector, divided by its largest component where squares would underflow or overflow; cosines stay as they are."""
    most = F.array_max(F.transform(x, F.abs))
    return F.when(most.between(*SQUARES), x).otherwise(F.transform(x, lambda v: v / most))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows query_id, rank, id, score: the k nearest of each query by cosine, nearest first."""
    short_batches(vectors.sparkSession)
    x = F.col(vector_col)
    rows = vectors.filter(F.col(id_col).isNotNull() & sound(x)).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), in_range(x.cast("array<double>")).alias("vector"), is_query.alias("asks"))
    rows = save(rows, "ann-vectors")
    unwanted = wanted_of_equals(rows, k)
    candidates = rows.select("id", "row", "vector").join(small(unwanted, 16), "row", "left_anti")
    data = save(blocks(candidates.select("id", "row", "vector"), block), "ann-blocks")
    asked = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    queries = save(blocks(asked.withColumn("row", F.col("id")), query_block), "ann-queries")
    groups, query_groups = parts_for(data.count(), GROUP), parts_for(queries.count(), GROUP)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = data.withColumn("p", dealt(groups)).withColumn("q", each(query_groups))
    right = queries.withColumn("q", dealt(query_groups)).withColumn("p", each(groups))

    def search(of_data: pd.DataFrame, of_queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.array([], dtype=np.int64), "row": np.array([], dtype=np.int64), "low": np.array([]), "high": np.array([])})]
        packed = [(c.dim, *_unpack(c)) for c in of_data.itertuples(index=False)]
        for q in of_queries.itertuples(index=False):
            q_ids, _, q_int8 = _unpack(q)
            floor, parts = np.full(len(q_ids), -np.inf), []
            heaps: list[list[float]] = [[] for _ in q_ids]
            for dim, c_ids, c_rows, c_int8 in packed:
                if dim != q.dim:
                    continue
                at, cols, low, high = best_of_tile(q_ids, q_int8, c_ids, c_int8, k, floor)
                for i, bound in zip(at.tolist(), low.tolist()):
                    heap = heaps[i]
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, bound)
                floor = np.array([h[0] if len(h) == k else -np.inf for h in heaps])
                parts.append((at, c_rows[cols], low, high))
            for at, found, low, high in parts:  # the floor has risen since
                keep = high >= floor[at]
                out.append(pd.DataFrame({"query_id": q_ids[at[keep]], "row": found[keep], "low": low[keep], "high": high[keep]}))
        return pd.concat(out)

    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q"))
    found = save(met.applyInPandas(search, "query_id long, row long, low double, high double"), "ann-found", narrow=True)
    kth = Window.partitionBy("query_id").orderBy(F.desc("low"), "row")
    floors = found.withColumn("place", F.row_number().over(kth)).filter(F.col("place") == k).select("query_id", F.col("low").alias("floor"))
    left_over = save(found.join(floors, "query_id", "left").filter("floor is null or high >= floor").select("query_id", "row"), "ann-survivors", narrow=True)
    n = left_over.count()
    of_row = small(left_over, 32, n).join(rows.select("row", "id", F.col("vector").alias("c")), "row")
    pairs = of_row.join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id").select("query_id", "id", "q", "c")

    def exactly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"query_id": b["query_id"], "id": b["id"], "score": cosines(np.stack(b["q"]), np.stack(b["c"])) if b["q"].map(len).nunique() == 1 else [float(cosines(q[None], c[None])[0]) for q, c in zip(b["q"], b["c"])]})

    scored = pairs.mapInPandas(exactly, "query_id long, id long, score double")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition has all rows of its queries."""
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, c, s in zip(b["query_id"].tolist(), b["id"].tolist(), b["score"].tolist()):
                heap = heaps.setdefault(q, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -c))
        out = [(q, r, -c, s) for q, heap in heaps.items() for r, (s, c) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(out, columns=["query_id", "rank", "id", "score"]).astype({"query_id": "int64", "rank": "int32", "id": "int64", "score": "float64"})

    out = save(scored.repartition("query_id").mapInPandas(merge, "query_id long, rank int, id long, score double"), "ann-nearest", narrow=True)
    forget(rows, unwanted, data, queries, found, left_over)
    return out
