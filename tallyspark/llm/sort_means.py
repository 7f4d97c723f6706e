"""Centroid clustering by sort-means, in whole numbers.

A component x becomes floor(scale * x). Centroids start as the vectors of least hash. Each round orders, for every centroid, the others by their
distance from it; a vector starts at the centroid it had before, which gives its current distance, and looks at the others in that order. A centroid
further from the former one than twice the current distance can't be nearer or as near, and neither can those behind it, so the scan stops there (strictly
beyond: at exactly twice a tie is possible). Distances are squared and exact, so "twice" is four times.

Vectors lie as whole numbers, with the centroid they have, in a table of the shared folder, written anew each round: a round reads it once and writes it
once. Sums of a centroid are added per task first; what comes to the driver is one row a centroid (k, at most `MOST_CENTROIDS`, and the length of vectors are parameters, together at most `LARGEST`
numbers), and so is what goes to the tasks.

Cases. Vectors that are null, of another length, or hold a null or non-finite component (or one that isn't finite after scaling) take no part. Without vectors the
result is empty; with fewer than k, each starts a centroid. Null identifiers hash as `null`. Of equal hashes (rows of one identifier) the vector that is least in packed bytes comes first; repeated rows are rows of their own.
Components of any size are exact: beyond 2^27 they are Python's integers. A distance or sum that a long can't hold is null. Other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, save, short_batches

K, ROUNDS, SCALE, SEED, DIM = 16, 3, 64, "1", 64
#: Numbers that all centroids have together, and centroids, at most: each task holds the centroids and the order of all others for each.
LARGEST, MOST_CENTROIDS = 1 << 20, 2048
#: Components up to this size are held as int64: 64 squares of twice that stay below 2^62.
PLAIN = 1 << 27
LONG = (1 << 63) - 1


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to c, exact."""
    d = x - c
    return (d * d).sum(axis=1)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid, all others by squared distance from it (ties: smaller number), and these distances."""
    k = len(centroids)
    order, far = np.zeros((k, k - 1), dtype=np.int64), np.zeros((k, k - 1), dtype=centroids.dtype)
    for a in range(k):
        d = distances(centroids, centroids[a])
        by = sorted((j for j in range(k) if j != a), key=lambda j: (d[j], j))
        order[a], far[a] = by, d[by]
    return order, far


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and squared distance of each row of x. before: the centroid that it had; seen: gets the number of distances."""
    best, least = before.copy(), np.zeros(len(x), dtype=x.dtype)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        current = distances(x[rows], centroids[a])
        # those with the largest current distance scan furthest, so the rows that still scan are a prefix
        by = np.argsort(-current, kind="stable")
        rows, current = rows[by], current[by]
        near, number = current.copy(), np.full(len(rows), a)
        scan, looked = len(rows), len(rows)
        for j, d in zip(order[a], far[a]):
            scan = int(np.count_nonzero(d <= 4 * current[:scan]))
            if not scan:
                break
            looked += scan
            to = distances(x[rows[:scan]], centroids[j])
            better = (to < near[:scan]) | ((to == near[:scan]) & (j < number[:scan]))
            near[:scan][better], number[:scan][better] = to[better], j
        best[rows], least[rows] = number, near
        if seen is not None:
            seen.append(looked)
    return best, least


def _packed(rows: np.ndarray) -> list[bytes]:
    """Whole numbers (as doubles) in four bytes a component; decimal text, of another length, for a vector with a component beyond PLAIN."""
    dim = rows.shape[1]
    narrow = (np.abs(rows) <= PLAIN).all(axis=1)
    raw = np.where(narrow[:, None], rows, 0).astype("<i4").tobytes()
    out = [raw[i * 4 * dim : (i + 1) * 4 * dim] for i in range(len(rows))]
    for i in np.flatnonzero(~narrow).tolist():
        text = ",".join(str(int(v)) for v in rows[i].tolist())
        out[i] = (text if len(text) != 4 * dim else text + " ").encode()
    return out


def _matrix(cells: pa.Array, dim: int) -> np.ndarray:
    """The rows that _packed made: int64, or Python's integers if one of them is wide."""
    raw = cells.to_pylist()
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), dtype="<i4").reshape(-1, dim).astype(np.int64)
    numbers = [np.frombuffer(r, dtype="<i4").tolist() if len(r) == 4 * dim else [int(t) for t in r.split(b",")] for r in raw]
    out = np.empty((len(raw), dim), dtype=object)
    out[:] = numbers
    return out


def _points(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """row, id and the packed whole numbers of the vectors that take part."""
    x = F.col(vector_col)
    sound = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) == float("inf")))
    rows = vectors.filter(sound).select(F.col(id_col).alias("id"), x.cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed = _packed(np.floor(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * scale))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary()), pa.array(np.zeros(len(packed), dtype=np.int32))], ["id", "point", "cluster"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, point binary, cluster int")


def _assigned(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """points with the cluster that they have now, and its squared distance as text."""
    dim = len(centroids[0])
    plain = max(abs(v) for c in centroids for v in c) <= PLAIN
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("point"), dim)
            wide = x.dtype == object or not plain
            if wide not in held:
                c = np.array(shared.value, dtype=object if wide else np.int64)
                held[wide] = (c, *neighbours(c))
            best, least = assign(x.astype(object) if wide else x, b.column("cluster").to_numpy().astype(np.int64), *held[wide])
            distance = pa.array([int(d) if d <= LONG else None for d in least], pa.int64()) if wide else pa.array(least, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("point"), pa.array(best.astype(np.int32)), distance], ["id", "point", "cluster", "distance"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "point", "cluster").mapInArrow(run, f"id {kind}, point binary, cluster int, distance long")


def _sums(points: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster: added per task, then by cluster and place; one row a cluster comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, cluster = _matrix(b.column("point"), dim), b.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                count[c] = count.get(c, 0) + len(own)
                total[c] = [s + int(t) for s, t in zip(total.get(c, [0] * dim), own.sum(axis=0).tolist())]
        flat = [(c, i, count[c], str(s)) for c, sums in total.items() for i, s in enumerate(sums)]
        c, i, n, s = zip(*flat) if flat else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.string())], ["cluster", "place", "n", "s"])

    parts = points.select("point", "cluster").mapInArrow(add, "cluster int, place int, n long, s string")
    if parts.filter(F.length("s") > 18).isEmpty():
        rows = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    else:  # numbers that no decimal holds: a task's sums are one row a cluster and place, and are added as Python's integers
        rows = parts.groupBy("cluster", "place").applyInArrow(_add_wide, "cluster int, place int, n long, s string").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["cluster"], (r["n"], [0] * dim))[1][r["place"]] = int(r["s"])
    return out


def _add_wide(table: pa.Table) -> pa.Table:
    return pa.table({"cluster": table["cluster"][:1], "place": table["place"][:1], "n": [sum(table["n"].to_pylist())], "s": [str(sum(map(int, table["s"].to_pylist())))]}, schema=table.schema)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """The vectors that take part (id, cluster, distance), and the centroids they were assigned to last."""
    if k > MOST_CENTROIDS or k * dim > LARGEST:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids of {LARGEST} numbers together go to each task")
    spark = vectors.sparkSession
    short_batches(spark)
    points = save(_points(vectors, id_col, vector_col, dim, scale), "means-points")
    ordered = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = points.select("point", ordered.alias("h")).orderBy("h", "point").limit(k).collect()
    if not first:
        return points.select("id", "cluster", F.lit(0).cast("long").alias("distance")), []
    centroids = [[int(v) for v in _matrix(pa.array([bytes(r["point"])], pa.binary()), dim)[0]] for r in first]
    for _ in range(rounds):
        now = save(_assigned(points, centroids), "means-points")
        forget(points)
        points = now
        for c, (n, s) in _sums(points, dim).items():
            centroids[c] = [v // n for v in s]
    out = save(_assigned(points, centroids).select("id", "cluster", "distance"), "means-clusters")
    forget(points)
    return out, centroids


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """Per vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the centroid's components as decimal integers, joined by commas)."""
    spark = vectors.sparkSession
    out, centroids = cluster(vectors, **how)
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("wide")).collect()
    held = {r["cluster"]: None if r["wide"] or r["s"] > LONG else int(r["s"]) for r in sums}
    inertia = sum(held.values()) if all(v is not None for v in held.values()) else None
    inertia = None if inertia is None or inertia > LONG else inertia
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, s, inertia, digest[c]) for c, s in held.items()]
    # one row a centroid
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(stats), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
