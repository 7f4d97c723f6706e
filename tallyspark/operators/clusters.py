"""Greedy clusters in parallel: what a loop over all items would give, without a task that holds a group.

The loop takes items in order; each joins the most similar head so far, if that reaches the threshold, and is a new head if not. So an item is a head if no head before it is near enough. In a round the first
`batch` items of each group that no head covers are taken through the loop among themselves (a bounded task), and the heads that this gives are shown to all items of the group in parallel: items behind a head
remember their best one, and those it covers can't be heads. The items of a round are decided, so rounds end; a head that covers much saves many. The work is items times heads, which the loop has too.

Heads of a round are broadcast; the batch is cut so that all groups' heads stay within `MOST_BYTES`, and groups are taken in turns where one head each is more.

Cases. Equal vectors are near by any threshold up to 1; a zero vector is near nothing. Ties in similarity, to twelve places, go to the earlier head, ties in order to the smaller name; names are distinct in a group. Null groups are one
group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.tables import work_dir

BATCH, MOST_BYTES = 1000, 32 << 20
STATE = "grp string, name string, weight double, vector array<double>, best double, head string, decided boolean"


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=float) for v in vectors])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines to twelve places, so that the shape of a product doesn't decide ties."""
    return np.round(a @ b.T, 12)


def heads_among(names: list[str], weights: list[float], vectors: np.ndarray, threshold: float) -> list[int]:
    """Places of the heads that the loop finds among items that nothing before covers."""
    heads: list[int] = []
    held = np.zeros_like(vectors)
    for i in sorted(range(len(names)), key=lambda i: (-weights[i], names[i])):
        if not heads or similar(vectors[i : i + 1], held[: len(heads)]).max() < threshold:
            held[len(heads)] = vectors[i]
            heads.append(i)
    return heads


def greedy(items: DataFrame, threshold: float, group: str, name: str, weight: str, vector: str, batch: int = BATCH) -> DataFrame:
    """grp, name, head and similarity of each item (1 for heads); see the module. Larger weights come first."""
    spark, at = items.sparkSession, work_dir(items.sparkSession)
    now = items.select(F.col(group).cast("string").alias("grp"), F.col(name).alias("name"), F.col(weight).cast("double").alias("weight"), F.col(vector).cast("array<double>").alias("vector"))
    now = now.withColumns({"best": F.lit(None).cast("double"), "head": F.lit(None).cast("string"), "decided": F.lit(False)})
    now.write.parquet(f"{at}/round0")
    now, number = spark.read.parquet(f"{at}/round0"), 0
    groups, dims = now.agg(F.count_distinct(F.struct("grp")), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    each = 8 * dims + 100
    turns = max(1, -(-groups * each // MOST_BYTES))
    batch = max(1, min(batch, MOST_BYTES // max(1, each * -(-groups // turns))))

    def loop(rows: pd.DataFrame) -> pd.DataFrame:
        found = heads_among(rows["name"].tolist(), rows["weight"].tolist(), unit(rows["vector"]), threshold)
        return rows.iloc[found][["grp", "name", "weight", "vector"]]

    while not now.filter("not decided").isEmpty():
        turn = F.pmod(F.xxhash64("grp"), F.lit(turns)) == number % turns
        first = Window.partitionBy("grp").orderBy(F.desc("weight"), "name")
        taken = now.filter(~F.col("decided") & turn).withColumn("__k", F.row_number().over(first)).filter(F.col("__k") <= batch).drop("__k")
        found = taken.select("grp", "name", "weight", "vector").groupBy("grp").applyInPandas(loop, "grp string, name string, weight double, vector array<double>").collect()
        heads: dict[str | None, list] = defaultdict(list)
        for r in sorted(found, key=lambda r: (-r["weight"], r["name"])):
            heads[r["grp"]].append(r)
        shared = spark.sparkContext.broadcast({g: ([r["name"] for r in rs], np.array([r["weight"] for r in rs]), unit([r["vector"] for r in rs])) for g, rs in heads.items()})

        def show(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b.reset_index(drop=True)
                places = defaultdict(list)
                for i, g in enumerate(b["grp"]):
                    places[g if isinstance(g, str) else None].append(i)
                for g, own in places.items():
                    if g not in shared.value:
                        continue
                    names, weights, vectors = shared.value[g]
                    rows = b.loc[own]
                    near = similar(unit(rows["vector"]), vectors)
                    mine = np.array([[(w > x) or (w == x and n <= m) for n, w in zip(names, weights)] for m, x in zip(rows["name"], rows["weight"])])
                    near = np.where(mine, near, -np.inf)
                    best = near.argmax(axis=1)
                    for k, i in enumerate(own):
                        n, s = names[best[k]], float(near[k, best[k]])
                        if n == b.at[i, "name"] and not b.at[i, "decided"]:
                            b.at[i, "best"], b.at[i, "head"], b.at[i, "decided"] = 1.0, n, True
                        elif b.at[i, "head"] != b.at[i, "name"] and s >= threshold and (pd.isna(b.at[i, "best"]) or s > b.at[i, "best"]):
                            b.at[i, "best"], b.at[i, "head"], b.at[i, "decided"] = s, n, True
                yield b

        number += 1
        now.mapInPandas(show, STATE).write.parquet(f"{at}/round{number}")
        now = spark.read.parquet(f"{at}/round{number}")
    return now.select("grp", "name", "head", F.col("best").alias("similarity"))
