"""Connected components of a table of edges, without bringing edges or labels to the driver.

Edges that one task can hold (`TASK_EDGES`, counted first) are joined there by union-find. More of them first lose, task by
task, those that a spanning forest of the task's edges makes needless; then come rounds of two steps until the edges no longer change. Large star: each node's larger neighbours are joined to the least
of its neighbours and itself. Small star: each node and its smaller neighbours are joined to the least of them. The result is a
star around the least node of each component. Every round's edges are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, parts_for, rows_in, save

TASK_EDGES = 250_000


def forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) as stars around the least nodes of that partition's components."""
    raw = edges.schema["u"].dataType.simpleString() == "binary"
    columns = ["u", "v"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for b in batches:
            for u, v in zip(b["u"], b["v"]):
                u, v = (bytes(u), bytes(v)) if raw else (u, v)
                a, c = find(_own(root, u)), find(_own(root, v))
                if a != c:
                    root[max(a, c)] = min(a, c)
        rows = [(u, find(u)) for u in root]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=columns)

    return edges.select(*columns).mapInPandas(run, edges.select(*columns).schema)


def _own(root: dict, x):
    root.setdefault(x, x)
    return x


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of any orderable type: node, label (the least node of its component); nodes without edges have no row."""
    now = save(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", narrow=True, rows="true")
    parts = parts_for(rows_in(now), TASK_EDGES)
    step = save(forest(now.coalesce(1) if parts == 1 else now.repartition(parts, "u")), "edges")
    forget(now)
    now, mark = step, None
    while parts > 1:
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if not state["n"] or (state["n"], state["x"]) == mark:
            break
        mark = (state["n"], state["x"])
        step = save(_star(_star(now, True), False), "edges", narrow=True)
        forget(now)
        now = step
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
