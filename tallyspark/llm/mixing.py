"""Mixing sources to target weights. DataFrame functions only.

Word counts are summed per source (partial sums first, so that a hot source costs nothing more). The budget is
shared by weight; no source gets more than a fixed multiple of its size, and what it can't take is shared anew. The
closed form of that repeated sharing: order sources by capacity / weight; the level is the first at which the next
source isn't full. A document is then emitted floor(rate) times, rate = target / size of its source, plus one copy if
a hash of seed and identifier, as a number in [0, 1), is under the rate's fraction.

Cases. A null text has no words. Null sources are one source, last in order. A source without words has target 0 and
its documents are not taken. Rows whose identifier is null or repeated draw by identifier, text and the row's number in its table, so each draws for itself; reruns over the same files agree,
and for other rows over any files. Very long texts are counted whole. Empty input gives an empty result. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORDS, every, rows_in, save, small, unit_hash

#: Weights by the sources' order, repeating; the mix's size as a share of all words; largest rate of a source.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From rows (source, size): source, source_size, target, rate. The windows hold one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    t = by_source.withColumn("weight", w).withColumn("room", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("room") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumn("full_before", F.coalesce(F.sum("room").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("full_before")) / F.col("weight_left"))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return t.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def own_draw(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (__id, __content, __number and others) with __u, a number in [0, 1): by identifier, or where that is null or repeated by identifier, text and number."""
    again = rows.filter(F.col("__id").isNotNull()).groupBy("__id").agg(F.count("*").alias("__n")).filter("__n > 1").select("__id", F.lit(True).alias("__again"))
    rows = rows.join(small(save(again, "mix-again", narrow=True, rows="true"), 24), "__id", "left")
    each = F.col("__id").isNull() | F.coalesce("__again", F.lit(False))
    own = unit_hash(F.lit(seed), F.col("__id"), F.col("__content"), F.col("__number"))
    return rows.withColumn("__u", F.when(each, own).otherwise(unit_hash(F.lit(seed), F.col("__id")))).drop("__again", "__content", "__number")


def copies(rate: Column, u: Column) -> Column:
    """floor(rate), plus one with the probability of the rest."""
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__content"), F.monotonically_increasing_id().alias("__number")]


def _words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, rate, copies."""
    sizes = save(docs.select(*_numbered(docs, id_col, text_col), F.col(source_col).alias("source"), _words(text_col).alias("size")), "mix-sizes")
    targets = save(source_targets(sizes, **shares), "mix-targets", rows="true")
    of = small(targets.withColumnRenamed("source", "of"), 200, rows_in(targets))
    out = own_draw(sizes).join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("copies", copies(F.col("rate"), F.col("__u"))).withColumnRenamed("__id", "id").drop("__u")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(_words(text_col)).alias("size"))
    targets = save(source_targets(sizes, **shares), "mix-targets", rows="true")
    of = small(targets.select(F.col("source").alias("__of"), F.col("rate").alias("__rate")), 200, rows_in(targets))
    rows = own_draw(docs.select(F.struct(*every(docs)).alias("row"), F.col(source_col).alias("__source"), *_numbered(docs, id_col, text_col)))
    out = rows.join(of, F.col("__source").eqNullSafe(F.col("__of")))
    times = copies(F.col("__rate"), F.col("__u"))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("row.*")
