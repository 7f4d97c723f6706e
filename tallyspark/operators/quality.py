"""Validation of source rows, quarantine, audits, and filters whose parts may be absent."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import rate


def validate(rows: DataFrame, rules: dict[str, Callable[[], Column]], fatal: Iterable[str]) -> DataFrame:
    """rows with reasons (the names of the rules broken) and status: invalid if a fatal one is, suspect if any is, else valid."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test(), F.lit(False)), name) for name, test in rules.items()]))
    out = rows.withColumn("reasons", reasons)
    bad = F.arrays_overlap("reasons", F.array(*[F.lit(f) for f in fatal]))
    return out.withColumn("status", F.when(bad, "invalid").when(F.size("reasons") > 0, "suspect").otherwise("valid"))


def runtime_safe(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("status", F.lit("valid")) != "invalid")


def audit(marked: DataFrame, dependents: DataFrame, key: str = "product_id") -> DataFrame:
    """Products and dependent rows by status; dependents are counted per key before they are joined."""
    per = dependents.groupBy(key).agg(F.count("*").alias("n"))
    return marked.join(per, key, "left").groupBy("status").agg(F.count("*").alias("products"), F.coalesce(F.sum("n"), F.lit(0)).alias("dependent_rows"))


def constrained(rows: DataFrame, at_most: dict | None = None, contains: dict | None = None, equals: dict | None = None) -> DataFrame:
    """Every constraint that has a value must hold; text compares without case."""
    low = lambda c: F.lower(F.col(c))
    tests = [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    tests += [F.contains(low(c), F.lit(str(v).lower())) for c, v in (contains or {}).items() if v is not None]
    tests += [low(c) == str(v).lower() for c, v in (equals or {}).items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def matches(rows: DataFrame, scalars: dict | None = None, arrays: dict | None = None, flags: dict | None = None, least_confidence: float | None = None) -> DataFrame:
    """Enrichment filters: trimmed equality without case, any of an array's values, flags where null is false, and a least confidence."""
    norm = lambda x: F.lower(F.trim(x))
    tests = [norm(F.col(c)) == str(v).strip().lower() for c, v in (scalars or {}).items() if v is not None]
    any_of = lambda vs: lambda x: norm(x).isin(*[str(v).strip().lower() for v in vs])
    tests += [F.exists(c, any_of(vs)) for c, vs in (arrays or {}).items() if vs]
    tests += [F.coalesce(F.col(c), F.lit(False)) == v for c, v in (flags or {}).items() if v is not None]
    if least_confidence is not None:
        tests.append(F.col("confidence") >= least_confidence)
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def first_reason(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """rows with the first reason that excludes them, else null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(list(reasons.items())):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return rows.withColumn("excluded_by", out)


def count_rollups(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """How often each value of each field occurs, most first by rank, and the share of rows that have the field at all.

    fields: a name and an array of the row's values (one, several or none). All fields go through one pass: a row gives an entry per value, counted before the shuffle.
    """
    whole = rows.agg(F.count("*").alias("rows"))
    some = lambda values: F.filter(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: v.isNotNull() & (v != ""))
    none_type = "array<struct<field:string,value:string>>"
    none = F.array().cast(none_type)

    def entry(field: str):
        return lambda x: F.struct(F.lit(field).alias("field"), x.cast("string").alias("value"))

    def of(field: str, values: Column) -> Column:
        return F.when(F.size(some(values)) > 0, F.concat(F.transform(some(values), entry(field)), F.array(entry(field)(F.lit(None)))).cast(none_type)).otherwise(none)

    entries = F.flatten(F.array(*[of(k, v) for k, v in fields.items()]))
    counts = rows.select(F.explode(entries).alias("e")).groupBy("e.field", "e.value").agg(F.count("*").alias("n"))
    # the entry without a value counts the rows that have the field
    have = counts.filter("value IS NULL").select("field", F.col("n").alias("__have"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    out = counts.filter("value IS NOT NULL").withColumn("rank", rank).join(F.broadcast(have), "field").join(F.broadcast(whole))
    return out.select("field", "value", "n", "rank", rate(F.col("__have"), F.col("rows")).alias("coverage"))
