"""Points where a user's own service comes in: translation, enrichment, geocoding, optimisation.

A provider is a function from a DataFrame of what is asked to a DataFrame of answers, so that it runs as a Spark job of its own (a join with a table,
or `mapInPandas` with a client per task). Each distinct question is asked once, and what a provider leaves out falls back to the offline form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[DataFrame], DataFrame]


def translated(rows: DataFrame, column: str, provider: Provider | None, into: str = "translated") -> DataFrame:
    """rows with `into`: the provider's answer (rows text, answer) for the column's value, the value itself where there is none."""
    if provider is None:
        return rows.withColumn(into, F.col(column))
    asked = rows.select(F.col(column).alias("text")).filter("text IS NOT NULL").distinct()
    answers = provider(asked).groupBy("text").agg(F.max("answer").alias("__answer"))
    return rows.join(answers.withColumnRenamed("text", "__text"), F.col(column) == F.col("__text"), "left").withColumn(into, F.coalesce("__answer", column)).drop("__text", "__answer")


def checked(answers: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """answers with errors: the names of the rules (what must hold) that don't; an unknown counts as an error."""
    return answers.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def enriched(rows: DataFrame, key: str, kept: DataFrame, provider: Provider, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Enrichment records of all rows that have a sound one, and the refused answers with their errors.

    kept: records of earlier runs by key, which aren't asked for again. The provider is asked for the other rows only.
    """
    fresh = checked(provider(rows.join(kept, key, "left_anti")), rules)
    sound = fresh.filter(F.size("errors") == 0).select(*kept.columns)
    old = kept.join(rows.select(key).distinct(), key, "left_semi").select(*kept.columns, F.lit("kept").alias("origin"))
    return old.unionByName(sound.withColumn("origin", F.lit("provider"))), fresh.filter(F.size("errors") > 0)


def geocoded(places: DataFrame, key: str, cache: DataFrame, provider: Provider | None) -> DataFrame:
    """places with lat, lon and path: from the cache (key, lat, lon), else from the provider, else none. Each distinct key is asked once."""
    rows = places.join(cache.select(key, F.struct("lat", "lon").alias("__c")), key, "left")
    if provider is None:
        return rows.select(*places.columns, "__c.lat", "__c.lon", F.when(F.col("__c").isNotNull(), "cache").otherwise("none").alias("path"))
    answers = provider(places.select(key).distinct().join(cache, key, "left_anti")).groupBy(key).agg(F.min(F.struct("lat", "lon")).alias("__p"))
    rows = rows.join(answers, key, "left")
    path = F.when(F.col("__c").isNotNull(), "cache").when(F.col("__p").isNotNull(), "provider").otherwise("none")
    return rows.select(*places.columns, F.coalesce("__c.lat", "__p.lat").alias("lat"), F.coalesce("__c.lon", "__p.lon").alias("lon"), path.alias("path"))


def optimised(problems: DataFrame, key: str, solver: Provider, fallback: Provider) -> DataFrame:
    """Solutions by key: the solver's where it has a feasible one, the fallback's for the other problems; `solved_by` says whose.

    solver, fallback: from problems to rows of one schema with the key; the solver's also have `feasible`.
    """
    own = solver(problems).filter("feasible").drop("feasible")
    rest = fallback(problems.join(own.select(key).distinct(), key, "left_anti"))
    return own.withColumn("solved_by", F.lit("solver")).unionByName(rest.withColumn("solved_by", F.lit("fallback")))
