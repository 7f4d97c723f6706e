"""Resolving what a shopper asks for: query parsing and rewriting, list scores, families, mappings of ingredients, merges, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_sum, rounded
from tallyspark.functions.text import collapse

#: Shopping-list scores and limits; fixed values.
LIST_RESOLVED, LIST_GAP, LIST_LOW = 0.75, 0.15, 0.45


def parse_query(text: Column, places: tuple[str, ...], brands: tuple[str, ...], cheap: tuple[str, ...], under: str = "under") -> dict[str, Column]:
    """Greatest price ("under 5"), place, brand and intent of a query; each null if absent. The dictionaries are parameters."""
    t = collapse(F.lower(text))
    words = F.split(t, " ")
    found = F.regexp_extract(t, rf"{under}\s+(\d+(?:[.,]\d+)?)", 1)
    first = lambda xs: F.filter(words, lambda w: w.isin(*xs))
    pick = lambda xs: F.when(F.size(first(xs)) > 0, first(xs)[0])
    intent = F.when(F.size(first(cheap)) > 0, "cheapest").when(found != "", "price_limit").otherwise("search")
    return {"price_max": F.when(found != "", F.regexp_replace(found, ",", ".").try_cast("double")), "location": pick(places), "brand": pick(brands), "intent": intent}


def expand(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Each query's words with the terms of the concepts they name. concepts: word, expanded. A join on the word."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return words.join(concepts, "word").select("query_id", "word", "expanded").distinct()


def rewrite(queries: DataFrame, synonyms: DataFrame, corrections: DataFrame) -> DataFrame:
    """Each word by its exact synonym, else its correction, else itself; the query is put together again in order.

    synonyms: word, term. corrections: word, fixed. A query has few words, so putting it together gathers little.
    """
    words = queries.select("query_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    rows = words.join(synonyms, "word", "left").join(corrections, "word", "left").withColumn("out", F.coalesce("term", "fixed", "word"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "out")))
    return rows.groupBy("query_id").agg(F.array_join(ordered["out"], " ").alias("rewritten"), F.count_if(F.col("out") != F.col("word")).alias("rewrites"))


def translate_prefix(text: Column, prefixes: dict[str, str]) -> Column:
    """The longest listed prefix replaced."""
    out = text
    for k in sorted(prefixes, key=len):
        out = F.when(F.startswith(text, F.lit(k)), F.concat(F.lit(prefixes[k]), F.substring(text, F.lit(len(k) + 1), F.length(text)))).otherwise(out)
    return out


def list_score(rows: DataFrame) -> DataFrame:
    """rows: coverage, exact, phrase, base_match, category_match, brand_match (booleans), volume and count (1 same, -1 other, 0 absent), confidence."""
    w = lambda c, x: F.when(F.coalesce(F.col(c), F.lit(False)), x).otherwise(0.0)
    name = F.when(F.col("exact"), 0.12).when(F.col("phrase"), 0.08).otherwise(0.0)
    score = F.col("coverage") * 0.55 + name + w("base_match", 0.15) + w("category_match", 0.08) + w("brand_match", 0.12) + (F.col("volume") + F.col("count")) * 0.18 + F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)) * 0.05
    return rows.withColumn("score", rounded(score, 4))


def list_status(scored: DataFrame, by: str = "query_id", tie: str = "product_id") -> DataFrame:
    """resolved: best at 0.75 or more and well ahead; unresolved: best under 0.45; else ambiguous."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    best = scored.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("k = 1")
    ahead = F.col("next").isNull() | (F.col("next") < LIST_RESOLVED) | (F.col("score") - F.col("next") >= LIST_GAP)
    status = F.when(F.col("score") < LIST_LOW, "unresolved").when((F.col("score") >= LIST_RESOLVED) & ahead, "resolved").otherwise("ambiguous")
    return best.select(by, tie, "score", status.alias("status"))


def families(queries: DataFrame, terms: DataFrame, gap: float = 0.4) -> DataFrame:
    """The family of most matching terms; ambiguous if the next is less than `gap` behind. terms: family, term, weight."""
    hits = queries.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("term")).join(terms, "term")
    g = hits.groupBy("query_id", "family").agg(exact_sum(F.col("weight")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "family")
    best = g.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("k = 1")
    return best.select("query_id", "family", "score", F.when(F.col("score") - F.coalesce("next", F.lit(0.0)) < gap, "ambiguous").otherwise("resolved").alias("status"))


def representative_score(foundation: Column, legacy: Column, macros: Column, raw: Column, segments: Column, salted: Column, sweetened: Column, breaded: Column, unclear: Column) -> tuple[Column, Column]:
    """50, 35, 20, 10 and 8 for what speaks for a food, less 8, 8, 12 and 15; bands at 55 and 75."""
    w = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0)
    score = w(foundation, 50) + w(legacy, 35) + w(macros, 20) + w(raw, 10) + w(segments <= 5, 8) - w(salted, 8) - w(sweetened, 8) - w(breaded, 12) - w(unclear, 15)
    return score, F.when(score >= 75, "high").when(score >= 55, "medium").otherwise("low")


def ingredient_confidence(pairs: DataFrame) -> DataFrame:
    """pairs: exact, alias, contained, category, attribute. 0.96, 0.88 or 0.84, and 0.06 and 0.04 more, at most 0.99."""
    base = F.when(F.col("exact"), 96).when(F.col("alias"), 88).when(F.col("contained"), 84).otherwise(0)
    bonus = F.when(F.col("category"), 6).otherwise(0)
    a = F.when(F.col("category"), F.least(F.lit(99), base + bonus)).otherwise(base)
    b = F.when(F.col("attribute"), F.least(F.lit(99), a + 4)).otherwise(a)
    return pairs.withColumn("confidence", b.cast("double") / 100)


def package_grams(quantity: Column, unit: Column, density: Column, per_piece: Column) -> Column:
    """Grams of a package; null if the unit is unknown or needs a density or a weight that is missing."""
    u = F.lower(F.trim(unit))
    return F.when(u.isin("g", "gram", "grams"), quantity).when(u.isin("kg", "kilogram", "kilograms"), quantity * 1000).when(u.isin("ml", "milliliter", "milliliters"), quantity * density).when(u.isin("l", "liter", "liters"), quantity * 1000 * density).when(u.isin("piece", "pieces", "count", "pc", "pcs"), quantity * per_piece)


def to_purchase(edible: Column, yield_ratio: Column) -> Column:
    """What to buy for an edible quantity: by the yield, rounded up to whole units; nothing for nothing."""
    return F.when(edible <= 0, 0.0).otherwise(F.ceil(edible / F.coalesce(yield_ratio, F.lit(1.0))).cast("double"))


def merge_decisions(pairs: DataFrame, markers: list[str]) -> DataFrame:
    """pairs: a_<marker>, b_<marker>, decision. A merge is vetoed where a marker is on both sides and differs."""
    conflict = F.lit(False)
    for m in markers:
        conflict = conflict | F.coalesce((F.col(f"a_{m}") != F.col(f"b_{m}")), F.lit(False))
    return pairs.withColumn("outcome", F.when(F.col("decision") != "merge", "kept_apart").when(conflict, "vetoed").otherwise("merged"))


def usability(metrics: DataFrame) -> DataFrame:
    """rejected, dormant (< 0.4 matched), needs_ingredient_mapping (< 0.7), needs_nutrition, usable."""
    s = F.when(F.col("total") == 0, "rejected").when(F.col("match_rate") < 0.4, "dormant").when(F.col("match_rate") < 0.7, "needs_ingredient_mapping").when(F.col("with_nutrition") <= 0, "needs_nutrition").otherwise("usable")
    return metrics.withColumn("usability", s)


def pilot_scores(rows: DataFrame) -> DataFrame:
    """12 a query term, 8 a concept, 5 a group term, 8 a group, 10 if the category agrees, 1 if enriched before; 0 if a guardrail excludes it."""
    n = F.col("query_hits") * 12 + F.col("concept_hits") * 8 + F.col("group_hits") * 5 + F.col("groups") * 8
    score = n + F.when(F.col("aligned") & (n > 0), 10).otherwise(0) + F.when(F.col("enriched"), 1).otherwise(0)
    return rows.withColumn("score", F.when(F.col("excluded"), 0).otherwise(score))


def merge_inventory(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items of one identity become one: quantities summed, the remaining share weighted by quantity, the latest expiry."""
    q = F.coalesce("quantity", F.lit(0.0))
    weighted = exact_sum(q * F.col("remaining")) / F.when(exact_sum(q) > 0, exact_sum(q))
    return items.groupBy(*keys).agg(exact_sum(q).alias("quantity"), rounded(F.coalesce(weighted, F.max("remaining")), 4).alias("remaining"), F.max("expires").alias("expires"), F.count("*").alias("merged"))


def last_records(rows: DataFrame, at: str, tie: str, days: int, limit: int) -> DataFrame:
    """The latest records of a window that ends at the last of them; a top-k, not a full sort."""
    end = rows.agg(F.max(at).alias("__end"))
    rows = rows.crossJoin(F.broadcast(end))  # one row
    return rows.filter(F.col(at) >= F.col("__end") - F.expr(f"INTERVAL {days} DAYS")).drop("__end").orderBy(F.desc(at), F.desc(tie)).limit(limit)
