"""Matching queries to products: candidates by shared tokens, soft filters, scores, ambiguity, search, fuzzy and theta joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import rounded
from tallyspark.functions.text import collapse
from tallyspark.sources.tables import shared_folder

EXACT, ALIAS, TERM, COVERAGE, BRAND, SIZE, FAT, CONFIDENCE = 0.45, 0.12, 0.08, 0.35, 0.14, 0.12, 0.10, 0.05
#: Catalogue search: what the whole phrase, all its words, a word, a related word and a related phrase bring; in a field, the phrase and a related term as multiples of its weight.
PHRASE, ALL_WORDS, WORD, RELATED_WORD, RELATED_PHRASE, FIELD_PHRASE, FIELD_RELATED = 30.0, 18.0, 5.0, 1.6, 4.0, 3.0, 0.6


def candidates(queries: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs of query and product that share a token, with how many. An inverted-index join: never all pairs.

    queries: query_id, tokens. products: product_id, tokens.
    """
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    p = products.select("product_id", F.explode(F.array_distinct("tokens")).alias("token"))
    return q.join(p, "token").groupBy("query_id", "product_id").agg(F.count("*").alias("shared"))


def soft_filter(rows: DataFrame, tests: list[Column], by: str = "query_id") -> DataFrame:
    """Apply each test in turn, but only to queries of which it leaves a row."""
    for test in tests:
        ok = F.coalesce(test, F.lit(False))
        rows = rows.withColumn("__ok", ok).withColumn("__any", F.max("__ok").over(Window.partitionBy(by))).filter(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")
    return rows


def match_score(rows: DataFrame) -> DataFrame:
    """rows: a query's and a product's columns side by side (q_name, q_tokens, q_brand, q_size, q_percent; name, aliases, brand, size, percent, confidence, shared).

    canonical_terms, if it is there: terms of the query, one of which is an alias or in the name.
    """
    exact = F.when(F.col("q_name") == F.col("name"), EXACT).when(F.array_contains("aliases", F.col("q_name")), ALIAS).otherwise(0.0)
    same = lambda a, b, w: F.when(F.col(a) == F.col(b), w).otherwise(0.0)
    cover = F.col("shared") / F.greatest(F.size(F.array_distinct("q_tokens")), F.lit(1)) * COVERAGE
    brand = F.when(F.array_contains("q_tokens", F.col("brand")), BRAND).otherwise(0.0)
    term = F.lit(0.0)
    if "canonical_terms" in rows.columns:
        term = F.when(F.exists("canonical_terms", lambda t: F.array_contains("aliases", t) | F.contains("name", t)), TERM).otherwise(0.0)
    score = exact + term + cover + brand + same("q_size", "size", SIZE) + same("q_percent", "percent", FAT) + F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)) * CONFIDENCE
    return rows.withColumn("score", rounded(score, 4))


def top_n(rows: DataFrame, n: int, by: str = "query_id", score: str = "score", tie: str = "product_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def ambiguity(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """Status of each query from its two best scores: unmatched, ambiguous (low or close) or matched."""
    best = top_n(scored, 2).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("product_id"))).alias("product_id"))
    rows = queries.select("query_id").join(best, "query_id", "left")
    low = F.when(F.col("second").isNull(), F.col("top") < 0.3).otherwise(F.col("top") < 0.55)
    close = F.col("second").isNotNull() & (F.col("top") - F.col("second") <= 0.15)
    reason = F.when(F.col("top").isNull(), "no_candidates").when(low, "low_confidence").when(close, "close_scores")
    status = F.when(F.col("top").isNull(), "unmatched").when(reason.isNotNull(), "ambiguous").otherwise("matched")
    return rows.select("query_id", status.alias("status"), reason.alias("reason"), "product_id", "top")


def rerank(scored: DataFrame, boost: Column, least_gap: float = 0.12, least_score: float = 0.58) -> DataFrame:
    """Add a boost to the best few and resolve if the first is then well ahead and good enough."""
    rows = top_n(scored, 5).drop("rank").withColumn("score", rounded(F.col("score") + boost, 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "product_id")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("rank = 1")
    ok = (F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)) > least_gap) & (F.col("score") >= least_score)
    return rows.select("query_id", "product_id", "score", F.when(ok, "resolved").otherwise("ambiguous").alias("status"))


def fuzzy_join(tokens: DataFrame, terms: DataFrame, short: int = 1, long: int = 2) -> DataFrame:
    """The one nearest term of each token within edit distance 1, or 2 for terms of five letters and more; none if the nearest two tie.

    Blocked: strings within distance k share a fragment when both are cut into deletion variants; here each string's variants with
    up to k letters left out are keys of an equi-join, so no token meets all terms.
    """
    drop1 = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    variants = lambda x: F.array_distinct(F.concat(F.array(x), drop1(x), F.flatten(F.transform(drop1(x), drop1))))
    a = tokens.select("token", F.explode(variants(F.col("token"))).alias("__key"))
    b = terms.select("term", F.explode(variants(F.col("term"))).alias("__key"))
    pairs = a.join(b, "__key").select("token", "term").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("token", "term")).filter(F.col("distance") <= F.when(F.length("term") >= 5, long).otherwise(short))
    w = Window.partitionBy("token").orderBy("distance", "term")
    best = pairs.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("distance").over(w)).filter("rank = 1")
    return best.filter(F.col("next").isNull() | (F.col("next") > F.col("distance"))).select("token", "term", "distance")


def contains_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Theta join by containment: exact 0.95, an alias equal 0.90, one name's words inside the other 0.72; the best per pair.

    left: left_id, name, and state, if it is there: then only names of a known state match by part. right: right_id, name, aliases. Equal words route the pairs; contains is tested on those only.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    terms = right.select("right_id", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("term"), F.col("name").alias("right_name"))
    a = left.select("left_id", "name", *[c for c in left.columns if c == "state"], F.explode(F.array_distinct(words(F.col("name")))).alias("__w"))
    b = terms.withColumn("__w", F.element_at(words(F.col("term")), 1))
    pairs = a.join(b, "__w").filter(F.contains(F.concat(F.lit(" "), F.col("name"), F.lit(" ")), F.concat(F.lit(" "), F.col("term"), F.lit(" "))))
    score = F.when(F.col("name") == F.col("right_name"), 0.95).when(F.col("name") == F.col("term"), 0.90).otherwise(0.72)
    if "state" in left.columns:
        score = F.when((score > 0.72) | F.col("state").isNotNull(), score)
        pairs = pairs.filter(score.isNotNull())
    return pairs.groupBy("left_id", "right_id").agg(F.max(score).alias("confidence"))


def search_score(products: DataFrame, phrase: str, words: list[str], expanded: list[str]) -> DataFrame:
    """Catalogue search: 30 for the phrase, 18 for all words, 5 a word, 1.6 an expanded word; none below 0; only products with a score stay."""
    has = lambda t: F.when(F.contains("text", F.lit(t)), 1).otherwise(0)
    n = sum((has(w) for w in words), F.lit(0))
    m = sum((has(w) for w in expanded), F.lit(0))
    score = F.when(F.contains("text", F.lit(phrase)), 30.0).otherwise(0.0) + F.when(n == len(words), 18.0).otherwise(0.0) + n * 5.0 + m * 1.6
    return products.withColumn("search_score", rounded(F.greatest(score, F.lit(0.0)), 4)).filter("search_score > 0")


def weighted_search(products: DataFrame, fields: dict[str, float], phrase: str, words: list[str], related: list[str] = (), adjustments: list[Column] = ()) -> DataFrame:
    """Catalogue search over several fields, each of its own weight: products with search_score above 0.

    Over all fields side by side: the phrase, all words, each word, each word of related terms, each related phrase. In each field by its weight: the phrase,
    each word, each related term. Then the adjustments: guardrails that raise or lower products of some kinds. Nulls are empty fields; no score is below 0; to three
    places. Without words every product scores 1. All of it is expressions over a row, so the search is one scan.
    """
    if not words:
        return products.withColumn("search_score", F.lit(1.0))
    text = {c: collapse(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in fields}
    whole = F.concat_ws(" ", *text.values())
    hits = lambda x, terms: sum((F.contains(x, F.lit(t)).cast("int") for t in terms), F.lit(0))
    more = list(dict.fromkeys(w for t in related for w in t.split() if w not in words))
    n = hits(whole, words)
    score = F.when(F.contains(whole, F.lit(phrase)), PHRASE).otherwise(0.0) + F.when(n == len(words), ALL_WORDS).otherwise(0.0)
    score = score + n * WORD + hits(whole, more) * RELATED_WORD + hits(whole, [t for t in related if " " in t]) * RELATED_PHRASE
    for c, weight in fields.items():
        own = F.when(F.contains(text[c], F.lit(phrase)), FIELD_PHRASE).otherwise(0.0) + hits(text[c], words) + FIELD_RELATED * hits(text[c], [t for t in related if t != phrase])
        score = score + weight * own
    for a in adjustments:
        score = score + F.coalesce(a, F.lit(0.0))
    return products.withColumn("search_score", rounded(F.greatest(score, F.lit(0.0)), 3)).filter("search_score > 0")


def page(rows: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def round_robin(rows: DataFrame, domain: str, order: str, per_domain: int, total: int) -> DataFrame:
    """The first few of each domain, dealt out in turn until `total`."""
    w = Window.partitionBy(domain).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_domain).orderBy("rn", domain).limit(total)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if either is all zero."""
    plus = lambda x, y: x + y
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), plus)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), plus))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def hash_embedding(x: Column, dims: int = 8) -> Column:
    """Numbers in [-1, 1] from the digits of a SHA-256, to six places."""
    h = F.sha2(x, 256)
    at = lambda i: F.floor((F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1) * 1e6 + 0.5) / 1e6
    return F.array(*[at(i).cast("double") for i in range(dims)])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; one is set here only where the session has none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component), by min labels and pointer jumping; a round's labels are checkpointed to the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        step = step.join(jump, F.col("next") == F.col("n2"), "left").select("node", F.least("next", F.coalesce("r2", "next")).alias("root"), "was")
        step = checkpointed(step)
        changed = step.filter("root != was").limit(1).count()
        labels = step.select("node", "root")
        if not changed:
            return labels
