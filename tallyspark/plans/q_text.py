"""Queries over product text: markers, names, matching, search, fuzzy and containment joins, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.money import rounded
from tallyspark.operators import matching as M
from tallyspark.operators import pairs as V
from tallyspark.plans.adapter import read, sql_round
from tallyspark.plans.registry import query

R = sql_round
TYPES = (("ring|bolt", "fastener"), ("gear", "drive"), ("widget|gizmo", "device"))
COLORS = ("red", "blue", "green", "hot", "small")

CATALOG = """catalog AS (
  SELECT p_partkey AS product_id, p_name, lower(replace(p_brand, '#', '')) AS brand,
    p_name || ' (' || p_brand || '), ' || p_size || CASE p_partkey % 4 WHEN 0 THEN ' g' WHEN 1 THEN ' KG' WHEN 2 THEN 'ml' ELSE ' l' END
      || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (p_partkey % 7) || ',5%' ELSE '' END AS raw_name FROM part
)"""


def catalog(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    unit = F.when(k % 4 == 0, " g").when(k % 4 == 1, " KG").when(k % 4 == 2, "ml").otherwise(" l")
    fat = F.when(k % 3 == 0, F.concat(F.lit(" "), k % 7, F.lit(",5%"))).otherwise("")
    return p.select(k.alias("product_id"), "p_name", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("brand"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit("), "), "p_size", unit, fat).alias("raw_name"))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[.,()]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[^\\p{{L}}\\p{{N}}%]+'), lambda t: t <> '')"


@query("normalise_name", f"WITH {CATALOG} SELECT product_id, {_norm('raw_name')} AS name FROM catalog")
def normalise_name(spark, d):
    return catalog(spark, d).select("product_id", X.normalise_name(F.col("raw_name")).alias("name"))


@query("normalise_composed", f"SELECT doc_id, {_norm('text')} AS name FROM documents")
def normalise_composed(spark, d):
    return read(spark, d, "documents").select("doc_id", X.normalise_name(F.col("text"), compose=True).alias("name"))


@query("tokenise", f"WITH {CATALOG} SELECT product_id, array_to_string({_tokens(_norm('raw_name'))}, '|') AS tokens FROM catalog")
def tokenise(spark, d):
    return catalog(spark, d).select("product_id", F.array_join(X.tokens(X.normalise_name(F.col("raw_name"))), "|").alias("tokens"))


@query("split_items", "SELECT event_id, i - 1 AS pos, items[i] AS item FROM (SELECT event_id, list_filter(list_transform(string_split_regex(event_type || ', ' || user_id || chr(10) || ' ;' || event_type, '[\\n,;]'), lambda t: trim(t)), lambda t: t <> '') AS items FROM events), range(1, 4) r(i) WHERE i <= len(items)")
def split_items(spark, d):
    e = read(spark, d, "events")
    items = X.split_items(F.concat("event_type", F.lit(", "), F.col("user_id").cast("string"), F.lit("\n ;"), "event_type"))
    return e.select("event_id", F.posexplode(items).alias("pos", "item"))


SIZED = f"""{CATALOG}, found AS (SELECT *, regexp_extract(raw_name, '(?i)(\\d+(?:[.,]\\d+)?)\\s*(kg|ml|cl|g|l)(?:\\s|$|[.,)])', ['n', 'u']) AS m, regexp_extract(raw_name, '(\\d+(?:[.,]\\d+)?)\\s*%', 1) AS pct FROM catalog),
sized AS (SELECT *, CASE WHEN m.n <> '' THEN replace(m.n, ',', '.')::DOUBLE END AS size_value, CASE WHEN m.n <> '' THEN lower(m.u) END AS size_unit, CASE WHEN pct <> '' THEN replace(pct, ',', '.')::DOUBLE END AS fat_percent FROM found)"""


@query("extract_size", f"WITH {SIZED} SELECT product_id, size_value, size_unit, floor(size_value * CASE size_unit WHEN 'kg' THEN 1000 WHEN 'l' THEN 1000 WHEN 'cl' THEN 10 ELSE 1 END * 1000 + 0.5) / 1000 AS base_quantity FROM sized")
def extract_size(spark, d):
    s = X.size_of(F.col("raw_name"))
    return catalog(spark, d).select("product_id", s["value"].alias("size_value"), s["unit"].alias("size_unit"), X.base_quantity(s).alias("base_quantity"))


@query("extract_percent", f"WITH {SIZED} SELECT product_id, fat_percent FROM sized")
def extract_percent(spark, d):
    return catalog(spark, d).select("product_id", X.percent_of(F.col("raw_name")).alias("fat_percent"))


@query("structured_markers", """WITH m AS (SELECT p_partkey AS product_id, p_size || ' pcs ' || (p_size % 5 + 2) || ' x 330 ml reserve ' || (1990 + p_size % 40) || ' age ' || p_size || '-' || (p_size + 3) AS t, p_size FROM part)
  SELECT product_id, p_size::INTEGER AS count_marker, (p_size % 5 + 2)::BIGINT AS packs, (1990 + p_size % 40)::INTEGER AS year_marker, p_size::INTEGER AS low, (p_size + 3)::INTEGER AS high FROM m""")
def structured_markers(spark, d):
    t = F.concat("p_size", F.lit(" pcs "), F.col("p_size") % 5 + 2, F.lit(" x 330 ml reserve "), F.col("p_size") % 40 + 1990, F.lit(" age "), "p_size", F.lit("-"), F.col("p_size") + 3)
    r = X.range_of(F.col("t"))
    return read(spark, d, "part").withColumn("t", t).select(F.col("p_partkey").alias("product_id"), X.count_of(F.col("t")).alias("count_marker"), X.multipack(F.col("t")).alias("packs"), X.year_of(F.col("t")).alias("year_marker"), r["low"].alias("low"), r["high"].alias("high"))


@query("vocabulary_tags", f"WITH {CATALOG} SELECT product_id, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'blue') THEN 'blue' WHEN contains(p_name, 'green') THEN 'green' WHEN contains(p_name, 'hot') THEN 'hot' WHEN contains(p_name, 'small') THEN 'small' END AS color, CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'fastener' WHEN regexp_matches(p_name, 'gear') THEN 'drive' WHEN regexp_matches(p_name, 'widget|gizmo') THEN 'device' END AS kind FROM catalog")
def vocabulary_tags(spark, d):
    return catalog(spark, d).select("product_id", X.first_word_of(F.col("p_name"), COLORS).alias("color"), X.product_type(F.col("p_name"), TYPES).alias("kind"))


@query("alias_candidates", f"""WITH {SIZED}, n AS (SELECT product_id, {_norm('raw_name')} AS name, replace(brand, 'brand', 'brand#') AS b FROM sized), a AS (SELECT *, trim(regexp_replace(replace(name, b, ' '), '\\s+', ' ', 'g')) AS a1 FROM n)
  SELECT product_id, array_to_string(list_filter([name, CASE WHEN a1 <> name THEN a1 END], lambda t: t IS NOT NULL AND t <> ''), '|') AS aliases FROM a""")
def alias_candidates(spark, d):
    name = X.normalise_name(F.col("raw_name"))
    brand = F.replace("brand", F.lit("brand"), F.lit("brand#"))
    return catalog(spark, d).select("product_id", F.array_join(X.aliases(name, brand, F.lit(None).cast("string"), F.lit(None).cast("string")), "|").alias("aliases"))


@query("parse_confidence", f"WITH {SIZED} SELECT product_id, least(100, 20 + CASE WHEN regexp_matches(p_name, 'ring|bolt|gear|widget|gizmo') THEN 30 ELSE 0 END + CASE WHEN size_value IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN fat_percent IS NOT NULL THEN 10 ELSE 0 END + 20)::DOUBLE / 100 AS confidence FROM sized")
def parse_confidence(spark, d):
    c = X.parse_confidence(X.product_type(F.col("p_name"), TYPES), X.size_of(F.col("raw_name")), X.percent_of(F.col("raw_name")), F.col("brand"))
    return catalog(spark, d).select("product_id", c.alias("confidence"))


DRIFT_PAIRS = f"{CATALOG}, pairs AS (SELECT a.product_id, a.raw_name AS before, CASE WHEN a.product_id % 5 = 0 THEN a.raw_name WHEN a.product_id % 5 = 1 THEN upper(a.raw_name) ELSE b.raw_name END AS after FROM catalog a JOIN catalog b ON b.product_id = a.product_id + 1)"
BARE = lambda x: _norm(f"regexp_replace(regexp_replace(lower({x}), '(\\d+(?:[.,]\\d+)?)\\s*%', ' ', 'g'), '(\\d+(?:[.,]\\d+)?)\\s*(?:kg|ml|g|l)(\\s|$|[.,])', ' \\2', 'g')")


@query("name_drift", f"""WITH {DRIFT_PAIRS}, n AS (SELECT *, {BARE('before')} AS a, {BARE('after')} AS b FROM pairs), t AS (SELECT *, list_distinct({_tokens('a')}) AS x, list_distinct({_tokens('b')}) AS y FROM n)
  SELECT product_id, CASE WHEN before = after THEN 'none' WHEN a = b THEN 'minor' WHEN len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y), 1) >= 0.8 THEN 'minor' ELSE 'major' END AS drift,
    len(list_filter(x, lambda t: NOT list_contains(y, t))) + len(list_filter(y, lambda t: NOT list_contains(x, t))) AS not_shared FROM t""")
def name_drift(spark, d):
    c = catalog(spark, d)
    nxt = c.select((F.col("product_id") - 1).alias("product_id"), F.col("raw_name").alias("other"))
    k = F.col("product_id")
    rows = c.join(nxt, "product_id").withColumn("after", F.when(k % 5 == 0, F.col("raw_name")).when(k % 5 == 1, F.upper("raw_name")).otherwise(F.col("other")))
    a, b = X.tokens(X.bare_name(F.col("raw_name"))), X.tokens(X.bare_name(F.col("after")))
    return rows.select("product_id", X.name_drift(F.col("raw_name"), F.col("after")).alias("drift"), X.not_shared(a, b).cast("long").alias("not_shared"))


NAMED = f"""{CATALOG}, named AS (SELECT product_id, c.p_name || ' 5% ' || upper(brand) || '+, ' || p_size || ' g' AS raw, brand FROM catalog c JOIN part ON p_partkey = product_id)"""


def _named(spark, d):
    """Names with a brand in capitals among percentages and sizes."""
    size = read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_size")
    raw = F.concat("p_name", F.lit(" 5% "), F.upper("brand"), F.lit("+, "), "p_size", F.lit(" g"))
    return catalog(spark, d).join(size, "product_id").select("product_id", raw.alias("raw"), "brand")


@query("brand_guess", f"""WITH {NAMED}, t AS (SELECT product_id, brand, {_tokens(_norm('raw'))} AS tokens FROM named)
  SELECT product_id, CASE WHEN list_contains(tokens, brand) AND brand NOT IN ('brand7', 'brand13') THEN upper(brand) END AS brand_guess FROM t""")
def brand_guess(spark, d):
    skip = F.array(F.lit("brand7"), F.lit("brand13"))
    return _named(spark, d).select("product_id", X.brand_guess(F.col("raw"), X.tokens(X.normalise_name(F.col("raw"))), skip).alias("brand_guess"))


@query("core_tokens", f"""WITH {NAMED}, t AS (SELECT product_id, brand, {_tokens(_norm('raw'))} AS tokens FROM named)
  SELECT product_id, array_to_string(list_sort(list_distinct(list_filter(tokens, lambda t: t <> brand AND NOT regexp_matches(t, '^[0-9]+%?$') AND t <> 'g'))), '|') AS core FROM t""")
def core_tokens(spark, d):
    return _named(spark, d).select("product_id", F.array_join(X.core_tokens(X.tokens(X.normalise_name(F.col("raw"))), F.col("brand")), "|").alias("core"))


@query("vocabulary_evidence", "SELECT p_partkey AS product_id, w AS word, instr(p_name, w)::INTEGER AS at FROM part, (SELECT unnest(['red', 'blue', 'green', 'hot', 'small']) AS w) WHERE contains(p_name, w)")
def vocabulary_evidence(spark, d):
    """All words of the vocabulary that a name holds, with their places."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.explode(X.all_words_of(F.col("p_name"), COLORS)).alias("f")).select("product_id", "f.word", "f.at")


@query("identifier_slug", f"WITH {CATALOG} SELECT product_id, regexp_replace(regexp_replace(lower(trim(raw_name)), '[^a-z0-9À-ɏЀ-ӿ]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM catalog")
def identifier_slug(spark, d):
    return catalog(spark, d).select("product_id", X.slug(F.col("raw_name")).alias("slug"))


@query("identity_hash", "SELECT p_partkey AS product_id, sha256(concat_ws('|', p_name, p_brand, p_type, '', p_size::VARCHAR)) AS id FROM part")
def identity_hash(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), X.hash_of(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None), F.col("p_size")).alias("id"))


@query("canonical_grouping", "SELECT sha256(concat_ws('|', p_name, p_brand, p_type, p_size::VARCHAR)) AS canonical_key, count(*) AS members, min(p_partkey) AS representative FROM part GROUP BY 1")
def canonical_grouping(spark, d):
    """Products of one composite key are one canonical product."""
    key = X.hash_of(*[F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size")])
    return read(spark, d, "part").groupBy(key.alias("canonical_key")).agg(F.count("*").alias("members"), F.min("p_partkey").alias("representative"))


@query("source_validation", f"""WITH {CATALOG}, v AS (SELECT product_id, raw_name, list_filter([CASE WHEN len(raw_name) > 32 THEN 'too_long' END, CASE WHEN product_id % 50 = 0 THEN 'missing_code' END, CASE WHEN NOT regexp_matches(raw_name, '%') THEN 'no_percent' END], lambda t: t IS NOT NULL) AS r FROM catalog)
  SELECT product_id, array_to_string(r, ',') AS reasons, CASE WHEN list_contains(r, 'missing_code') THEN 'invalid' WHEN len(r) > 0 THEN 'suspect' ELSE 'valid' END AS status FROM v""")
def source_validation(spark, d):
    from tallyspark.operators.quality import validate

    return validate(catalog(spark, d), VALIDATION, ("missing_code",)).select("product_id", F.array_join("reasons", ",").alias("reasons"), "status")


VALIDATION = {"too_long": lambda: F.length("raw_name") > 32, "missing_code": lambda: F.col("product_id") % 50 == 0, "no_percent": lambda: ~F.contains("raw_name", F.lit("%"))}


@query("quarantine", f"WITH {CATALOG} SELECT product_id FROM catalog WHERE product_id % 50 <> 0")
def quarantine(spark, d):
    from tallyspark.operators.quality import runtime_safe, validate

    return runtime_safe(validate(catalog(spark, d), VALIDATION, ("missing_code",))).select("product_id")


@query("bad_product_audit", """SELECT CASE WHEN p_partkey % 50 = 0 THEN 'invalid' ELSE 'valid' END AS status, count(DISTINCT p_partkey) AS products, count(l_partkey) AS dependent_rows FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def bad_product_audit(spark, d):
    from tallyspark.operators.quality import audit

    marked = read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 50 == 0, "invalid").otherwise("valid").alias("status"))
    return audit(marked, read(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id")))


# --- matching -----------------------------------------------------------------------------------------------------------
PARSED = f"""{SIZED}, products AS (SELECT product_id, {_norm('raw_name')} AS name, list_distinct({_tokens(_norm('raw_name'))}) AS tokens, p_name AS alias, brand, size_value, size_unit, fat_percent FROM sized),
asked AS (SELECT product_id AS query_id, CASE WHEN product_id // 50 % 2 = 0 THEN name ELSE alias END AS q_name, CASE WHEN product_id // 50 % 3 = 0 THEN size_value END AS q_size, CASE WHEN product_id // 50 % 3 = 0 THEN fat_percent END AS q_percent FROM products WHERE product_id % 50 = 0
  UNION ALL SELECT 900000001, 'nothing like it', NULL, NULL),
queries AS (SELECT *, list_distinct({_tokens('q_name')}) AS q_tokens FROM asked),
shared AS (SELECT query_id, product_id, count(*) AS shared FROM (SELECT query_id, unnest(q_tokens) AS token FROM queries) JOIN (SELECT product_id, unnest(tokens) AS token FROM products) USING (token) GROUP BY ALL),
pairs AS (SELECT * FROM shared JOIN queries USING (query_id) JOIN products USING (product_id)),
scored AS (SELECT query_id, product_id, shared, name, brand, {R("CASE WHEN q_name = name THEN 0.45::DOUBLE WHEN q_name = alias THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(list_filter(string_split(q_name, ' '), lambda t: len(t) >= 5 AND (t = alias OR contains(name, t)))) > 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + shared::DOUBLE / greatest(len(q_tokens), 1) * 0.35::DOUBLE + CASE WHEN list_contains(q_tokens, brand) THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q_size = size_value THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q_percent = fat_percent THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END + 0.7::DOUBLE * 0.05::DOUBLE", 4)} AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM scored)"""


def _parsed(spark, d, step=50):
    """Queries and products. step: the queries are the products whose identifier it divides."""
    c = catalog(spark, d)
    name = X.normalise_name(F.col("raw_name"))
    s = X.size_of(F.col("raw_name"))
    products = c.select("product_id", name.alias("name"), F.array("p_name").alias("aliases"), "brand", s["value"].alias("size"), X.percent_of(F.col("raw_name")).alias("percent"), F.lit(0.7).alias("confidence"))
    products = products.withColumn("tokens", F.array_distinct(X.tokens(F.col("name"))))
    k = F.floor(F.col("product_id") / 50)
    asked = products.filter(F.col("product_id") % step == 0).select(F.col("product_id").alias("query_id"), F.when(k % 2 == 0, F.col("name")).otherwise(F.col("aliases")[0]).alias("q_name"), F.when(k % 3 == 0, F.col("size")).alias("q_size"), F.when(k % 3 == 0, F.col("percent")).alias("q_percent"))
    none = spark.sql("SELECT 900000001L AS query_id, 'nothing like it' AS q_name, CAST(NULL AS DOUBLE) AS q_size, CAST(NULL AS DOUBLE) AS q_percent")
    queries = asked.unionByName(none).withColumn("q_tokens", F.array_distinct(X.tokens(F.col("q_name"))))
    return queries, products


def _asked(queries):
    """The words of the asked name are its canonical terms."""
    return queries.withColumn("canonical_terms", F.filter(F.split("q_name", " "), lambda t: F.length(t) >= 5))


def _scored(spark, d, step=50, top=None):
    """Queries, and their pairs with score and shared. top: of each query's pairs at least the best, not many more."""
    queries, products = _parsed(spark, d, step)
    return queries, V.pairs(_asked(queries), products, top=top), products


@query("token_candidates", f"WITH {PARSED} SELECT * FROM shared")
def token_candidates(spark, d):
    return V.pairs(*_parsed(spark, d), scored=False)


@query("match_scores", f"WITH {PARSED} SELECT query_id, product_id, score FROM scored")
def match_scores(spark, d):
    return _scored(spark, d)[1].select("query_id", "product_id", "score")


@query("top_n_candidates", f"WITH {PARSED} SELECT query_id, product_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5")
def top_n_candidates(spark, d):
    return M.top_n(_scored(spark, d, top=5)[1], 5).select("query_id", "product_id", "score", "rank")


@query("ambiguity_status", f"""WITH {PARSED}, b AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second, max(product_id) FILTER (rank = 1) AS product_id FROM ranked GROUP BY 1)
  SELECT query_id, CASE WHEN top IS NULL THEN 'unmatched' WHEN low OR close THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN top IS NULL THEN 'no_candidates' WHEN low THEN 'low_confidence' WHEN close THEN 'close_scores' END AS reason, product_id, top
  FROM (SELECT *, CASE WHEN second IS NULL THEN top < 0.3 ELSE top < 0.55 END AS low, second IS NOT NULL AND top - second <= 0.15 AS close FROM queries LEFT JOIN b USING (query_id))""")
def ambiguity_status(spark, d):
    queries, scored, _ = _scored(spark, d, top=2)
    return M.ambiguity(queries, scored)


@query("semantic_rerank", f"""WITH {PARSED}, r AS (SELECT query_id, product_id, {R("score + 0.18::DOUBLE * shared::DOUBLE / 10 + CASE WHEN brand = 'brand2' THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END", 4)} AS score FROM ranked WHERE rank <= 5),
  s AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM r WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, product_id))
  SELECT query_id, product_id, score, CASE WHEN coalesce(score - next, 1.0) > 0.12 AND score >= 0.58 THEN 'resolved' ELSE 'ambiguous' END AS status FROM s WHERE k = 1""")
def semantic_rerank(spark, d):
    boost = F.lit(0.18) * F.col("shared") / 10 + F.when(F.col("brand") == "brand2", 0.22).otherwise(0.0)
    _, scored, products = _scored(spark, d, top=5)
    return M.rerank(M.top_n(scored, 5).drop("rank").join(products.select("product_id", "brand"), "product_id"), boost)


@query("rerank_budget", f"""WITH {PARSED}, b AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM ranked GROUP BY 1),
  waiting AS (SELECT query_id, row_number() OVER (ORDER BY q_name DESC, query_id) <= 8 AS used_call FROM queries LEFT JOIN b USING (query_id) WHERE top IS NULL OR CASE WHEN second IS NULL THEN top < 0.3 ELSE top < 0.55 END OR (second IS NOT NULL AND top - second <= 0.15)),
  r AS (SELECT query_id, used_call, product_id, CASE WHEN used_call THEN {R("score + 0.18::DOUBLE * shared::DOUBLE / greatest(len(list_distinct(q_tokens)), 1)", 4)} ELSE score END AS score FROM waiting JOIN ranked USING (query_id) JOIN queries USING (query_id) WHERE rank <= 5),
  s AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM r WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, product_id))
  SELECT w.query_id, w.used_call, CASE WHEN NOT w.used_call THEN 'budget_exhausted' WHEN coalesce(score - next, 1.0) > 0.12 AND score >= 0.58 THEN 'resolved' ELSE 'ambiguous' END AS status, product_id, score FROM waiting w LEFT JOIN (SELECT * FROM s WHERE k = 1) s USING (query_id)""")
def rerank_budget(spark, d):
    """Eight calls for the ambiguous queries, from the last of their names on: the rest stay as they were matched."""
    from tallyspark.operators import ranking as G

    queries, found, _ = _scored(spark, d, top=5)
    scored = M.top_n(found, 5).drop("rank").join(queries.select("query_id", "q_tokens"), "query_id")
    waiting = M.ambiguity(queries, scored).filter("status != 'matched'").select("query_id").join(queries.select("query_id", "q_name"), "query_id")
    cover = F.lit(0.18) * F.col("shared") / F.greatest(F.size(F.array_distinct("q_tokens")), F.lit(1))
    return G.rerank_within(scored, waiting, cover, 8, [F.desc("q_name"), "query_id"])


@query("soft_candidate_filter", f"""WITH {PARSED}, f1 AS (SELECT *, bool_or(brand = 'brand2') OVER (PARTITION BY query_id) AS a FROM scored), g1 AS (SELECT * FROM f1 WHERE brand = 'brand2' OR NOT a),
  f2 AS (SELECT *, bool_or(shared >= 4) OVER (PARTITION BY query_id) AS b FROM g1) SELECT query_id, product_id FROM f2 WHERE shared >= 4 OR NOT b""")
def soft_candidate_filter(spark, d):
    queries, products = _parsed(spark, d)
    return V.soft_filtered(queries, products.withColumn("flag", F.col("brand") == "brand2"), 4)


@query("constraint_filters", f"WITH {SIZED} SELECT product_id FROM sized WHERE size_value <= 20 AND contains(lower(brand), 'd1')")
def constraint_filters(spark, d):
    from tallyspark.operators.quality import constrained

    c = catalog(spark, d).withColumn("size", X.size_of(F.col("raw_name"))["value"])
    return constrained(c, at_most={"size": 20.0}, contains={"brand": "D1"}, equals={"p_name": None}).select("product_id")


@query("query_ranking", f"""WITH {PARSED}, p AS (SELECT query_id, product_id, score, p_retailprice AS price FROM scored JOIN part ON p_partkey = product_id), m AS (SELECT *, min(price) OVER (PARTITION BY query_id) AS least FROM p)
  SELECT query_id, product_id, {R("score + 0.3::DOUBLE * (least / price) + 0.2::DOUBLE", 4)} AS final FROM m""")
def query_ranking(spark, d):
    price = read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    queries, products = _parsed(spark, d)
    products = products.join(price, "product_id")
    # a query's least price from its tokens' least prices: no pair is made for it
    asked = _asked(queries).join(V.least_of(queries, products, "price"), "query_id", "left")
    rows = V.pairs(asked, products, carry=("least", "price"))
    return rows.select("query_id", "product_id", rounded(F.col("score") + 0.3 * (F.col("least") / F.col("price")) + 0.2, 4).alias("final"))


@query("catalog_search", """WITH s AS (SELECT p_partkey AS product_id, greatest(CASE WHEN contains(p_name, 'blue gear') THEN 30.0 ELSE 0 END + CASE WHEN contains(p_name, 'blue') AND contains(p_name, 'gear') THEN 18.0 ELSE 0 END + (contains(p_name, 'blue')::INT + contains(p_name, 'gear')::INT) * 5.0 + (contains(p_name, 'ring')::INT + contains(p_name, 'hot')::INT) * 1.6, 0)::DOUBLE AS search_score FROM part)
  SELECT * FROM s WHERE search_score > 0 ORDER BY search_score DESC, product_id LIMIT 25 OFFSET 10""")
def catalog_search(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("text"))
    return M.page(M.search_score(p, "blue gear", ["blue", "gear"], ["ring", "hot"]).drop("text"), 25, 10, F.desc("search_score"), "product_id")


FIELDS = {"p_name": 1.4, "p_type": 1.1, "p_brand": 0.8}


def _field(c: str, w: float) -> str:
    x = f"lower({c})"
    return f"{w}::DOUBLE * (CASE WHEN contains({x}, 'blue gear') THEN 3.0 ELSE 0.0 END + contains({x}, 'blue')::INT + contains({x}, 'gear')::INT + 0.6::DOUBLE * (contains({x}, 'small ring')::INT + contains({x}, 'hot')::INT))"


@query("weighted_search", f"""WITH h AS (SELECT *, lower(p_name || ' ' || p_type || ' ' || p_brand) AS x FROM part),
  s AS (SELECT p_partkey AS product_id, {R("greatest(CASE WHEN contains(x, 'blue gear') THEN 30.0::DOUBLE ELSE 0.0 END + CASE WHEN contains(x, 'blue') AND contains(x, 'gear') THEN 18.0::DOUBLE ELSE 0.0 END + (contains(x, 'blue')::INT + contains(x, 'gear')::INT) * 5.0::DOUBLE + (contains(x, 'small')::INT + contains(x, 'ring')::INT + contains(x, 'hot')::INT) * 1.6::DOUBLE + contains(x, 'small ring')::INT * 4.0::DOUBLE + " + " + ".join(_field(c, w) for c, w in FIELDS.items()) + " + CASE WHEN p_type = 'ECONOMY' THEN 10.0::DOUBLE WHEN p_type = 'PROMO' THEN -15.0::DOUBLE ELSE 0.0 END, 0.0)", 3)} AS search_score FROM h)
  SELECT * FROM s WHERE search_score > 0""")
def weighted_search(spark, d):
    """Fields of unlike weight, related terms, and guardrails by product type."""
    guard = F.when(F.col("p_type") == "ECONOMY", 10.0).when(F.col("p_type") == "PROMO", -15.0)
    found = M.weighted_search(read(spark, d, "part"), FIELDS, "blue gear", ["blue", "gear"], ["small ring", "hot"], [guard])
    return found.select(F.col("p_partkey").alias("product_id"), "search_score")


@query("text_search", "SELECT doc_id FROM documents WHERE text ILIKE '%tion%' AND (lang ILIKE '%E%' OR source ILIKE '%src1%')")
def text_search(spark, d):
    return read(spark, d, "documents").filter(F.col("text").ilike("%tion%") & (F.col("lang").ilike("%E%") | F.col("source").ilike("%src1%"))).select("doc_id")


TERMS = "terms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), tokens AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN substr(t, 2) WHEN 1 THEN t || 'x' ELSE replace(t, 'e', 'a') END AS token FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part))"


@query("fuzzy_join", f"""WITH {TERMS}, near AS (SELECT token, term, levenshtein(token, term) AS distance FROM tokens, terms WHERE levenshtein(token, term) <= CASE WHEN len(term) >= 5 THEN 2 ELSE 1 END),
  k AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS next FROM near WINDOW w AS (PARTITION BY token ORDER BY distance, term)) SELECT token, term, distance::INTEGER AS distance FROM k WHERE r = 1 AND (next IS NULL OR next > distance)""")
def fuzzy_join(spark, d):
    words = read(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("t"))
    token = F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(t, 2)")).when(F.col("p_partkey") % 3 == 1, F.concat("t", F.lit("x"))).otherwise(F.replace("t", F.lit("e"), F.lit("a")))
    return M.fuzzy_join(words.select(token.alias("token")).distinct(), words.select(F.col("t").alias("term")).distinct())


@query("synonym_learning", f"""WITH {TERMS}, seen AS (SELECT token, count(*) AS frequency FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN substr(t, 2) WHEN 1 THEN t || 'x' ELSE replace(t, 'e', 'a') END AS token FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part)) GROUP BY 1 HAVING count(*) >= 2),
  near AS (SELECT token, term, levenshtein(token, term) AS distance FROM seen, terms WHERE token NOT IN (SELECT term FROM terms) AND levenshtein(token, term) <= CASE WHEN len(term) >= 5 THEN 2 ELSE 1 END),
  k AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS next FROM near WINDOW w AS (PARTITION BY token ORDER BY distance, term)) SELECT token, term, frequency FROM k JOIN seen USING (token) WHERE r = 1 AND (next IS NULL OR next > distance)""")
def synonym_learning(spark, d):
    """Words asked for twice or more that aren't terms yet, with their one nearest term."""
    words = read(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("t"))
    token = F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(t, 2)")).when(F.col("p_partkey") % 3 == 1, F.concat("t", F.lit("x"))).otherwise(F.replace("t", F.lit("e"), F.lit("a")))
    terms = words.select(F.col("t").alias("term")).distinct()
    seen = words.groupBy(token.alias("token")).agg(F.count("*").alias("frequency")).filter("frequency >= 2")
    fresh = seen.join(terms, seen["token"] == terms["term"], "left_anti")
    return M.fuzzy_join(fresh.select("token"), terms).join(seen, "token").select("token", "term", "frequency")


@query("containment_join", """WITH l AS (SELECT p_partkey AS left_id, p_name AS name FROM part), r AS (SELECT row_number() OVER (ORDER BY w) AS right_id, w AS name, 'small ' || w AS alias FROM (SELECT DISTINCT string_split(p_name, ' ')[2] AS w FROM part)),
  t AS (SELECT right_id, name AS right_name, name AS term FROM r UNION ALL SELECT right_id, name, alias FROM r)
  SELECT left_id, right_id::INTEGER AS right_id, max(CASE WHEN name = right_name THEN 0.95 WHEN name = term THEN 0.90 ELSE 0.72 END)::DOUBLE AS confidence FROM l JOIN t ON contains(' ' || name || ' ', ' ' || term || ' ') GROUP BY ALL""")
def containment_join(spark, d):
    from pyspark.sql import Window

    p = read(spark, d, "part")
    right = p.select(F.split("p_name", " ")[1].alias("name")).distinct().withColumn("right_id", F.row_number().over(Window.orderBy("name"))).withColumn("aliases", F.array(F.concat(F.lit("small "), "name")))
    return M.contains_join(p.select(F.col("p_partkey").alias("left_id"), F.col("p_name").alias("name")), right)


@query("registry_round_robin", """WITH r AS (SELECT p_type AS domain, p_partkey AS term, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part) SELECT domain, term, rn::INTEGER AS rn FROM r WHERE rn <= 5 ORDER BY rn, domain LIMIT 20""")
def registry_round_robin(spark, d):
    return M.round_robin(read(spark, d, "part").select(F.col("p_type").alias("domain"), F.col("p_partkey").alias("term")), "domain", "term", 5, 20)


@query("cosine_similarity", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b, 0.0)) AS m FROM v)
  SELECT a.vec_id, floor((list_reduce(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]), lambda x, y: x + y, 0.0) / (a.m * b.m)) * 1000000 + 0.5) / 1000000 AS similarity FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(nxt, "vec_id").select("vec_id", rounded(M.cosine(F.col("e"), F.col("f")), 6).alias("similarity"))


@query("hash_embedding", """WITH h AS (SELECT p_partkey AS product_id, sha256(p_name) AS h FROM part) SELECT product_id, i AS dim, floor((('0x' || substr(h, 8 * i + 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE * 2 - 1) * 1000000 + 0.5) / 1000000 AS x FROM h, (SELECT range::INTEGER AS i FROM range(8))""")
def hash_embedding(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.posexplode(M.hash_embedding(F.col("p_name"))).alias("dim", "x"))


@query("demand_clusters")
def demand_clusters(spark, d):
    """Greedy: each item joins the most similar head before it. Stated by a plain loop in the tests instead of SQL; run in parallel."""
    from tallyspark.operators.clusters import greedy
    from tallyspark.operators.demand import demand_aggregates
    from tallyspark.plans.adapter import signals

    items = demand_aggregates(signals(spark, d)).select("locality_code", "normalized_query", "frequency", M.hash_embedding(F.col("normalized_query")).alias("vector"))
    found = greedy(items, 0.3, "locality_code", "normalized_query", "frequency", "vector")
    return found.select(F.col("grp").alias("locality_code"), F.col("name").alias("normalized_query"), F.col("head").alias("representative"))


@query("trigram_search", """WITH q AS (SELECT item_id AS query_id, lower(array_to_string(string_split(text, ' ')[2:3], ' ')) AS phrase FROM benchmark UNION ALL SELECT 900000001, 'e,' UNION ALL SELECT 900000002, 'nowhere at all')
  SELECT query_id, doc_id FROM q JOIN documents ON contains(lower(text), phrase) OR contains(lower(source), phrase)""")
def trigram_search(spark, d):
    """Two words of each benchmark text, and a phrase too short for trigrams, in the texts and sources of all documents, by an index written once."""
    from tallyspark.sources.tables import work_dir
    from tallyspark.sources.trigrams import TrigramIndex

    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    index = TrigramIndex(spark, work_dir(spark), "doc_id", ["text", "source"])
    index.build(docs)
    two = F.array_join(F.slice(F.split("text", " "), 2, 2), " ")
    more = spark.createDataFrame([(900000001, "E,"), (900000002, "nowhere at all")], "query_id long, phrase string")
    return index.search(docs, read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), two.alias("phrase")).unionByName(more))


@query("merge_components", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - p_partkey % 8 + p_size % 8 AS b FROM part), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON r.other = x.a) SELECT node, min(other) AS root FROM reach GROUP BY 1""")
def merge_components(spark, d):
    """Each part is tied to one of its neighbours by its size."""
    k = F.col("p_partkey")
    return M.connected(read(spark, d, "part").select(k.alias("a"), (k - k % 8 + F.col("p_size") % 8).alias("b")))


@query("paren_aware_split")
def paren_aware_split(spark, d):
    from tallyspark.functions.descriptions import segments

    return catalog(spark, d).select("product_id", F.posexplode(segments(F.concat("raw_name", F.lit(", cooked (no fat, no salt), whole")))).alias("pos", "part"))


@query("normalise_search", "SELECT page_id, trim(regexp_replace(regexp_replace(lower(url || ' [' || page_id || '] {x}!'), '[.,!?()\\[\\]{}:/\"''`]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages WHERE url IS NOT NULL")
def normalise_search(spark, d):
    text = F.concat("url", F.lit(" ["), "page_id", F.lit("] {x}!"))
    return read(spark, d, "pages").filter("url is not null").select("page_id", X.normalise_search(text).alias("text"))


@query("alias_search", "SELECT p_partkey AS product_id FROM part WHERE p_name ILIKE '%RING%' OR len(list_filter([p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END], lambda a: a ILIKE '%d#1%' OR a ILIKE 'econ%')) > 0")
def alias_search(spark, d):
    """A name, or some alias of a list, by patterns that ignore case."""
    aliases = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    some = F.exists(aliases, lambda a: F.coalesce(F.ilike(a, F.lit("%d#1%")) | F.ilike(a, F.lit("econ%")), F.lit(False)))
    return read(spark, d, "part").filter(F.ilike("p_name", F.lit("%RING%")) | some).select(F.col("p_partkey").alias("product_id"))
