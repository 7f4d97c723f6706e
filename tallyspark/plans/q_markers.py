"""Queries over markers of names, the key of canonical products, their backfill, and vocabularies found by a token trie."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import markers as K
from tallyspark.functions import text as X
from tallyspark.plans.adapter import read
from tallyspark.plans.registry import query

#: Names by p_partkey % 14, with {s} for p_size and {d} for 1 to 4, and what their rules and guards must give, as SQL over the part table.
S, D = "p_size", "(1 + p_size % 4)"
NAMES = (
    ("APTAMIL Formula stage {d}, {s}00 g over 24 months", {"stage": f"'stage_' || {D}", "age_band": "'24+m'", "year": f"CASE WHEN {S} IN (19, 20) THEN {S} || '00' END", "volume": f"{S} || '00g'"}, "aptamil|formula|over|stage"),
    ("Nan 2 No 3 {s} pcs", {"stage": "'stage_3'", "count": f"{S}::VARCHAR", "pack": f"'count_' || {S}"}, "nan|no"),
    ("Plain yoghurt 3 stage 2", {}, "plain|stage|yoghurt"),
    ("Puree (kids) 4-6 {s} pcs.", {"count": f"{S}::VARCHAR", "age_band": "'4-6y'", "pack": f"'count_' || {S}"}, "kids|puree"),
    ("Puree 4-6 box {s}", {}, "box|puree"),
    ("Baby snack 8+ {s} g", {"age_band": "'8+m'", "volume": f"{S} || 'g'"}, "baby|snack"),
    ("Whisky aged 12 years 0,70", {"age_statement": "'12y'", "reserve": "'12'", "volume": "'700ml'"}, "whisky"),
    ("Wine 2015 reserve 05 0.75 l", {"reserve": "'5'", "year": "'2015'", "volume": "'750ml'"}, "wine"),
    ("Water 6 x {s}3 ml", {"count": f"{S} || '3'", "volume": f"{S} || '3ml'", "pack": f"'count_' || {S} || '3'"}, "water|x"),
    ("Screws 10-20 kg", {"volume": "'20000g'", "range": "'10-20kg'"}, "screws"),
    ("Candy pack of {s} strawberry", {"count": f"{S}::VARCHAR", "flavor": "'strawberry'", "pack": f"'count_' || {S}"}, "candy|of|strawberry"),
    ("Toothpaste MINT over 3 years, 1900-2000", {"age_band": "'3+y'", "year": "'1900'", "flavor": "'mint'", "range": "'1900-2000'"}, "mint|over|toothpaste"),
    ("Rum {s} годишен 1.5 литра", {"age_statement": f"{S} || 'y'", "reserve": f"{S}::VARCHAR", "volume": "'1500ml'"}, "rum|годишен"),
    ("Cloth 7 red and blue 0,70", {"color": "'blue'"}, "and|blue|cloth|red"),
)
COLUMNS = ("stage", "count", "age_band", "age_statement", "reserve", "year", "volume", "flavor", "color", "pack", "range")


def _case(values: list[str]) -> str:
    return "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


EXPECTED = ", ".join(f"{_case([found.get(c, 'NULL') for _, found, _ in NAMES])} AS {c}_marker" for c in COLUMNS)


def named(spark, d):
    """Products with names that show markers."""
    k, out = F.col("p_partkey"), F.lit("")
    for i, (name, _, _) in enumerate(NAMES):
        parts = name.replace("{s}", "\0s\0").replace("{d}", "\0d\0").split("\0")
        text = F.concat(*[F.col("p_size").cast("string") if p == "s" else (1 + F.col("p_size") % 4).cast("string") if p == "d" else F.lit(p) for p in parts])
        out = F.when(k % len(NAMES) == i, text).otherwise(out)
    return read(spark, d, "part").select(k.alias("product_id"), out.alias("raw_name"), "p_brand", "p_type", "p_size")


@query("name_markers", f"SELECT p_partkey AS product_id, {EXPECTED} FROM part")
def name_markers(spark, d):
    """All markers of every name: orders of rules (an explicit stage before a bare number), guards (no stage without a formula, no ages without children, no volume without drinks)."""
    m = F.col("markers")
    return K.with_markers(named(spark, d), "raw_name").select("product_id", *[m[c].alias(f"{c}_marker") for c in COLUMNS])


KEYED = f"""keyed AS (SELECT *, 'category:' || p_type || '::type:unknown::brand:' || lower(replace(p_brand, '#', ' ')) || '::size:' || p_size || ':unknown::fat:' || CASE WHEN p_partkey % 3 = 0 THEN '1.5' ELSE 'unknown' END ||
  '::stage:' || coalesce(stage_marker, 'unknown') || '::count:' || coalesce(count_marker, 'unknown') || '::age:' || coalesce(age_band_marker, 'unknown') || '::reserve:' || coalesce(reserve_marker, 'unknown') || '::year:' || coalesce(year_marker, 'unknown') ||
  '::age_statement:' || coalesce(age_statement_marker, 'unknown') || '::volume:' || coalesce(volume_marker, 'unknown') || '::flavor:' || coalesce(flavor_marker, 'unknown') || '::color:' || coalesce(color_marker, 'unknown') || '::pack:' || coalesce(pack_marker, 'unknown') ||
  '::range:' || coalesce(range_marker, 'unknown') || '::core:' || {_case([f"'{c}'" for _, _, c in NAMES])} AS canonical_key FROM (SELECT part.*, {EXPECTED} FROM part))"""


def _keyed(spark, d):
    rows = K.with_markers(named(spark, d), "raw_name")
    name = K.canonical_text(F.col("raw_name"))
    size, fat = F.col("p_size").cast("double"), F.when(F.col("product_id") % 3 == 0, 1.5)
    core = K.core_tokens(F.split(name, " "), F.col("p_brand"), F.col("markers"))
    parts = {"category": F.col("p_type"), "type": F.lit(None).cast("string"), "brand": F.col("p_brand"), "size": size, "unit": F.lit(None).cast("string"), "fat": fat, "name": name, "core": core}
    return rows.withColumn("canonical_key", K.canonical_key(parts, F.col("markers")))


@query("canonical_key", f"WITH {KEYED} SELECT sha256(canonical_key) AS canonical_product_id, any_value(canonical_key) AS canonical_key, count(*) AS members, min(p_partkey) AS representative FROM keyed GROUP BY canonical_key")
def canonical_key(spark, d):
    """Products whose key of seventeen parts is equal are one canonical product."""
    g = _keyed(spark, d).groupBy("canonical_key").agg(F.count("*").alias("members"), F.min("product_id").alias("representative"))
    return g.select(F.sha2("canonical_key", 256).alias("canonical_product_id"), "canonical_key", "members", "representative")


@query("size_markers", "SELECT p_partkey AS product_id, CASE p_partkey % 4 WHEN 0 THEN p_size || ' g' WHEN 1 THEN (p_size * 10) || ' ml' WHEN 2 THEN '3 pcs x ' || (p_size * 1000 + 500) || ' ml / total ' || (p_size * 3000 + 1500) || ' ml' ELSE '2 pcs x ' || p_size || ' g / total ' || (2 * p_size) || ' g' END AS display, CASE p_partkey % 4 WHEN 2 THEN 3 WHEN 3 THEN 2 END::INTEGER AS pack_count FROM part")
def size_markers(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("Box "), s, F.lit(" гр."))).when(k % 4 == 1, F.concat(F.lit("Box "), s, F.lit("cl"))).when(k % 4 == 2, F.concat(F.lit("Box 3 бр. x "), s, F.lit(",5 л"))).otherwise(F.concat(F.lit("Box 2x"), s, F.lit(" Г")))
    rows = read(spark, d, "part").select(k.alias("product_id"), K.size_marker(K.variant_text(text)).alias("m"))
    return rows.select("product_id", "m.display", "m.pack_count")


# --- vocabularies ---------------------------------------------------------------------------------------------------------

#: Names, brands, names with brands, and sizes, each an alias of one or two targets: thousands of them.
VOCABULARY = """aliases AS (
  SELECT DISTINCT p_name AS alias, 'item:' || replace(p_name, ' ', '_') AS target FROM part UNION SELECT DISTINCT lower(replace(p_brand, '#', ' ')), 'brand:' || p_brand FROM part
  UNION SELECT DISTINCT p_name || ' ' || lower(replace(p_brand, '#', ' ')), 'own:' || p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'look' FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'adjective' FROM part
  UNION SELECT DISTINCT substr(p_brand, 7) || ' ' || p_size, 'size:' || p_size FROM part),
texts AS (SELECT p_partkey AS product_id, string_split(p_name || ' ' || lower(replace(p_brand, '#', ' ')) || ' ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END, ' ') AS tokens FROM part),
runs AS (SELECT product_id, (i - 1)::INTEGER AS start, n, array_to_string(tokens[i:i + n - 1], ' ') AS alias FROM texts, range(1, 9) r(i), range(1, 5) l(n) WHERE i + n - 1 <= len(tokens)),
found AS (SELECT product_id, start, n, alias, target FROM runs JOIN aliases USING (alias))"""


def _vocabulary(spark, d):
    """Token lists of names, and the aliases."""
    p = read(spark, d, "part")
    brand, look = F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))), F.split("p_name", " ")[0]
    rows = [(F.col("p_name"), F.concat(F.lit("item:"), F.replace("p_name", F.lit(" "), F.lit("_")))), (brand, F.concat(F.lit("brand:"), "p_brand")), (F.concat_ws(" ", "p_name", brand), F.concat(F.lit("own:"), "p_name"))]
    rows += [(look, F.lit("look")), (look, F.lit("adjective")), (F.concat_ws(" ", F.substring("p_brand", 7, 9), "p_size"), F.concat(F.lit("size:"), "p_size"))]
    aliases = p.select(F.explode(F.array(*[F.struct(a.alias("alias"), t.alias("target")) for a, t in rows])).alias("a")).select("a.*").distinct()
    text = F.concat_ws(" ", "p_name", brand, "p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")))
    return p.select(F.col("p_partkey").alias("product_id"), F.split(text, " ").alias("tokens")), aliases


@query("vocabulary_matches", f"WITH {VOCABULARY} SELECT product_id, start, alias, target FROM found")
def vocabulary_matches(spark, d):
    """All aliases in all names, with their places: one pass, however many aliases."""
    from tallyspark.operators import vocabulary as V

    texts, aliases = _vocabulary(spark, d)
    return V.matches(texts, aliases, "product_id", "tokens")


@query("vocabulary_join", f"WITH {VOCABULARY} SELECT product_id, start, alias, target FROM found")
def vocabulary_join(spark, d):
    """The same by a join of runs of tokens, as vocabularies are found that are too large to broadcast."""
    from tallyspark.operators import vocabulary as V

    texts, aliases = _vocabulary(spark, d)
    return V.matches(texts, aliases, "product_id", "tokens", join=True)


@query("vocabulary_tag_evidence", f"WITH {VOCABULARY} SELECT product_id, target, array_to_string(list_sort(list_distinct(list(alias))), '|') AS evidence, count(*) AS times FROM found GROUP BY product_id, target")
def vocabulary_tag_evidence(spark, d):
    from tallyspark.operators import vocabulary as V

    texts, aliases = _vocabulary(spark, d)
    return V.tags(V.matches(texts, aliases, "product_id", "tokens"), "product_id").withColumn("evidence", F.array_join("evidence", "|"))


@query("phrase_rewrite", f"""WITH RECURSIVE {VOCABULARY}, best AS (SELECT product_id, start, max(n) AS n, arg_min(target, (-n, target)) AS target FROM found GROUP BY product_id, start),
walk(product_id, place, out) AS (SELECT product_id, 0, '' FROM texts UNION ALL
  SELECT w.product_id, w.place + coalesce(b.n, 1)::INTEGER, w.out || CASE WHEN w.place > 0 THEN ' ' ELSE '' END || coalesce(b.target, t.tokens[w.place + 1]) FROM walk w JOIN texts t USING (product_id) LEFT JOIN best b ON b.product_id = w.product_id AND b.start = w.place WHERE w.place < len(t.tokens))
SELECT product_id, arg_max(out, place) AS rewritten FROM walk GROUP BY product_id""")
def phrase_rewrite(spark, d):
    """The longest phrases from left to right become their canonical terms."""
    from tallyspark.operators import vocabulary as V

    texts, aliases = _vocabulary(spark, d)
    found = V.longest(texts, aliases, "product_id", "tokens")
    return V.rewritten(texts, found, "product_id", "tokens", lambda alias: F.size(F.split(alias, " "))).select("product_id", "rewritten")


@query("display_prefix", f"WITH {VOCABULARY} SELECT product_id, arg_min(target, (-n, target)) AS display FROM found WHERE start = 0 GROUP BY product_id")
def display_prefix(spark, d):
    """What the longest known prefix of a name is shown as."""
    from tallyspark.operators import vocabulary as V

    texts, aliases = _vocabulary(spark, d)
    return V.longest(texts, aliases, "product_id", "tokens", prefix=True).select("product_id", F.col("target").alias("display"))


# --- food descriptions ----------------------------------------------------------------------------------------------------

#: Descriptions by p_partkey % 12, their segments, core food, signature and penalties or gains besides the type's and the macros' points.
FOODS = (
    ("Rice, {w} (a, b), white, long-grain, cooked", "rice|{w} (a, b)|white|long-grain|cooked", "white rice", "state:cooked|grain_form:kernel|grain_state:cooked", 8),
    ("Apples,  raw, Gala, with  skin", "apples|raw|gala|with skin", "apple gala", "state:raw|skin:with_skin|species:gala", 18),
    ("Apple juice, canned, without sugar", "apple juice|canned|without sugar", "apple juice", "form:juice|preserve:canned|sweet:unsweetened", 8),
    ("Apples, juice ({w}), sweetened", "apples|juice ({w})|sweetened", "apple juice", "form:juice|sweet:sweetened", 0),
    ("Flour, rice, glutinous, fine", "flour|rice|glutinous|fine", "glutinous rice flour", "form:flour|grain_form:flour", 8),
    ("Milk, whole, {s}% {w}, NS as to type", "milk|whole|{s}% {w}|ns as to type", "milk whole_3_25", "milk_fat:whole_3_25|fat:whole_3_25", -7),
    ("Chicken, breast, boneless, skinless, pan-fried, breaded, with salt", "chicken|breast|boneless|skinless|pan-fried|breaded|with salt", "chicken breast", "cook:pan_fried|skin:without_skin|bone:boneless|breaded:breaded|salt:salted|cut:breast", -20),
    ("Beans, {w}, snap, canned, drained solids", "beans|{w}|snap|canned|drained solids", "beans {w} snap", "preserve:canned|drained:drained", 8),
    ("Mushrooms, shiitake, dried", "mushrooms|shiitake|dried", "mushroom shiitake", "state:dried|preserve:dried|species:shiitake", 8),
    ("{w}, (open, never, closed, raw", "{w}|(open, never, closed, raw", "{w}", "state:raw", 18),
    ("{w} closed), frozen, prepared", "{w} closed)|frozen|prepared", "{w} closed)", "preserve:frozen", -7),
    (", ,", "", "unknown", "generic", 8),
)


def _made(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{w}", "' || p_name || '").replace("{s}", "' || p_size || '") + "'"


def _foods(k: int) -> str:
    return "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {_made(f[k]) if k < 4 else f[k]}" for i, f in enumerate(FOODS)) + " END"


FOOD = f"foods AS (SELECT p_partkey AS product_id, {_foods(1)} AS segments, {_foods(2)} AS core_food, {_foods(3)} AS signature, CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 35 END + CASE WHEN p_partkey % 5 > 0 THEN 20 ELSE 0 END + {_foods(4)} AS score FROM part)"


@query("food_descriptions", f"""WITH {FOOD} SELECT product_id, segments, core_food, signature, regexp_replace(replace(core_food, '%', ' percent '), '[^a-z0-9]+', '_', 'g').trim('_') || '__' || trim(regexp_replace(signature, '[^a-z0-9]+', '_', 'g'), '_') AS candidate_key,
  score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN score >= 75 THEN 'candidate' ELSE 'needs_review' END AS review_status FROM foods""")
def food_descriptions(spark, d):
    """Descriptions parsed to segments, core food, hard boundaries, key and score."""
    from tallyspark.functions import descriptions as G

    k, text = F.col("p_partkey"), F.lit("")
    for i, (template, *_) in enumerate(FOODS):
        parts = template.replace("{w}", "\0w\0").replace("{s}", "\0s\0").split("\0")
        text = F.when(k % len(FOODS) == i, F.concat(*[F.col("p_name") if p == "w" else F.col("p_size").cast("string") if p == "s" else F.lit(p) for p in parts])).otherwise(text)
    rows = read(spark, d, "part").select(k.alias("product_id"), text.alias("text"), F.when(k % 2 == 0, "foundation_food").otherwise("sr_legacy_food").alias("data_type"), (k % 5 > 0).alias("has_macros"))
    food = F.col("food")
    rows = G.with_description(rows, "text").withColumn("m", G.candidate_score(food, F.col("data_type"), F.col("has_macros")))
    return rows.select("product_id", F.array_join(food["segments"], "|").alias("segments"), food["core_food"].alias("core_food"), food["signature"].alias("signature"), food["candidate_key"].alias("candidate_key"), "m.*")


@query("food_clusters", f"""WITH {FOOD}, keyed AS (SELECT *, core_food || '#' || signature AS k FROM foods) SELECT any_value(core_food) AS core_food, any_value(signature) AS signature, count(*) AS members, arg_min(product_id, (-score, product_id)) AS representative, max(score) AS score FROM keyed GROUP BY k""")
def food_clusters(spark, d):
    """Foods of one key are a cluster; the best score, then the least identifier stands for it."""
    rows = food_descriptions(spark, d)
    g = rows.groupBy("candidate_key", "core_food", "signature").agg(F.count("*").alias("members"), F.max(F.struct("score", -F.col("product_id"))).alias("r"))
    return g.select("core_food", "signature", "members", (-F.col("r.col2")).alias("representative"), F.col("r.score").alias("score"))
