"""Queries over sources, scans, sinks, set operations and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import rounded
from tallyspark.operators import prices as P
from tallyspark.operators.quality import matches
from tallyspark.plans.adapter import LATEST, SNAPSHOTS, read, snapshots, sql_avg, sql_round
from tallyspark.plans.registry import query
from tallyspark.sources.tables import work_dir
from tallyspark.sources import snapshots as S
from tallyspark.sources import tables as T

R = sql_round


@query("scan_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_equality(spark, d):
    return T.equal(read(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_totalprice")


@query("scan_in_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT range FROM range(1, 40))")
def scan_in_list(spark, d):
    return T.within(read(spark, d, "orders"), "o_custkey", list(range(1, 40))).select("o_orderkey", "o_custkey")


@query("scan_many_values", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT range FROM range(1, 1000, 2))")
def scan_many_values(spark, d):
    return T.within(read(spark, d, "orders"), "o_custkey", list(range(1, 1000, 2))).select("o_orderkey", "o_custkey")


@query("scan_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') OR starts_with(c_name, 'Customer_1') ORDER BY c_name LIMIT 50")
def scan_prefix(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return T.prefixed(c, "c_name", "Customer#00000001").unionByName(T.prefixed(c, "c_name", "Customer_1")).orderBy("c_name").limit(50)


@query("keyset_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 500 ORDER BY p_partkey LIMIT 100")
def keyset_page(spark, d):
    return T.key_page(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 500, 100)


@query("table_upsert_delete", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 900000001, 'ADDED'")
def table_upsert_delete(spark, d):
    """Three versions of a keyed table in the shared folder: load, upsert, delete."""
    base = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    t = T.Table(spark, T.work_dir(spark), ["c_custkey"])
    t.write(base)
    t.upsert(base.filter("c_custkey % 4 = 0").withColumn("segment", F.lit("CHANGED")).unionByName(spark.createDataFrame([(900000001, "ADDED")], base.schema)))
    t.delete(base.filter("c_custkey % 10 = 3").select("c_custkey"))
    return t.read()


@query("vector_replication", "SELECT vec_id, 'label ' || label AS title, len(embedding)::INTEGER AS dims FROM embeddings WHERE label <> 3")
def vector_replication(spark, d):
    e = read(spark, d, "embeddings")
    products = e.filter("label != 3").select("vec_id", F.concat(F.lit("label "), "label").alias("title"))
    return T.vector_rows(products, e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vector")


@query("sql_replication", f"WITH {LATEST} SELECT source_product_id, product_name, chain_id, current_price, snapshot_date FROM offers")
def sql_replication(spark, d):
    return P.current_offers(snapshots(spark, d)).select("source_product_id", "product_name", "chain_id", "current_price", "snapshot_date")


def _written(spark, d):
    """Snapshots as tab-separated files with decimal commas and blanks, in the shared folder, and the header that goes with them."""
    rows = snapshots(spark, d)
    comma = lambda c: F.regexp_replace(F.format_string("%.2f", c), r"\.", ",")
    k = F.col("canonical_product_id")
    cells = [F.when(k % 31 == 0, "").otherwise(F.col("locality_code")), F.col("store_name"), F.col("product_name"), k.cast("string"), F.col("category_code"), F.when(k % 37 == 0, "").otherwise(comma("retail_price")), F.when(F.col("promo_price") == 0, "").otherwise(comma("promo_price"))]
    at = T.work_dir(spark)
    lines = rows.select(F.concat_ws("\t", *cells).alias("value"))
    header = "\ufeffLocality Code\tStore Name\tProduct Name\tProduct Code\tCategory Code\tRetail Price\tPromo Price"
    lines.write.text(f"{at}/body")
    return at, header


@query("snapshot_import", f"""WITH {SNAPSHOTS} SELECT CASE WHEN canonical_product_id % 31 = 0 THEN 'blank_locality' END AS reject_reason, canonical_product_id::VARCHAR AS product_code, store_name,
  CASE WHEN canonical_product_id % 37 <> 0 THEN retail_price END AS retail_price, promo_price FROM snapshots""")
def snapshot_import(spark, d):
    at, header = _written(spark, d)
    names = [S.clean_header(h) for h in header.split(S.detect_delimiter(header))]
    raw = spark.read.csv(f"{at}/body", sep="\t", schema=", ".join(f"{n} string" for n in names) + ", _malformed string", mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed")
    return S.snapshot_rows(raw, "2001-08-01", "day.tsv").select("reject_reason", "product_code", "store_name", "retail_price", "promo_price")


@query("ingest_counters", f"""WITH {SNAPSHOTS}, k AS (SELECT * FROM snapshots WHERE canonical_product_id % 31 <> 0) SELECT (SELECT count(*) FROM k) AS imported_rows, (SELECT count(DISTINCT (locality_code, store_name, canonical_product_id, category_code)) FROM k) AS unique_rows,
  (SELECT count(*) FROM k) - (SELECT count(DISTINCT (locality_code, store_name, canonical_product_id, category_code)) FROM k) AS duplicate_rows, 0::BIGINT AS malformed_rows, (SELECT count(*) FROM snapshots WHERE canonical_product_id % 31 = 0) AS rejected_rows""")
def ingest_counters(spark, d):
    at, header = _written(spark, d)
    names = [S.clean_header(h) for h in header.split(S.detect_delimiter(header))]
    raw = spark.read.csv(f"{at}/body", sep="\t", schema=", ".join(f"{n} string" for n in names) + ", _malformed string", mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed")
    return S.ingest_counts(S.snapshot_rows(raw, "2001-08-01", "day.tsv"))


@query("json_lines_baseline", f"WITH {LATEST} SELECT source_product_id, current_price, snapshot_date FROM offers")
def json_lines_baseline(spark, d):
    """Exported twice into one folder and read back: the last row of each key stays."""
    offers = P.current_offers(snapshots(spark, d), "source_product_id", "current_price", "snapshot_date")
    at = T.work_dir(spark)
    old = offers.filter("hash(source_product_id) % 3 = 0").withColumn("snapshot_date", F.lit("1990-01-01")).withColumn("current_price", F.lit(1.0))
    S.export_json_lines(offers.unionByName(old), f"{at}/lines")
    return S.load_json_lines(spark, f"{at}/lines", "source_product_id string, current_price double, snapshot_date string", ["source_product_id"], "snapshot_date")


@query("nutrient_import_counts", """SELECT CASE WHEN l_linenumber NOT IN (1, 2, 3, 5) THEN 'not_macro' WHEN l_discount = 0 THEN 'no_amount' WHEN l_partkey % 13 = 0 THEN 'unknown_food' ELSE 'imported' END AS outcome, count(*) AS rows FROM lineitem GROUP BY 1""")
def nutrient_import_counts(spark, d):
    foods = read(spark, d, "part").filter("p_partkey % 13 != 0").select(F.col("p_partkey").alias("food_id"))
    amounts = read(spark, d, "lineitem").select(F.col("l_partkey").alias("food_id"), F.col("l_linenumber").alias("nutrient_id"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("amount"))
    return S.nutrient_import(foods, amounts, [1, 2, 3, 5])[1]


@query("latest_partition", """WITH y AS (SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS snapshot_date, o_totalprice FROM orders)
  SELECT snapshot_date, count(*) AS rows FROM y WHERE snapshot_date = (SELECT max(snapshot_date) FROM y WHERE snapshot_date BETWEEN '1999-05-27' AND '2000-06-30') GROUP BY 1""")
def latest_partition(spark, d):
    """Orders laid out in a folder per year; the latest one that isn't older than 400 days is found by name and read alone."""
    from tallyspark.sources.snapshots import latest_partition as latest

    root = work_dir(spark)
    rows = read(spark, d, "orders").select(F.date_format(F.date_trunc("year", "o_orderdate"), "yyyy-MM-dd").alias("snapshot_date"), "o_totalprice")
    rows.repartition("snapshot_date").write.partitionBy("snapshot_date").parquet(root)
    day = latest(spark, root, "2000-06-30", 400)
    return spark.read.parquet(f"{root}/snapshot_date={day}").agg(F.count("*").alias("rows")).select(F.lit(day).alias("snapshot_date"), "rows")


@query("archive_entry_names", "SELECT s_suppkey, 'Chain ' || s_nationkey AS chain, s_suppkey AS number FROM supplier")
def archive_entry_names(spark, d):
    chain, number = S.entry_parts(F.concat(F.lit("day/Chain_"), "s_nationkey", F.lit("_"), "s_suppkey", F.lit(".csv")))
    return read(spark, d, "supplier").select("s_suppkey", chain.alias("chain"), number.alias("number"))


# --- set operations and projections ----------------------------------------------------------------------------------------


@query("bag_union_best", "SELECT id, max(score) AS score, count(*) AS proposals FROM (SELECT o_custkey AS id, 1.0::DOUBLE AS score FROM orders UNION ALL SELECT c_custkey, 2.0 FROM customer UNION ALL SELECT s_suppkey, 3.0 FROM supplier) GROUP BY 1")
def bag_union_best(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(1.0).alias("score"))
    b = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(2.0).alias("score"))
    c = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(3.0).alias("score"))
    return a.unionByName(b).unionByName(c).groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("proposals"))


@query("token_set_measures", """WITH t AS (SELECT a.p_partkey AS id, list_distinct(string_split(a.p_name, ' ')) AS x, list_distinct(string_split(b.p_name, ' ')) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
  SELECT id, len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y), 1) AS overlap, len(list_filter(x, lambda t: NOT list_contains(y, t))) + len(list_filter(y, lambda t: NOT list_contains(x, t))) AS not_shared FROM t""")
def token_set_measures(spark, d):
    from tallyspark.functions.text import not_shared, overlap

    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("x"))
    rows = p.join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    x, y = F.array_distinct("x"), F.array_distinct("y")
    return rows.select("id", overlap(x, y).alias("overlap"), not_shared(x, y).cast("long").alias("not_shared"))


@query("enrichment_filters", "SELECT p_partkey FROM part WHERE lower(trim(p_type)) = 'economy' AND (list_contains(string_split(lower(p_name), ' '), 'red') OR list_contains(string_split(lower(p_name), ' '), 'gear')) AND p_size % 2 = 0 AND p_size / 50.0 >= 0.3")
def enrichment_filters(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_type", F.split("p_name", " ").alias("words"), (F.col("p_size") % 2 == 0).alias("even"), (F.col("p_size") / F.lit(50.0)).alias("confidence"))
    return matches(p, {"p_type": " Economy "}, {"words": ["RED", "gear"]}, {"even": True}, 0.3).select("p_partkey")


@query("enrichment_rollup", "SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def enrichment_rollup(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("enrichment_analytics", """WITH v AS (SELECT p_partkey, unnest([
    {'field': 'word', 'vals': string_split(p_name, ' ')}, {'field': 'kind', 'vals': [p_type]}, {'field': 'brand', 'vals': [CASE WHEN p_size < 20 THEN p_brand END]},
    {'field': 'size', 'vals': [CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'medium' END]}, {'field': 'price', 'vals': [CASE WHEN p_retailprice > 910 THEN 'high' ELSE 'low' END]},
    {'field': 'flavor', 'vals': list_filter(string_split(p_name, ' '), lambda w: w IN ('hot', 'red'))}]) AS s FROM part),
  x AS (SELECT DISTINCT p_partkey, s.field AS field, unnest(s.vals) AS value FROM v), k AS (SELECT * FROM x WHERE value IS NOT NULL), h AS (SELECT field, count(DISTINCT p_partkey) AS have FROM k GROUP BY 1), c AS (SELECT field, value, count(*) AS n FROM k GROUP BY ALL)
  SELECT field, value, n, (row_number() OVER (PARTITION BY field ORDER BY n DESC, value))::INTEGER AS rank, """ + R("have::DOUBLE / (SELECT count(*) FROM part)", 4) + """ AS coverage FROM c JOIN h USING (field)""")
def enrichment_analytics(spark, d):
    """Six fields of the products, two with several values, counted in one pass."""
    from tallyspark.operators.quality import count_rollups

    word, size = F.split("p_name", " "), F.col("p_size")
    fields = {"word": word, "kind": F.array("p_type"), "brand": F.array(F.when(size < 20, F.col("p_brand"))), "size": F.array(F.when(size > 25, "large").when(size > 10, "medium")),
              "price": F.array(F.when(F.col("p_retailprice") > 910, "high").otherwise("low")), "flavor": F.filter(word, lambda w: w.isin("hot", "red"))}
    return count_rollups(read(spark, d, "part"), fields)


@query("product_list_items", f"""WITH {LATEST}, c AS (SELECT canonical_product_id, {R('min(current_price)')} AS min_price, count(DISTINCT chain_id) AS chains, bool_or(is_sale) AS on_sale FROM offers GROUP BY 1)
  SELECT p_partkey AS canonical_product_id, p_name AS name, p_brand AS brand, p_type AS category, min_price, coalesce(chains, 0) AS chains, coalesce(on_sale, false) AS on_sale FROM part LEFT JOIN c ON canonical_product_id = p_partkey""")
def product_list_items(spark, d):
    """The short form of each product for lists."""
    offers = P.current_offers(snapshots(spark, d)).groupBy("canonical_product_id").agg(rounded(F.min("current_price")).alias("min_price"), F.countDistinct("chain_id").alias("chains"), F.bool_or("is_sale").alias("on_sale"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("canonical_product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    return p.join(offers, "canonical_product_id", "left").withColumn("chains", F.coalesce("chains", F.lit(0))).withColumn("on_sale", F.coalesce("on_sale", F.lit(False)))


@query("compact_offer_summary", f"""WITH {LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical_product_id ORDER BY current_price, offer_id) AS k FROM offers)
  SELECT canonical_product_id, count(*) AS offer_count, {R('min(current_price)')} AS from_price, {R('max(current_price)')} AS to_price, max(offer_id) FILTER (k = 1) AS best_offer_id, max(chain_id) FILTER (k = 1) AS best_chain_id, max(is_sale::INT) FILTER (k = 1) = 1 AS best_is_sale FROM r GROUP BY 1""")
def compact_offer_summary(spark, d):
    """What a product's page shows of its offers."""
    best = F.min(F.struct("current_price", "offer_id", "chain_id", "is_sale")).alias("b")
    g = P.current_offers(snapshots(spark, d)).groupBy("canonical_product_id").agg(F.count("*").alias("offer_count"), rounded(F.min("current_price")).alias("from_price"), rounded(F.max("current_price")).alias("to_price"), best)
    return g.select("canonical_product_id", "offer_count", "from_price", "to_price", F.col("b.offer_id").alias("best_offer_id"), F.col("b.chain_id").alias("best_chain_id"), F.col("b.is_sale").alias("best_is_sale"))


@query("product_detail_projection", f"""WITH {LATEST} SELECT p_partkey AS canonical_product_id, upper(p_name) AS display_name, {R('min(current_price)')} AS min_price, count(offer_id) AS offers FROM part LEFT JOIN offers ON canonical_product_id = p_partkey GROUP BY ALL""")
def product_detail_projection(spark, d):
    offers = P.current_offers(snapshots(spark, d)).groupBy("canonical_product_id").agg(rounded(F.min("current_price")).alias("min_price"), F.count("*").alias("offers"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("canonical_product_id"), F.upper("p_name").alias("display_name"))
    return p.join(offers, "canonical_product_id", "left").withColumn("offers", F.coalesce("offers", F.lit(0)))


@query("canonical_source_multimap", f"WITH {SNAPSHOTS} SELECT canonical_product_id, array_to_string(list_sort(list(DISTINCT source_product_id)), ',') AS sources FROM snapshots GROUP BY 1")
def canonical_source_multimap(spark, d):
    """A canonical product has few source products, so its list is short."""
    return snapshots(spark, d).groupBy("canonical_product_id").agg(F.array_join(F.array_sort(F.collect_set("source_product_id")), ",").alias("sources"))


@query("product_contexts", f"WITH {SNAPSHOTS}, n AS (SELECT canonical_product_id, count(DISTINCT source_product_id) AS sources FROM snapshots GROUP BY 1) SELECT p_partkey AS canonical_product_id, p_brand, coalesce(sources, 0) AS sources FROM part LEFT JOIN n ON canonical_product_id = p_partkey WHERE p_size > 10")
def product_contexts(spark, d):
    n = snapshots(spark, d).groupBy("canonical_product_id").agg(F.countDistinct("source_product_id").alias("sources"))
    p = read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("canonical_product_id"), "p_brand")
    return p.join(n, "canonical_product_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


@query("first_k_distinct", "SELECT o_custkey, array_to_string(list_slice(list_sort(list(DISTINCT o_orderpriority)), 1, 3), ',') AS sample FROM orders GROUP BY 1")
def first_k_distinct(spark, d):
    from tallyspark.operators.ranking import first_few

    rows = read(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    return first_few(rows, ["o_custkey"], [F.col("o_orderpriority")], F.col("o_orderpriority"), 3, "sample").withColumn("sample", F.array_join("sample", ","))


@query("date_shift", "SELECT o_orderkey, strftime(o_orderdate::DATE - 7, '%Y-%m-%d') AS week_before, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS age FROM orders")
def date_shift(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", F.date_format(F.date_sub(day, 7), "yyyy-MM-dd").alias("week_before"), F.datediff(F.lit("2001-08-01"), day).cast("long").alias("age"))


@query("rounding_kinds", f"SELECT l_orderkey, l_linenumber, {R('l_extendedprice / l_quantity')} AS money, {R('l_extendedprice / l_quantity / 100', 4)} AS ratio, {R('l_quantity / 7', 3)} AS marker FROM lineitem")
def rounding_kinds(spark, d):
    x = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(x).alias("money"), rounded(x / 100, 4).alias("ratio"), rounded(F.col("l_quantity") / 7, 3).alias("marker"))


@query("json_attributes", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 9 <> 0 THEN props END, '$.k') AS BIGINT), -1) AS k FROM events""")
def json_attributes(spark, d):
    """A malformed document counts as an empty one."""
    text = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", F.coalesce(F.from_json(text, "k long")["k"], F.lit(-1)).alias("k"))


@query("disambiguation_sync", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'carried' WHEN b.id IS NULL THEN 'added' ELSE 'kept' END AS state FROM (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.id = b.id""")
def disambiguation_sync(spark, d):
    o = read(spark, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")).distinct().withColumn(n, F.lit(True)) for s, n in (("O", "seen"), ("P", "queued")))
    state = F.when(F.col("seen").isNull(), "carried").when(F.col("queued").isNull(), "added").otherwise("kept")
    return a.join(b, "id", "full_outer").select("id", state.alias("state"))


@query("marker_backfill", "SELECT p_partkey, p_size * 2 AS new_size FROM part WHERE p_size * 2 <> CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 ELSE p_size END")
def marker_backfill(spark, d):
    """Recompute and give only what differs from what is stored."""
    stored = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 2).otherwise(F.col("p_size"))
    return read(spark, d, "part").withColumn("new_size", F.col("p_size") * 2).filter(~F.col("new_size").eqNullSafe(stored)).select("p_partkey", "new_size")


@query("geocode_cache", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'cache' ELSE 'provider' END AS path, CASE WHEN c_nationkey < 10 THEN c_nationkey * 1.0 ELSE -1.0 END::DOUBLE AS lat FROM customer")
def geocode_cache(spark, d):
    cache = read(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").cast("double").alias("cached"))
    rows = read(spark, d, "customer").join(cache, "c_nationkey", "left")
    return rows.select("c_custkey", F.when(F.col("cached").isNotNull(), "cache").otherwise("provider").alias("path"), F.coalesce("cached", F.lit(-1.0)).alias("lat"))


@query("home_summary", f"WITH {LATEST} SELECT chain_id, count(*) AS offers, count(*) FILTER (is_sale) AS sales, {R(sql_avg('current_price'))} AS mean_price FROM offers GROUP BY 1 ORDER BY sales DESC, chain_id LIMIT 10")
def home_summary(spark, d):
    from tallyspark.functions.money import exact_avg

    g = P.current_offers(snapshots(spark, d)).groupBy("chain_id").agg(F.count("*").alias("offers"), F.count_if("is_sale").alias("sales"), rounded(exact_avg(F.col("current_price"))).alias("mean_price"))
    return g.orderBy(F.desc("sales"), "chain_id").limit(10)


@query("daily_pipeline", f"""WITH {SNAPSHOTS}, a AS (SELECT max(snapshot_date) AS d FROM snapshots), t AS (SELECT * FROM priced WHERE snapshot_date = (SELECT d FROM a))
  SELECT (SELECT d FROM a) AS snapshot_date, count(*) AS rows, count(DISTINCT source_product_id) AS products, {R(sql_avg('price'))} AS mean_price FROM t""")
def daily_pipeline(spark, d):
    """Discover the latest day, take its rows, aggregate."""
    from tallyspark.functions.money import exact_avg

    rows = P.with_price(snapshots(spark, d))
    last = rows.agg(F.max("snapshot_date").alias("snapshot_date"))
    return rows.join(F.broadcast(last), "snapshot_date").groupBy("snapshot_date").agg(F.count("*").alias("rows"), F.countDistinct("source_product_id").alias("products"), rounded(exact_avg(F.col("price"))).alias("mean_price"))
