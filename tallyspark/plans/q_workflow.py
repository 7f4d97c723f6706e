"""Queries over keyed tables in commits: imports with counters, queues, reviews, merges, backfills, and the daily run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import markers as K
from tallyspark.functions.money import exact_avg, rounded
from tallyspark.operators import prices as P
from tallyspark.operators import workflow as W
from tallyspark.plans.adapter import SNAPSHOTS, read, snapshots, sql_avg, sql_round
from tallyspark.plans.q_markers import EXPECTED, named
from tallyspark.plans.registry import query
from tallyspark.sources.buckets import BucketTable
from tallyspark.sources.tables import work_dir

R = sql_round
SPLIT = "2000-01-01"
CURRENT = "source_product_id string, snapshot_date string, snapshot_id string, retail_price double, promo_price double"


@query("import_counters", f"""WITH {SNAPSHOTS}, k AS (SELECT *, snapshot_date < '{SPLIT}' AS first, canonical_product_id % 31 = 0 AS bad FROM snapshots),
  a AS (SELECT DISTINCT source_product_id FROM k WHERE first AND NOT bad), b AS (SELECT DISTINCT source_product_id FROM k WHERE NOT first AND NOT bad), n AS (SELECT count(*) AS shared FROM a JOIN b USING (source_product_id))
  SELECT 'a-first' AS commit, count(*) FILTER (first AND NOT bad) AS imported, count(*) FILTER (first AND bad) AS rejected, (SELECT count(*) FROM a) AS "unique", count(*) FILTER (first AND NOT bad) - (SELECT count(*) FROM a) AS duplicates, (SELECT count(*) FROM a) AS created, 0::BIGINT AS updated, 0::BIGINT AS unchanged FROM k
  UNION ALL SELECT 'b-second', count(*) FILTER (NOT first AND NOT bad), count(*) FILTER (NOT first AND bad), (SELECT count(*) FROM b), count(*) FILTER (NOT first AND NOT bad) - (SELECT count(*) FROM b), (SELECT count(*) FROM b) - (SELECT shared FROM n), (SELECT shared FROM n), 0 FROM k
  UNION ALL SELECT 'c-again', count(*) FILTER (NOT first AND NOT bad), count(*) FILTER (NOT first AND bad), (SELECT count(*) FROM b), count(*) FILTER (NOT first AND NOT bad) - (SELECT count(*) FROM b), 0, 0, (SELECT count(*) FROM b) FROM k""")
def import_counters(spark, d):
    """Three imports into one table, the last of rows that are there: counters come from the writes themselves."""
    rows = snapshots(spark, d).select(*[c.split()[0] for c in CURRENT.split(", ")], "canonical_product_id")
    table = BucketTable(spark, f"{work_dir(spark)}/current", ["source_product_id"], CURRENT, 16)
    bad = F.when(F.col("canonical_product_id") % 31 == 0, "blocked")
    out = []
    for commit, part in (("a-first", rows.filter(F.col("snapshot_date") < SPLIT)), ("b-second", rows.filter(F.col("snapshot_date") >= SPLIT)), ("c-again", rows.filter(F.col("snapshot_date") >= SPLIT))):
        n = W.import_rows(table, part, commit, bad)
        out.append((commit, *[n[c] for c in ("imported", "rejected", "unique", "duplicates", "created", "updated", "unchanged")]))
    return spark.createDataFrame(out, "commit string, imported long, rejected long, unique long, duplicates long, created long, updated long, unchanged long")


@query("queue_sync", """WITH o AS (SELECT o_custkey::VARCHAR AS id, max(o_orderstatus = 'F') AS f, max(o_orderstatus = 'O') AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
  SELECT id, 'pending' AS status, CASE WHEN f THEN '2024-01-01' ELSE '2024-01-02' END AS first_seen, CASE WHEN o THEN '2024-01-02' ELSE '2024-01-01' END AS last_seen FROM o""")
def queue_sync(spark, d):
    """Customers with finished orders were in question on the first day, those with open ones are on the second."""
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus")
    table = BucketTable(spark, f"{work_dir(spark)}/queue", ["id"], W.QUEUE, 16)
    W.sync_queue(table, o.filter("o_orderstatus = 'F'"), "2024-01-01", "day1")
    W.sync_queue(table, o.filter("o_orderstatus = 'O'"), "2024-01-02", "day2")
    return table.read()


ARROWS = (("open", "approved"), ("open", "rejected"), ("rejected", "open"))


@query("review_history", """WITH c AS (SELECT c_custkey::VARCHAR AS item_id, c_custkey % 5 AS k FROM customer), s AS (
  SELECT item_id, 'open' AS status, NULL::VARCHAR AS from_status, 'r0' AS commit FROM c
  UNION ALL SELECT item_id, CASE WHEN k = 0 THEN 'rejected' ELSE 'approved' END, 'open', 'r1' FROM c WHERE k < 4
  UNION ALL SELECT item_id, CASE WHEN k = 0 THEN 'open' ELSE 'rejected' END, CASE WHEN k = 0 THEN 'rejected' ELSE 'open' END, 'r2' FROM c WHERE k IN (0, 4))
SELECT * FROM s""")
def review_history(spark, d):
    """Two rounds of decisions: approved items stay so, rejected ones may be opened again; each change is a row of the history."""
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), (F.col("c_custkey") % 5).alias("k"))
    table = BucketTable(spark, f"{work_dir(spark)}/reviews", ["item_id"], W.REVIEWS, 16)
    none = F.lit(None).cast("string")
    table.merge(c.select("item_id", F.lit("open").alias("status"), none.alias("reviewer"), none.alias("decided_at")), "r0")
    first = c.filter("k < 4").select("item_id", F.when(F.col("k") == 0, "rejected").otherwise("approved").alias("to_status"), F.lit("a").alias("reviewer"), F.lit("2024-01-01").alias("decided_at"))
    W.review(table, first, ARROWS, "r1")
    second = c.select("item_id", F.when(F.col("k") == 4, "rejected").otherwise("open").alias("to_status"), F.lit("b").alias("reviewer"), F.lit("2024-01-02").alias("decided_at"))
    W.review(table, second, ARROWS, "r2")
    return W.transitions_of(table).select("item_id", "status", "from_status", "commit")


@query("merge_audit", """WITH p AS (SELECT p_partkey::VARCHAR AS product_id, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'merged' WHEN p_partkey % 3 = 1 THEN 'vetoed' END AS outcome FROM part)
  SELECT product_id, CASE WHEN outcome = 'merged' THEN (p_partkey + 1)::VARCHAR ELSE product_id END AS canonical_id, outcome, 'updated' AS state FROM p WHERE outcome IS NOT NULL""")
def merge_audit(spark, d):
    """The audit log of merges: what was decided for each product and where it points since."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_partkey")
    table = BucketTable(spark, f"{work_dir(spark)}/canonical", ["product_id"], "product_id string, canonical_id string, outcome string", 16)
    table.merge(p.select("product_id", F.col("product_id").alias("canonical_id"), F.lit(None).cast("string").alias("outcome")), "load")
    k = F.col("p_partkey")
    decisions = p.filter(k % 3 < 2).select("product_id", (k + 1).cast("string").alias("into"), F.when(k % 3 == 0, "merged").otherwise("vetoed").alias("outcome"))
    W.apply_merges(table, decisions, "merge-1")
    return table.history().filter("commit = 'merge-1'").select("product_id", "canonical_id", "outcome", "state")


@query("marker_patches", f"SELECT product_id, volume_marker, stage_marker FROM (SELECT p_partkey AS product_id, {EXPECTED} FROM part) WHERE product_id % 2 = 1 AND (volume_marker IS NOT NULL OR stage_marker IS NOT NULL)")
def marker_patches(spark, d):
    """Markers computed anew for stored products, of which every other one was stored without: the patches that were written."""
    m = F.col("markers")
    fresh = K.with_markers(named(spark, d), "raw_name").select("product_id", m["volume"].alias("volume_marker"), m["stage"].alias("stage_marker"))
    table = BucketTable(spark, f"{work_dir(spark)}/products", ["product_id"], "product_id long, volume_marker string, stage_marker string", 16)
    keep = lambda c: F.when(F.col("product_id") % 2 == 0, F.col(c)).alias(c)
    table.merge(fresh.select("product_id", keep("volume_marker"), keep("stage_marker")), "load")
    W.backfill(table, fresh, "backfill")
    return table.history().filter("commit = 'backfill' and state = 'updated'").select("product_id", "volume_marker", "stage_marker")


MEANS = """tokens AS (SELECT id, unnest(string_split(text, ' ')) AS w FROM t), hashed AS (SELECT id, i, floor((('0x' || substr(sha256(w), 8 * i + 1, 8))::BIGINT::DOUBLE / 4294967295.0 * 2 - 1) * 1e6 + 0.5)::BIGINT AS x FROM tokens, range(8) r(i)),
summed AS (SELECT id, i, 2 * sum(x)::BIGINT + count(*) AS s, 2 * count(*) AS n FROM hashed GROUP BY ALL)
SELECT id, i::INTEGER AS place, ((s - ((s % n) + n) % n) // n)::DOUBLE / 1e6 AS value FROM summed"""


@query("embedding_backfill", f"WITH t AS (SELECT p_partkey::VARCHAR AS id, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' changed' ELSE '' END AS text FROM part), {MEANS}")
def embedding_backfill(spark, d):
    """Vectors for half of the products, then for what is missing or changed, then for nothing."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_partkey")
    table = BucketTable(spark, f"{work_dir(spark)}/vectors", ["id"], W.VECTORS, 16)
    W.backfill_vectors(table, p.filter("p_partkey % 2 = 0").select("id", F.col("p_name").alias("text")), "b1")
    now = p.select("id", F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " changed").otherwise("")).alias("text"))
    W.backfill_vectors(table, now, "b2")
    W.backfill_vectors(table, now, "b3")
    return table.read().select("id", F.posexplode("vector").alias("place", "value"))


# --- the daily run ----------------------------------------------------------------------------------------------------------


def discover(run: W.DailyRun, day: str) -> dict[str, int]:
    """How many files the day's folder has; none is an error."""
    n = len(run.spark.read.parquet(run.path("source", day)).inputFiles())
    if not n:
        raise FileNotFoundError(f"no files of {day}")
    return {"files": n}


def ingest(run: W.DailyRun, day: str) -> dict[str, int]:
    """The day's rows with a price, merged into the current ones; counted as they are written."""
    rows = P.with_price(run.spark.read.parquet(run.path("source", day))).withColumn("snapshot_date", F.lit(day))
    table = current_table(run)
    counts = W.import_rows(table, rows, f"day-{day}", F.when(F.col("price").isNull(), "no_price"))
    rows.filter("price is not null").write.mode("overwrite").parquet(run.path("rows", day))
    return counts


def embed(run: W.DailyRun, day: str) -> dict[str, int]:
    """Vectors of products that have none yet."""
    names = run.spark.read.parquet(run.path("rows", day)).groupBy(F.col("canonical_product_id").cast("string").alias("id")).agg(F.min("product_name").alias("text"))
    return W.backfill_vectors(BucketTable(run.spark, f"{run.root}/vectors", ["id"], W.VECTORS, 8), names, f"day-{day}")


def aggregate(run: W.DailyRun, day: str) -> dict[str, int]:
    """Mean, least and number of prices by product."""
    rows = run.spark.read.parquet(run.path("rows", day))
    g = rows.groupBy("canonical_product_id").agg(rounded(exact_avg(F.col("price"))).alias("mean_price"), F.min("price").alias("min_price"), F.count("*").alias("offers"))
    g.write.mode("overwrite").parquet(run.path("daily", day))
    return {"products": run.spark.read.parquet(run.path("daily", day)).count()}


def alert(run: W.DailyRun, day: str) -> dict[str, int]:
    """Products whose mean fell by a tenth or more since the last day before that was aggregated."""
    from tallyspark.sources.snapshots import latest_partition

    before = (F.to_date(F.lit(day)) - F.expr("INTERVAL 1 DAY")).cast("string")
    yesterday = run.spark.range(1).select(before).first()[0]
    last = latest_partition(run.spark, f"{run.root}/daily", yesterday, 3650, "day")
    now = run.spark.read.parquet(run.path("daily", day)).select("canonical_product_id", "mean_price")
    old = now.limit(0) if last is None else run.spark.read.parquet(run.path("daily", last))
    drops = now.join(old.select("canonical_product_id", F.col("mean_price").alias("before")), "canonical_product_id").filter(F.col("mean_price") <= F.col("before") * 0.9)
    drops.write.mode("overwrite").parquet(run.path("alerts", day))
    return {"alerts": run.spark.read.parquet(run.path("alerts", day)).count()}


STAGES = (("discover", discover), ("ingest", ingest), ("embed", embed), ("aggregate", aggregate), ("alert", alert))


def current_table(run: W.DailyRun) -> BucketTable:
    return BucketTable(run.spark, f"{run.root}/current", ["source_product_id"], "source_product_id string, snapshot_date string, snapshot_id string, price double", 8)


def lay_out(spark, rows, root: str) -> None:
    """Rows with `day` in a folder for each."""
    rows.repartition("day").write.partitionBy("day").parquet(f"{root}/source")


def quarters(spark, d):
    return snapshots(spark, d).withColumn("day", F.date_format(F.date_trunc("quarter", F.to_date("snapshot_date")), "yyyy-MM-dd")).drop("snapshot_date")


@query("daily_run", f"""WITH {SNAPSHOTS}, q AS (SELECT strftime(date_trunc('quarter', snapshot_date::DATE), '%Y-%m-%d') AS day, source_product_id, canonical_product_id AS p, price FROM priced), days AS (SELECT DISTINCT day FROM q ORDER BY day LIMIT 3),
  r AS (SELECT q.* FROM q JOIN days USING (day)), g AS (SELECT day, p, {R(sql_avg('price'))} AS mean_price FROM r WHERE price IS NOT NULL GROUP BY ALL),
  l AS (SELECT *, lag(day) OVER (ORDER BY day) AS last FROM days)
  SELECT l.day, (SELECT count(*) FROM r WHERE r.day = l.day AND price IS NOT NULL) AS imported, (SELECT count(*) FROM (SELECT source_product_id, min(day) AS day FROM r WHERE price IS NOT NULL GROUP BY 1) x WHERE x.day = l.day) AS created,
    (SELECT count(*) FROM (SELECT p, min(day) AS day FROM r WHERE price IS NOT NULL GROUP BY 1) x WHERE x.day = l.day) AS embedded, (SELECT count(*) FROM g WHERE g.day = l.day) AS products,
    (SELECT count(*) FROM g JOIN g o ON g.p = o.p AND o.day = l.last WHERE g.day = l.day AND g.mean_price <= o.mean_price * 0.9) AS alerts FROM l""")
def daily_run(spark, d):
    """The first three quarters as days of a run of five stages; each is run twice, the second time by its records alone."""
    root = work_dir(spark)
    rows = quarters(spark, d)
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").limit(3).collect()]
    lay_out(spark, rows.filter(F.col("day").isin(days)), root)
    run, out = W.DailyRun(spark, root, STAGES), []
    for day in days:
        run.run(day)
        n = run.run(day)
        out.append((day, n["ingest"]["imported"], n["ingest"]["created"], n["embed"]["created"], n["aggregate"]["products"], n["alert"]["alerts"]))
    return spark.createDataFrame(out, "day string, imported long, created long, embedded long, products long, alerts long")
