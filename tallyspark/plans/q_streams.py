"""Queries over streams of events: windows, sessions, signals, analytics events, cooldowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.adapter import read
from tallyspark.plans.registry import query
from tallyspark.sources.buckets import BucketTable
from tallyspark.sources.tables import work_dir
from tallyspark.streaming import capture as C
from tallyspark.streaming import events as E


@query("stream_demand_windows", """WITH w AS (SELECT event_type, unnest(list_transform(range(7), lambda i: date_trunc('day', ts)::DATE - i::INTEGER)) AS s FROM events) SELECT strftime(s, '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM w GROUP BY ALL""")
def stream_demand_windows(spark, d):
    at = work_dir(spark)
    table = BucketTable(spark, f"{at}/windows", ["window_start", "event_type"], "window_start string, event_type string, n long", 8)
    return C.capture(E.demand_windows(E.event_stream(spark, d)), table, f"{at}/demand", "update", True)


@query("stream_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """All sessions, those that may still grow too."""
    at = work_dir(spark)
    table = BucketTable(spark, f"{at}/sessions", ["who", "start"], C.SESSION, 16)
    return C.capture(E.event_stream(spark, d), table, f"{at}/events", write=C.merge_sessions(table, "events")).filter("n > 0").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("stream_signals_once", "SELECT DISTINCT sha256(concat_ws('|', event_type, user_id::VARCHAR, strftime(ts, '%Y-%m-%d'))) AS signal_id, event_type, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_signals_once(spark, d):
    return E.run_to_table(E.signals_once(E.event_stream(spark, d)))


@query("stream_nudges")
def stream_nudges(spark, d):
    """Each decision depends on the last, so the tests state it by a plain loop."""
    return E.run_to_table(E.nudges(E.event_stream(spark, d)))


def signal_streams(events):
    """Searches, shopping lists and watchlists as three streams of signals."""
    day, user = F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string")
    search = events.filter("event_type in ('click', 'view')").select(F.lit("search").alias("source"), F.concat(F.lit(" Item "), user).alias("query"), F.when(F.col("event_type") == "click", "resolved").otherwise("odd").alias("status"), day.alias("timestamp"), F.concat(F.lit("chain-"), F.col("user_id") % 4).alias("chain_id"), "value")
    basket = events.filter("event_type in ('purchase', 'error')").select(F.lit("shopping_list").alias("source"), F.concat(F.lit("item "), user).alias("normalized_query"), F.lit("ambiguous").alias("status"), day.alias("timestamp"), F.lit("  ").alias("category_l1"), F.concat(F.lit("cat-"), F.col("user_id") % 7).alias("category_l2"), "value")
    watch = events.filter("event_type = 'signup'").select(F.lit("watchlist").alias("source"), F.concat(F.lit("item "), user).alias("normalized_query"), day.alias("timestamp"), F.concat(F.lit("loc-"), F.col("user_id") % 5).alias("locality_code"), "value")
    return [s.drop("value") for s in (search, basket, watch)]


@query("stream_gap_signals", """WITH s AS (
  SELECT 'search' AS source, 'item ' || user_id AS normalized_query, CASE WHEN event_type = 'click' THEN 'resolved' ELSE 'unresolved' END AS status, strftime(ts, '%Y-%m-%d') AS timestamp, '' AS category_l2, '' AS locality_code, 'chain-' || (user_id % 4) AS chain_id FROM events WHERE event_type IN ('click', 'view')
  UNION ALL SELECT 'shopping_list', 'item ' || user_id, 'ambiguous', strftime(ts, '%Y-%m-%d'), 'cat-' || (user_id % 7), '', '' FROM events WHERE event_type IN ('purchase', 'error')
  UNION ALL SELECT 'watchlist', 'item ' || user_id, 'unresolved', strftime(ts, '%Y-%m-%d'), '', 'loc-' || (user_id % 5), '' FROM events WHERE event_type = 'signup')
SELECT DISTINCT 'gs_' || substr(sha256(source || '|' || normalized_query || '|' || status || '||' || timestamp || '||' || category_l2 || '|' || locality_code || '|' || chain_id || '|'), 1, 32) AS signal_id, source, normalized_query, status, timestamp, nullif(category_l2, '') AS category_l2, nullif(locality_code, '') AS locality_code, nullif(chain_id, '') AS chain_id FROM s""")
def stream_gap_signals(spark, d):
    """Signals of three streams, captured twice: the second run reads all events again and changes nothing."""
    at = work_dir(spark)
    table = BucketTable(spark, f"{at}/signals", ["signal_id"], C.SIGNAL, 16)
    for run in ("first", "again"):
        out = C.capture(C.gap_signals(*signal_streams(E.event_stream(spark, d))), table, f"{at}/{run}")
    return out.select("signal_id", "source", "normalized_query", "status", "timestamp", "category_l2", "locality_code", "chain_id")


@query("stream_analytics_append", """WITH e AS (SELECT DISTINCT event_type, CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR ELSE 'anonymous' END AS user_id, 'item-' || (user_id % 40) AS query_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events)
  SELECT sha256(event_type || '|' || user_id || '|' || query_text || '||' || created_at) AS analytics_event_id, event_type, user_id, query_text, created_at FROM e""")
def stream_analytics_append(spark, d):
    """Events appended once each, though a second run reads them all again."""
    at = work_dir(spark)
    table = BucketTable(spark, f"{at}/events", ["analytics_event_id"], C.EVENT, 16)
    for run in ("first", "again"):
        e = E.event_stream(spark, d)
        rows = e.select("event_type", F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"), F.concat(F.lit("item-"), F.col("user_id") % 40).alias("query_text"), F.lit(None).cast("string").alias("source_product_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.lit("{}").alias("metadata_json"))
        out = C.capture(C.analytics_events(rows), table, f"{at}/{run}")
    return out.select("analytics_event_id", "event_type", "user_id", "query_text", "created_at")


def _customers(spark, d):
    """Lines of delimited customers: quotes doubled, a cell over two lines, an extra cell, text after a quote."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit('\nsays ""hello; there"""'))).otherwise(F.col("c_name"))
    segment = F.when(k % 11 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('" x'))).otherwise(F.col("c_mktsegment"))
    line = F.concat(F.concat_ws(";", k.cast("string"), name, F.regexp_replace(F.format_string("%.2f", "c_acctbal"), r"\.", ","), segment), F.when(k % 7 == 0, ";more").otherwise(""), F.lit("\r\n"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey", line.alias("line"))


PARSED = """c_custkey, replace(c_name || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || 'says "hello; there"' ELSE '' END, chr(10), '/') AS name, c_acctbal AS balance, c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END AS segment,
  4 + (c_custkey % 7 = 0)::INTEGER AS cells, c_custkey % 7 = 0 AS column_count_mismatch, CASE WHEN c_custkey % 11 = 0 THEN 'text_after_closing_quote' END AS malformed"""


def _parsed(rows, *names):
    from tallyspark.sources.snapshots import price

    return rows.select(*names, F.col("cust_key").cast("long").alias("c_custkey"), F.replace("name", F.lit("\n"), F.lit("/")).alias("name"), price(F.col("balance")).alias("balance"), "segment", F.col("_columns").alias("cells"), F.col("_column_count_mismatch").alias("column_count_mismatch"), F.col("_malformed").alias("malformed"))


HEADER = "﻿Cust Key;Name;Balance;Segment\r\n"


def _with_header(spark, rows):
    """A header before the lines of each file and entry."""
    tops = rows.select("file", "entry").distinct().select("file", "entry", F.lit(-1).cast("long").alias("seq"), F.lit(HEADER).alias("line"))
    return rows.unionByName(tops)


@query("archive_scan", f"SELECT 'region-' || n_regionkey || '.zip' AS archive, 'Chain_' || c_nationkey || '.csv' AS entry, {PARSED} FROM customer JOIN nation ON c_nationkey = n_nationkey")
def archive_scan(spark, d):
    """Customers in an archive for each region with an entry for each nation; every entry is a task of its own."""
    from tallyspark.sources import delimited as D

    at = work_dir(spark)
    rows = _customers(spark, d).select(F.concat(F.lit("region-"), "n_regionkey", F.lit(".zip")).alias("file"), F.concat(F.lit("Chain_"), "c_nationkey", F.lit(".csv")).alias("entry"), F.col("c_custkey").alias("seq"), "line")
    D.write_files(_with_header(spark, rows), at)
    return _parsed(D.read_delimited_files(spark, at), D.base_name("_file").alias("archive"), F.col("_entry").alias("entry"))


@query("delimited_ranges", f"SELECT 'region-' || n_regionkey || '.csv' AS file, {PARSED} FROM customer JOIN nation ON c_nationkey = n_nationkey")
def delimited_ranges(spark, d):
    """Customers in a plain file for each region, read in ranges of 4 KB that start anywhere, inside quotes too."""
    from tallyspark.sources import delimited as D

    at = work_dir(spark)
    rows = _customers(spark, d).select(F.concat(F.lit("region-"), "n_regionkey", F.lit(".csv")).alias("file"), F.lit("").alias("entry"), F.col("c_custkey").alias("seq"), "line")
    D.write_files(_with_header(spark, rows), at)
    return _parsed(D.read_delimited_files(spark, at, range_bytes=4096), D.base_name("_file").alias("file"))
