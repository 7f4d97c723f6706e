"""Streams that end in keyed tables: gap signals of several sources, analytics events, windows whose counts are still moving, sessions that still grow.

A batch is one commit of a `BucketTable`, named by the stream and the batch's number, so a batch that comes again (after a failure between the write and the stream's own record of it)
changes nothing. Rows are merged by key, so input that overlaps with what an earlier run has read changes nothing either. Late rows are merged like any others; no state is held for that.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.buckets import BucketTable

#: Fixed values of the signals.
SOURCES, STATUSES = ("search", "shopping_list", "watchlist"), ("unresolved", "ambiguous", "resolved")
IDENTITY = ("source", "normalized_query", "status", "canonical_attempt", "timestamp", "category_l1", "category_l2", "locality_code", "chain_id", "store_id")
SIGNAL = "signal_id string, source string, query string, normalized_query string, status string, canonical_attempt string, timestamp string, category_l1 string, category_l2 string, locality_code string, chain_id string, store_id string, price_context double"
EVENT = "analytics_event_id string, event_type string, user_id string, query_text string, source_product_id string, created_at string, metadata_json string"

#: who: the user as text, empty for none; n: the session's events, 0 where another session has taken it in.
SESSION = "who string, start timestamp, last timestamp, user_id long, n long"


def one_of(x: Column, values: tuple[str, ...], otherwise: str) -> Column:
    return F.when(x.isin(*values), x).otherwise(otherwise)


def gap_signals(*streams: DataFrame) -> DataFrame:
    """Signals of several streams as one: blank text becomes null, unknown states and sources get their defaults, and what makes a signal is hashed to its identifier.

    A stream has any of the columns of SIGNAL but signal_id; what it lacks is null.
    """
    names = [c.split()[0] for c in SIGNAL.split(", ")][1:]
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    parts = []
    for s in streams:
        s = s.select(*[(F.col(c) if c in s.columns else F.lit(None)).cast("double" if c == "price_context" else "string").alias(c) for c in names])
        s = s.select(*[F.col(c) if c in ("timestamp", "price_context") else blank(c).alias(c) for c in names])
        plain = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
        s = s.withColumns({"source": one_of(F.col("source"), SOURCES, "search"), "status": one_of(F.col("status"), STATUSES, "unresolved"), "normalized_query": F.coalesce("normalized_query", plain)})
        ident = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in IDENTITY]), 256)
        parts.append(s.withColumn("signal_id", F.concat(F.lit("gs_"), F.substring(ident, 1, 32))))
    return reduce(DataFrame.unionByName, parts).select("signal_id", *names)


def analytics_events(rows: DataFrame) -> DataFrame:
    """Events with an identifier of type, user, query, product and time. A user that isn't known is anonymous."""
    rows = rows.withColumn("user_id", F.coalesce("user_id", F.lit("anonymous")))
    ident = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("event_type", "user_id", "query_text", "source_product_id", "created_at")]), 256)
    return rows.withColumn("analytics_event_id", ident).select(*[c.split()[0] for c in EVENT.split(", ")])


def keep(table: BucketTable, stream: str, replace: bool):
    """What foreachBatch calls: a batch is a commit of the table."""

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch, f"{stream}-{number}", replace)

    return write


def merge_sessions(table: BucketTable, stream: str, gap: str = "6 hours"):
    """What foreachBatch calls: a batch's events and the stored sessions of its users become sessions anew. table: keys who and start, columns of SESSION.

    A session ends where a user's next event comes gap or more after its last. Events may come in any order and however late; one between two sessions joins them, and the later is then
    kept with 0 events, so that a batch is a single commit. Events without a time are in no session.
    """

    def write(batch: DataFrame, number: int) -> None:
        who = F.coalesce(F.col("user_id").cast("string"), F.lit(""))
        new = batch.filter("ts is not null").select(who.alias("who"), F.col("ts").alias("start"), F.col("ts").alias("last"), F.col("user_id").cast("long").alias("user_id"), F.lit(1).cast("long").alias("n"))
        old = table.read().filter("n > 0").join(new.select("who").distinct(), "who", "left_semi")
        rows = new.withColumn("stored", F.lit(False)).unionByName(old.withColumn("stored", F.lit(True)))
        w = Window.partitionBy("who").orderBy("start")
        before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("opens", F.when(F.col("start") >= before + F.expr(f"interval {gap}"), 1).otherwise(0))
        rows = rows.withColumn("k", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        made = rows.groupBy("who", "k").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.first("user_id").alias("user_id"), F.sum("n").alias("n")).drop("k")
        taken = rows.filter("stored").join(made.select("who", "start"), ["who", "start"], "left_anti")
        table.merge(made.unionByName(taken.select("who", "start", "last", "user_id", F.lit(0).cast("long").alias("n"))), f"{stream}-{number}")

    return write


def capture(rows: DataFrame, table: BucketTable, checkpoint: str, mode: str = "append", replace: bool = False, write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what its source holds now, and merge its batches into the table. checkpoint: the folder of offsets and state, one for each stream.

    update mode with replace: a window's last count stays. write: takes a batch and its number, instead of a merge of its rows. Returns the table's rows.
    """
    stream = re.sub(r"[^\w.-]+", "-", checkpoint.rstrip("/").rsplit("/", 1)[-1])
    q = rows.writeStream.outputMode(mode).foreachBatch(write or keep(table, stream, replace)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()
