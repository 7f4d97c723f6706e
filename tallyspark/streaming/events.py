"""Streams of events: windowed demand, deduplicated signals, cooldowns with state. Each run takes what is there and stops (availableNow)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.sources.tables import work_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 8).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source holds, in append mode. Offsets, state and output lie in the shared folder, so a lost executor costs a task's repeat."""
    spark, at = stream.sparkSession, work_dir(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def demand_windows(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per event type and sliding window; events later than the watermark are let go, and so is the state of windows that it has passed. For update mode, into a keyed table."""
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


def signals_once(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each signal's identifier once within the watermark."""
    ident = F.sha2(F.concat_ws("|", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd")), 256)
    return events.withColumn("signal_id", ident).withWatermark("ts", late).dropDuplicatesWithinWatermark(["signal_id"]).select("signal_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def nudges(events: DataFrame, cooldown_days: int = 3, late: str = "2 days") -> DataFrame:
    """Nudges that aren't in the cooldown of the last one sent: what was sent is state, so each decision sees the ones before it.

    Events wait in the state until the watermark has passed them, so that those that come out of order, in this batch or a later one, are judged in the order of their times. Later ones than that
    are let go. A user's state ends once nothing waits and the cooldown is over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, at, ids = state.getOption or (None, [], [])
        passed = state.getCurrentWatermarkMs() / 1000
        waiting = list(zip(at, ids))
        if not state.hasTimedOut:
            for b in batches:
                waiting += [(t.timestamp(), int(i)) for i, t in zip(b["event_id"], b["ts"]) if t.timestamp() > passed]
        out = []
        for t, i in sorted(w for w in waiting if w[0] <= passed):
            if sent is None or t - sent >= cooldown_days * 86400:
                sent = t
                out.append((int(key[0]), i))
        waiting = sorted(w for w in waiting if w[0] > passed)
        ends = sent + cooldown_days * 86400 if sent is not None else passed
        if waiting or ends > passed:
            state.update((sent, [t for t, _ in waiting], [i for _, i in waiting]))
            state.setTimeoutTimestamp(int(max(passed + 0.001, waiting[0][0] if waiting else ends) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last double, at array<double>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
