"""Work on keyed tables in commits: imports with counters, queues, reviews, merges, backfills, and a daily run of stages that resumes where it stopped.

Tables are `BucketTable`s: a commit that comes again changes nothing, and what each commit did to each key is kept in the table's history.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.sources.buckets import BucketTable

QUEUE = "id string, status string, first_seen string, last_seen string"
REVIEWS = "item_id string, status string, reviewer string, decided_at string"
VECTORS = "id string, content_hash string, vector array<double>"


def import_rows(table: BucketTable, rows: DataFrame, commit: str, reject: Column | None = None) -> dict[str, int]:
    """Merge a day's rows and count while they are written: imported and rejected rows, unique keys, duplicates, and keys created, updated and unchanged. One job, no second scan.

    reject: why a row isn't taken, or null. A commit that was made before counts 0 throughout.
    """
    bad = reject.isNotNull() if reject is not None else F.lit(False)
    seen = Observation()
    counted = rows.withColumn("__bad", bad).observe(seen, F.count_if(~F.col("__bad")).alias("imported"), F.count_if("__bad").alias("rejected"))
    again = table.done(commit)
    out = table.merge(counted.filter(~F.col("__bad")), commit)
    unique = sum(out.values())
    taken = {"imported": 0, "rejected": 0} if again else {k: seen.get[k] for k in ("imported", "rejected")}
    return taken | {"unique": unique, "duplicates": taken["imported"] - unique} | out


def sync_queue(table: BucketTable, seen: DataFrame, day: str, commit: str) -> dict[str, int]:
    """Bring a queue of open questions up to date. seen: id. New ones are pending since `day`; ones seen before keep their status and when they came; the others are carried unchanged."""
    old = table.read().select("id", "status", "first_seen")
    rows = seen.select("id").distinct().join(old, "id", "left")
    return table.merge(rows.select("id", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("first_seen", F.lit(day)).alias("first_seen"), F.lit(day).alias("last_seen")), commit)


def review(table: BucketTable, decisions: DataFrame, transitions: Sequence[tuple[str, str]], commit: str) -> dict[str, int]:
    """Apply decisions (item_id, to_status, reviewer, decided_at) to items where the state machine allows it. Of several for an item in one commit the earliest counts; ties go to the least status."""
    one = decisions.groupBy("item_id").agg(F.min(F.struct("decided_at", "to_status", "reviewer")).alias("d"))
    allowed = decisions.sparkSession.createDataFrame(list(transitions), "status string, to_status string")
    rows = table.read().select("item_id", "status").join(one.select("item_id", "d.*"), "item_id").join(F.broadcast(allowed), ["status", "to_status"])  # the state machine's few arrows
    return table.merge(rows.select("item_id", F.col("to_status").alias("status"), "reviewer", "decided_at"), commit)


def transitions_of(table: BucketTable) -> DataFrame:
    """Each change of an item's status, in the order of commits: key, from, status, commit."""
    w = Window.partitionBy(*table.keys).orderBy("commit")  # an item's own changes
    return table.history().filter("state != 'unchanged'").withColumn("from_status", F.lag("status").over(w))


def apply_merges(table: BucketTable, decisions: DataFrame, commit: str) -> dict[str, int]:
    """Products with canonical_id; decisions: product_id, into, outcome. What is merged points to where it goes; all decisions, with their outcome, are the commit's audit log."""
    decided = table.read().select("product_id").join(decisions.groupBy("product_id").agg(F.min(F.struct("into", "outcome")).alias("d")), "product_id")
    merged = F.col("d.outcome") == "merged"
    rows = decided.select("product_id", F.when(merged, F.col("d.into")).otherwise(F.col("product_id")).alias("canonical_id"), F.col("d.outcome").alias("outcome"))
    return table.merge(rows, commit)


def backfill(table: BucketTable, fresh: DataFrame, commit: str) -> dict[str, int]:
    """Write recomputed values of stored keys where they differ; keys that aren't stored are left out. The rows that changed are the commit's history."""
    return table.merge(fresh.join(table.read().select(*table.keys), table.keys, "left_semi"), commit)


def token_means(texts: Sequence[str], dims: int = 8) -> list[list[float]]:
    """The offline provider: the mean of its words' hashed vectors, in whole millionths; all zero without words."""
    out = []
    for text in texts:
        words, total = text.split(), [0] * dims
        n = len(words)
        for h in (hashlib.sha256(w.encode()).hexdigest() for w in words):
            for i in range(dims):
                total[i] += math.floor((int(h[8 * i : 8 * i + 8], 16) / 4294967295.0 * 2 - 1) * 1e6 + 0.5)
        out.append([(2 * t + n) // (2 * n) / 1e6 if n else 0.0 for t in total])
    return out


def backfill_vectors(table: BucketTable, items: DataFrame, commit: str, provider: Callable[[list[str]], list[list[float]]] = token_means, version: str = "v1", batch: int = 64, attempts: int = 3) -> dict[str, int]:
    """Ask a provider for vectors of items (id, text) that have none, or whose text or version changed, in batches of bounded size; a batch that fails is tried again, then its task is.

    Gives how many were asked: created (new) and updated (changed).
    """
    known = table.read().select("id", "content_hash")
    wanted = items.filter(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", F.sha2(F.concat(F.lit(f"{version}|"), "text"), 256))
    wanted = wanted.join(known, ["id", "content_hash"], "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                for attempt in range(attempts):
                    try:
                        vectors = provider(part["text"].tolist())
                        break
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                yield pd.DataFrame({"id": part["id"], "content_hash": part["content_hash"], "vector": vectors})

    return table.merge(wanted.mapInPandas(ask, VECTORS), commit)


class DailyRun:
    """Stages of a day, each with a record of its own: a day that is done is skipped, and one that broke off goes on with the first stage without a record.

    A stage is (name, function of this run and the day); it gives counts, which its record holds. It must write its tables by overwriting or by commits named by the day, so
    that it may be made again. Records are files of the shared folder, written after the stage's tables.
    """

    def __init__(self, spark: SparkSession, root: str, stages: Sequence[tuple[str, Callable[[DailyRun, str], dict[str, int]]]]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), list(stages)

    def path(self, name: str, day: str) -> str:
        return f"{self.root}/{name}/day={day}"

    def _file(self, day: str, stage: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/records/{day}/{stage}.json")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def record(self, day: str, stage: str) -> dict[str, int] | None:
        fs, at = self._file(day, stage)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def run(self, day: str) -> dict[str, dict[str, int]]:
        """The records of all stages of the day. Skips those that have one."""
        if not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
            raise ValueError("a day is written as 2024-05-31")
        out = {}
        for name, stage in self.stages:
            found = self.record(day, name)
            if found is None:
                found = stage(self, day)
                fs, at = self._file(day, name)
                stream = fs.create(at, True)
                stream.write(bytearray(json.dumps(found).encode()))
                stream.close()
            out[name] = found
        return out
