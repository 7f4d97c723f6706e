"""Keyed tables in hash buckets: a patch rewrites the buckets it touches and leaves the files of all others alone.

A merge is a commit with an identifier. It first writes what it changes (the new rows with what became of each: created, updated or unchanged) as the commit's part of an append-only history,
then rewrites the touched buckets, then marks the commit as done. A commit that is done is not made again; one that broke off goes on from the changes that it wrote, which don't depend on
how far it got. Bucket numbers (a parameter) and the names of commits are all that the driver holds. Counts come from the write itself, by an Observation, not from another pass.

Cases. A row without its key is left out. Of several rows of one key in a patch the one that is greatest in column order counts. An empty patch is a commit without changes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32
STATES = ("created", "updated", "unchanged")


class BucketTable:
    """keys: the columns of the key; schema: all columns, as a DDL string."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.rest = [c for c in self.schema.fieldNames() if c not in keys]

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, at: str) -> bool:
        fs, path = self._fs(at)
        return fs.exists(path)

    def _stored(self) -> DataFrame:
        if not self._there(f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().select(*self.keys, *self.rest)

    def history(self) -> DataFrame:
        """All changes of all commits: the rows, their state, and commit."""
        return self.spark.read.parquet(f"{self.path}/changes").select(*self.keys, *self.rest, "state", "commit")

    def done(self, commit: str) -> bool:
        return self._there(f"{self.path}/commits/{commit}")

    def merge(self, patch: DataFrame, commit: str, replace: bool = True, delete: bool = False) -> dict[str, int]:
        """Rows of the patch replace stored ones of the same key; with replace off, stored ones stay. delete: rows of these keys go. Gives how many rows had each state."""
        if not re.fullmatch(r"[\w.-]+", commit):
            raise ValueError("a commit's name has letters, digits, full stops and hyphens only")
        if self.done(commit):
            return dict.fromkeys(STATES, 0)
        changes, counts = f"{self.path}/changes/commit={commit}", dict.fromkeys(STATES, 0)
        if not self._there(f"{changes}/_SUCCESS"):
            counts = self._write_changes(patch, changes, replace)
        made = self.spark.read.parquet(changes).filter("state != 'unchanged'")
        touched = [r["bucket"] for r in made.select("bucket").distinct().collect()]
        if touched:
            old = self._stored().filter(F.col("bucket").isin(touched)).join(made.select(*self.keys), self.keys, "left_anti").select(*self.keys, *self.rest, "bucket")
            new = old if delete else old.unionByName(made.select(*self.keys, *self.rest, "bucket"))
            empty = self._emptied(new, touched) if delete else []
            new.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
            for b in empty:
                fs, at = self._fs(f"{self.path}/rows/bucket={b}")
                fs.delete(at, True)
        fs, at = self._fs(f"{self.path}/commits/{commit}")
        fs.create(at, True).close()
        return counts

    def _emptied(self, new: DataFrame, touched: list[int]) -> list[int]:
        """Buckets that a delete leaves without rows: a dynamic overwrite doesn't see them."""
        left = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        return [b for b in touched if b not in left]

    def _write_changes(self, patch: DataFrame, at: str, replace: bool) -> dict[str, int]:
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        rest = F.struct(*self.rest) if self.rest else F.struct(F.lit(True).alias("one"))
        one = patch.select(*self.keys, *self.rest).filter(known).groupBy(*self.keys).agg(F.max(rest).alias("__new"))
        one = one.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        old = self._stored().select(*self.keys, rest.alias("__old"))
        both = one.join(old, self.keys, "left")
        same = F.col("__old").isNotNull() & (F.lit(True) if not replace else F.col("__old").eqNullSafe(F.col("__new")))
        state = F.when(F.col("__old").isNull(), "created").when(same, "unchanged").otherwise("updated")
        counts = Observation()
        rows = both.select(*self.keys, *[F.col(f"__new.{c}").alias(c) for c in self.rest], "bucket", state.alias("state"))
        rows = rows.observe(counts, *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
        rows.write.mode("overwrite").parquet(at)
        return {s: counts.get[s] for s in STATES}
