"""A store of keyed tables as Parquet folders: scans that push down, keyed upserts and deletes, paging by key, replication."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of this machine only where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or os.path.join(tempfile.gettempdir(), "tallyspark-scratch")).rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared store."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def within(df: DataFrame, column: str, values: list) -> DataFrame:
    """Few values go into the filter, many into a semi-join."""
    if len(values) <= 200:
        return df.filter(F.col(column).isin(values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(keys.distinct(), column, "left_semi")


def prefixed(df: DataFrame, column: str, prefix: str, limit: int | None = None) -> DataFrame:
    out = df.filter(F.col(column).startswith(prefix))
    return out.orderBy(column).limit(limit) if limit else out


def key_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page after a key: a filter and a top-k, no offset to count through."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


class Table:
    """Versions of one keyed table. A write makes a new version folder and then points to it, so readers never see half a write and a lost
    executor's tasks are simply run again."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys, self.version = spark, path, keys, 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same key; of several with one key the one of greatest value in column order stays."""
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*self.keys, "__r.*")
        self.write(one if not self.version else self.read().join(one.select(*self.keys), self.keys, "left_anti").unionByName(one))

    def delete(self, keys: DataFrame) -> None:
        self.write(self.read().join(keys.select(*self.keys), self.keys, "left_anti"))


def vector_rows(products: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """What a vector index takes: key, a title, the vector and its length; products without one stay out."""
    return products.join(vectors, key).select(key, "title", "vector", F.size("vector").alias("dims"))
