"""Helpers that the corpus operators share: scratch tables, size-checked broadcasts, stable hashes."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator broadcasts after it has counted the rows.
BROADCAST_BYTES = 8 << 20
WRITERS_PER_CORE = 2
#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes, that Spark hands to Python at once. Whole texts can be long, so the batches are short.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of this machine only where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "tallyspark-scratch")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def aside(df: DataFrame, outputs: Sequence[str], *used: str) -> tuple:
    """df with the columns that bear the name of an output (in any case) renamed: `_in` goes after the name until it is free.

    used: columns that the operator reads; their names after that follow df in the result.
    """
    taken, names = {c.lower() for c in [*df.columns, *outputs]}, {}
    for c in df.columns:
        new = c
        while new.lower() in {o.lower() for o in outputs} or (new != c and new.lower() in taken):
            new += "_in"
        if new != c:
            taken.add(new.lower())
        names[c] = new
    out = df.select(*[x.alias(names[c]) for x, c in zip(every(df), df.columns)])
    return (out, *[next(new for c, new in names.items() if c.lower() == u.lower()) for u in used])


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, narrow: bool = False, **counts: Column | str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and any executor can read it.

    narrow: what a shuffle leaves is little, so a few tasks a core write it, not one for each of the shuffle's partitions. counts: conditions whose rows the write
    counts (rows="true": every row), so that no query of its own need do it; `rows_in` gives the numbers.
    """
    path, seen = scratch_path(df.sparkSession, name), Observation()
    out = df.observe(seen, *[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in counts.items()]) if counts else df
    out = out.coalesce(WRITERS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism) if narrow else out
    out.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch, out._counted = path, dict(seen.get) if counts else {}
    return out


def rows_in(df: DataFrame, what: str = "rows") -> int:
    """Rows of a table made by save() that met the condition of that name, as its write counted them."""
    return df._counted[what]


def forget(*tables: DataFrame) -> None:
    """Delete tables made by save() that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows fit the limit, else df, which Spark then joins by shuffle. rows: their number or a bound; else they are counted, if save() hasn't."""
    if rows is None:
        rows = rows_in(df) if "rows" in getattr(df, "_counted", {}) else df.count()
    return F.broadcast(df) if rows * row_bytes <= limit else df.hint("merge")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null has no remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) from the first 13 hex digits of the parts' MD5; equal parts give equal values."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Python worker holds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def parts_for(n: int, each: int) -> int:
    return max(1, math.ceil(n / each))
