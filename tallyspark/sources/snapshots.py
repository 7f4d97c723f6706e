"""Readers for price snapshots and nutrition files: delimited text, archives, JSON lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t", "|")


def detect_delimiter(line: str) -> str:
    """The delimiter that occurs most in a header outside quotes; the first listed of those that tie."""
    plain, quoted = [], False
    for c in line.lstrip("﻿"):
        quoted ^= c == '"'
        if not quoted:
            plain.append(c)
    text = "".join(plain)
    return max(DELIMITERS, key=lambda d: (text.count(d), -DELIMITERS.index(d)))


def clean_header(name: str) -> str:
    """Without byte-order mark, quotes and outer blanks; inner blanks become underscores."""
    return "_".join(name.lstrip("﻿").strip().strip('"').lower().split())


def price(x: Column, blank: float | None = None) -> Column:
    """A price with a decimal point or comma; blank gives `blank`, anything else that isn't a number null."""
    text = F.trim(F.coalesce(x, F.lit("")))
    return F.when(text == "", F.lit(blank).cast("double")).otherwise(F.regexp_replace(text, ",", ".").try_cast("double"))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Text columns by cleaned header, with _malformed: the raw line of a row with too few or too many cells. The delimiter is taken from one line."""
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0] if first else ""
    delimiter = delimiter or detect_delimiter(header)
    import csv

    names = [clean_header(c) for c in next(csv.reader([header.lstrip("﻿")], delimiter=delimiter), [])]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_malformed", T.StringType())])
    # a row is malformed by all its cells, so none are pruned before that is known
    return spark.read.option("columnPruning", "false").csv(path, sep=delimiter, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed", quote='"', escape='"', enforceSchema=True)


def snapshot_rows(raw: DataFrame, snapshot_date: str, source: str) -> DataFrame:
    """Prices parsed (blank retail null, blank promotion 0), the row's identity hashed, and why a row is rejected, if it is."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    reason = F.when(F.col("_malformed").isNotNull(), "malformed").when(text("locality_code") == "", "blank_locality").when(text("product_code") == "", "blank_code")
    product = F.sha2(F.concat_ws("|", *[text(c) for c in ("locality_code", "store_name", "product_code", "category_code")]), 256)
    out = raw.withColumn("reject_reason", reason).withColumn("source_product_id", product).withColumn("snapshot_id", F.sha2(F.concat_ws("|", F.lit(snapshot_date), product), 256))
    return out.withColumn("retail_price", price(F.col("retail_price"))).withColumn("promo_price", price(F.col("promo_price"), 0.0)).withColumn("snapshot_date", F.lit(snapshot_date)).withColumn("source_file_name", F.lit(source)).drop("_malformed")


def ingest_counts(rows: DataFrame) -> DataFrame:
    """Imported, unique and duplicate rows, and rejects by reason, in one pass and one join of single rows."""
    kept = F.col("reject_reason").isNull()
    return rows.agg(F.count_if(kept).alias("imported_rows"), F.countDistinct(F.when(kept, F.col("snapshot_id"))).alias("unique_rows"), (F.count_if(kept) - F.countDistinct(F.when(kept, F.col("snapshot_id")))).alias("duplicate_rows"), F.count_if(F.col("reject_reason") == "malformed").alias("malformed_rows"), F.count_if(~kept).alias("rejected_rows"))


def entry_parts(name: Column) -> tuple[Column, Column]:
    """Chain and number of an archive's entry, as in "Some chain_123.csv"."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(stem, r"[_-]?\d+$", ""), "_", " ")), F.regexp_extract(stem, r"(\d+)$", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("csv", "tsv", "txt")) -> DataFrame:
    """Lines of the text entries of ZIP archives: archive, entry, line_no, line. An archive is one task's work; its entries stream."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.rsplit(".", 1)[-1].lower() not in extensions:
                            continue
                        with z.open(name) as raw:
                            rows = []
                            for i, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace")):
                                rows.append((path, name, i, line.rstrip("\r\n")))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "entry", "line_no", "line"])
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=["archive", "entry", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lines, "archive string, entry string, line_no int, line string")


def latest_partition(spark: SparkSession, root: str, today: str, days: int = 7, key: str = "snapshot_date") -> str | None:
    """The latest day's folder at most `days` back, by looking at folder names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [n.split("=", 1)[1] for n in names if n.startswith(f"{key}=")]
    oldest = str(pd.Timestamp(today) - pd.Timedelta(days=days))[:10]
    return max((f for f in found if oldest <= f <= today), default=None)


def export_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json_lines(spark: SparkSession, path: str, schema: str, key: list[str], order: str) -> DataFrame:
    """Read back and keep the last row of each key."""
    rows = spark.read.schema(schema).json(path)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def nutrient_import(foods: DataFrame, amounts: DataFrame, whitelist: list[int]) -> tuple[DataFrame, DataFrame]:
    """The rows taken, and counts of those skipped by the first reason: not a macro, no amount, unknown food."""
    known = foods.filter(F.col("food_id").isNotNull()).select("food_id").distinct().withColumn("__known", F.lit(True))
    rows = amounts.join(known, "food_id", "left")
    reason = F.when(~F.coalesce(F.col("nutrient_id").isin(whitelist), F.lit(False)), "not_macro").when(F.col("amount").isNull(), "no_amount").when(F.col("__known").isNull(), "unknown_food")
    rows = rows.withColumn("skip_reason", reason).drop("__known")
    return rows.filter("skip_reason is null").drop("skip_reason"), rows.groupBy(F.coalesce("skip_reason", F.lit("imported")).alias("outcome")).agg(F.count("*").alias("rows"))
