"""The corpus pipeline: stages from the documents table to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, with any further ones it has, whatever their names.

Cases. An empty table gives empty results. Whole texts are read, however long. Rows are the documents: identifiers may be null or repeated. What that, and null
or empty texts, mean is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, langid, mixing, ngram_join, packing
from tallyspark.llm.common import every, forget, save
from tallyspark.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject, or that have no letter (null and empty texts too), go. The models learn from docs' own
    labels; without any, all go. Equal texts share their fate, whatever their identifiers."""
    model = langid.train(docs)
    whole = docs.select(F.struct(*every(docs)).alias("row"), "text")
    return langid.identify(whole, model).filter("not rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, one row stays: the one of the smallest doc_id, of a null one only where there is no other. Null texts are empty ones."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard of 0.8 or more, one row stays: of the smallest doc_id, of a null one only where
    there is no other. Texts without words link with nothing and stay."""
    return ngram_join.keep_one_of_each(docs, width=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null sources are one source; sources without words are not taken."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of 1024 tokens. A text that is null or empty is the closing id alone."""
    return packing.pack(docs, vocabulary())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]

#: The first stage is a statistical model and the last a search, so SQL can't state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = save(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            forget(docs)
        docs = kept
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
