"""The registered queries op1 to op13: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import ann, exact_dedup, langid, line_dedup, mixing, ngram_join, packing, quality, resampling, sharding, sort_means, url_filter, warc
from tallyspark.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public tokenizer file; outside this box, pass another path to packing.pack."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write_archive(table(spark, sf_dir, "pages")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    free = lambda df: df.filter(crc_mod("doc_id", 4) != 2)
    model = quality.train(free(docs), free(labels))
    out = quality.score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "difference")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id").select("doc_id", "slot", "shard")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_warc_archive": op3_warc_archive,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_source_mix": op5_source_mix,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_quality": op7_quality,
        "op8_ngram_join": op8_ngram_join,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "op11_sort_means": op11_sort_means,
        "op12_resampling": op12_resampling,
        "op13_line_dedup": op13_line_dedup,
    }
