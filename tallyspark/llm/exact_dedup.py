"""Exact duplicates through a log-structured index of digests. DataFrame functions only.

The rows of a task fill memtables of at most `MEMTABLE` rows. Each is flushed into one of `RUNS` runs, sorted by digest. Compaction merges
the runs of a first batch at once, those of later batches `FAN_IN` at a time, and these again with the level before, up to one level: one row per digest that holds the smallest identifier and the number of
rows. Level and runs have Parquet bloom filters on the digest, by which a look-up of single digests skips row groups; a bitmap filter over the
level's digests of several rows is asked for all rows at once: those that it rules out are alone and need no join with the level. A hit (a
further row of a digest) is confirmed by comparing the bytes of the normalised texts; rows that a digest joined wrongly are
grouped anew by the text itself.

Cases. A null text counts as empty. A null identifier sorts after all others. Of rows repeated with one identifier
and one text, one is kept. Very long texts are hashed and compared whole. Empty input gives an empty result. Only the two named columns are read; others pass by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_BYTES, SPACES, remove, rows_in, save, scratch_path, small

#: Copies of one text that are compared in one place; larger groups are dealt over more places.
COPIES_PER_SALT = 1000
#: Rows of a memtable, runs that a batch is flushed to, and runs that one merge takes.
MEMTABLE, RUNS, FAN_IN = 50_000, 16, 4
#: Bits of the filter for each digest in it.
FILTER_BITS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def whole(sha: Column) -> Column:
    return sha


class DigestIndex:
    """The index's runs and levels lie under one folder of the shared store.

    digest: from the SHA-256 to the key of the index; only tests shorten it, to force false hits.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = whole):
        self.spark, self.path, self.digest = spark, path or scratch_path(spark, "digest-index"), digest
        self.batches: list[DataFrame] = []  # not compacted yet
        self.flushed = self.compacted = 0
        self.level: DataFrame | None = None

    def _write(self, df: DataFrame, at: str, *by: str) -> DataFrame:
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}
        df.write.options(**options).partitionBy(*by).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch. Gives its rows: id, batch and seq (together a row's number), sha, digest, run."""
        sha = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
        rows = docs.select(F.col(id_col).alias("id"), F.lit(self.flushed).alias("batch"), F.monotonically_increasing_id().alias("seq"), sha.alias("sha"))
        # the number's upper bits are the task's, the lower 33 count its rows
        table = F.shiftright("seq", 33) + F.floor(F.col("seq").bitwiseAND(F.lit((1 << 33) - 1)) / MEMTABLE)
        rows = rows.withColumn("digest", self.digest(F.col("sha"))).withColumn("run", F.pmod(table, F.lit(RUNS)).cast("int")).sortWithinPartitions("run", "digest", "id")
        self.batches.append(self._write(rows, f"{self.path}/level0/batch{self.flushed}", "run"))
        self.flushed += 1
        return self.batches[-1]

    def compact(self) -> DataFrame:
        """Merge the runs, and the level before, to digest, keep (the smallest id and row), rows; sorted by digest."""
        if not self.batches:
            return self.level
        keep = F.struct(F.col("id").isNull().alias("none"), "id", "batch", "seq", "sha")
        now, runs = None, RUNS
        for b in self.batches:
            rows = b.select("run", "digest", keep.alias("keep"), F.lit(1).cast("long").alias("rows"))
            now = rows if now is None else now.unionByName(rows)
        # a first batch goes straight to the level; later ones are merged by tiers
        tier, fan = 0, FAN_IN if self.level or len(self.batches) > 1 else RUNS
        while runs > 1:
            runs, tier = -(-runs // fan), tier + 1
            if runs == 1 and self.level:
                now = now.unionByName(self.level.withColumn("run", F.lit(0)))
            group = F.floor(F.col("run") / fan).cast("int").alias("run")
            merged = now.groupBy(group, "digest").agg(F.min("keep").alias("keep"), F.sum("rows").alias("rows")).sortWithinPartitions("run", "digest")
            at = f"{self.path}/level{tier}/{self.compacted}"
            now = self._write(merged, at, "run") if runs > 1 else self._write(merged.drop("run"), at)
            if tier > 1:
                remove(self.spark, f"{self.path}/level{tier - 1}/{self.compacted}")
        self.compacted += 1
        self.level, self.batches = now, []
        return now

    def drop(self) -> None:
        """Delete runs and levels."""
        remove(self.spark, self.path)

    def lookup(self, digest: bytes) -> DataFrame:
        """The level's row of one digest; the bloom filters skip the other row groups."""
        return self.level.filter(F.col("digest") == F.lit(bytearray(digest)))


class Filter:
    """A bitmap over the hashes of digests: says no only to digests that aren't in it. Beyond what may be broadcast it says yes to all."""

    def __init__(self, digests: DataFrame):
        self.n = digests.count()
        self.bits = 1 << max(15, (self.n * FILTER_BITS).bit_length())
        self.small = self.bits // 8 <= BROADCAST_BYTES
        at = self._at(F.col("digest"))
        self.maps = digests.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__map"))

    def _at(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.bits))

    def asked(self, rows: DataFrame) -> DataFrame:
        """rows (with digest) and `maybe`, whether the digest can be in the filter."""
        if not self.small:
            return rows.withColumn("maybe", F.lit(True))
        at = self._at(F.col("digest"))
        out = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).withColumn("__bit", F.bitmap_bit_position(at)).join(F.broadcast(self.maps), "__bucket", "left")
        there = F.expr("cast(conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(__bit % 8 as int))") != 0
        return out.withColumn("maybe", F.coalesce(there, F.lit(False))).drop("__bucket", "__bit", "__map")


def false_hits(docs: DataFrame, many: DataFrame, seen: Filter, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """Rows (id, sha, text) whose text differs from that of the row their digest keeps."""
    groups = many.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.sha").alias("keep_sha"), "rows")
    # numbered as they are read, before any shuffle, so that a task that runs again deals its rows alike
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"), F.monotonically_increasing_id().alias("seq"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("body").cast("binary"), 256))).withColumn("digest", digest(F.col("sha")))
    rows = seen.asked(rows).filter("maybe").join(small(groups, 120, seen.n), "digest").withColumn("salts", F.ceil(F.col("rows") / COPIES_PER_SALT).cast("int"))
    kept = rows.filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))).groupBy("digest", "salts").agg(F.min("body").alias("keep_body"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "seq"), F.col("salts")).cast("int"))
    return rows.join(kept, ["digest", "salt"]).filter(F.col("body") != F.col("keep_body")).select("id", "sha", "digest", "body")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = whole, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, sha (binary SHA-256 of the normalised text). index: a new one, which the result reads."""
    index = index or DigestIndex(docs.sparkSession, digest=digest)
    rows, level = index.flush(docs, id_col, text_col), index.compact()
    many = level.filter("rows > 1")
    seen = Filter(many)
    wrong = save(false_hits(docs, many, seen, digest, id_col, text_col), "false-hits", narrow=True, rows="true")
    rows = seen.asked(rows)
    found = rows.filter("maybe").join(small(many, 160, seen.n), "digest", "left")
    alone = rows.filter("not maybe").withColumn("keep", F.lit(None).cast(level.schema["keep"].dataType)).withColumn("rows", F.lit(None).cast("long"))
    # a digest of one row, which the filter lets through or not, keeps that row
    keep = F.coalesce("keep", F.struct(F.col("id").isNull().alias("none"), "id", "batch", "seq", "sha"))
    got = found.unionByName(alone).withColumn("keep", keep).withColumn("rows", F.coalesce("rows", F.lit(1).cast("long")))
    if not rows_in(wrong):
        got = got.select("id", F.col("keep.id").alias("keep_id"), F.col("rows").alias("group_size"), "batch", "seq", F.col("keep.batch").alias("keep_batch"), F.col("keep.seq").alias("keep_seq"), "sha")
    else:
        # what was joined wrongly leaves its digest's group; those rows group by the bytes of their texts
        first = rows.groupBy("id", "sha").agg(F.min(F.struct("batch", "seq")).alias("at"), F.count("*").alias("same")).select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "at.batch", "at.seq", "same")
        own = wrong.dropDuplicates(["id", "sha"]).join(first, F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")))
        by_text = own.groupBy("sha", "body").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "batch", "seq")).alias("own"), F.sum("same").alias("own_rows")).select(F.col("sha").alias("own_sha"), "own", "own_rows")
        lost = wrong.groupBy("digest").agg(F.count("*").alias("lost"))
        got = got.join(lost, "digest", "left").join(small(by_text, 120), F.col("sha") == F.col("own_sha"), "left")
        ours = F.col("own").isNotNull()
        got = got.select(
            "id",
            F.when(ours, F.col("own.id")).otherwise(F.col("keep.id")).alias("keep_id"),
            F.when(ours, F.col("own_rows")).otherwise(F.col("rows") - F.coalesce("lost", F.lit(0))).alias("group_size"),
            "batch",
            "seq",
            F.when(ours, F.col("own.batch")).otherwise(F.col("keep.batch")).alias("keep_batch"),
            F.when(ours, F.col("own.seq")).otherwise(F.col("keep.seq")).alias("keep_seq"),
            "sha",
        )
    return got.select("id", "keep_id", "group_size", ((F.col("batch") == F.col("keep_batch")) & (F.col("seq") == F.col("keep_seq"))).alias("kept"), "sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    index = DigestIndex(docs.sparkSession)
    repeats = F.col("id").eqNullSafe(F.col("keep_id"))
    groups = save(exact_groups(docs, id_col, text_col, index=index), "exact-groups", narrow=True, gone=~F.col("kept") & ~repeats, again=~F.col("kept") & repeats)
    index.drop()
    gone = groups.filter("not kept").select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), repeats.alias("__again")).distinct()
    again = rows_in(groups, "again")
    sha = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    same = (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__own_sha") == F.col("__sha"))
    keyed = docs.withColumn("__own_sha", sha)
    out = keyed.join(small(gone.filter("not __again"), 80, rows_in(groups, "gone")), same, "left_anti").drop("__own_sha")
    if again:  # rows repeated with identifier and text: the key alone can't tell them apart, so one of each is taken
        one = gone.filter("__again")
        rest = out.withColumn("__own_sha", sha).join(small(one, 80, again), same, "left_anti").drop("__own_sha")
        repeated = keyed.join(small(one, 80, again), same, "left_semi")
        return rest.unionByName(repeated.dropDuplicates([id_col, "__own_sha"]).drop("__own_sha"))
    return out
