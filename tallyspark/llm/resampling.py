"""Importance resampling of documents towards the distribution of a target table.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII; features are all runs of 1 to `n` consecutive words, hashed into buckets. The counts of documents by bucket are
kept as blocks of a sparse matrix in compressed rows (CSR), one Parquet row a block: column sums give the documents' distribution, those of the target's matrix the
target's. The gain of a bucket is the logarithm of the smoothed ratio of both; the sparse product of the matrix and the gains, over a document's number of features, is
its weight. A Gumbel number from a hash of seed and identifier is added, and the highest scores are drawn, which samples without replacement in proportion to the weights.

Ranks come without a task that sees all: scores are range-partitioned and sorted, a row's rank is its place in the partition behind the rows of the partitions before. What
goes to the driver and to each task are numbers by bucket (a parameter, at most `MOST_BUCKETS`) and one count a partition.

Cases. A null or empty text has no features and weight 0. A null identifier hashes as `null` and comes last among equal scores. Repeated identifiers draw the same
number; of rows equal in score and identifier that with fewer features comes first. Very long texts are counted in pieces. An empty table, of documents or target, gives its result by the
same formulas. Other columns pass by `resample`; `scores` reads the two named columns only.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import every, forget, save, short_batches

BUCKETS, WORDS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
MOST_BUCKETS = 1 << 20
#: A block ends at so many documents or stored counts; a text is split into words in pieces of so many bytes.
BLOCK_ROWS, BLOCK_COUNTS, PIECE = 2048, 1 << 19, 1 << 20
#: Features whose bucket a task remembers.
REMEMBERED = 200_000
#: What words are made of, in UTF-8: all else becomes a space.
TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
CSR = "n_features array<bigint>, starts binary, buckets binary, counts binary"


def feature_counts(raw: bytes, n: int = 1) -> Counter:
    """Features of a text in UTF-8, with their counts. The text is split in pieces that end between words."""
    text, found, carry, at = raw.translate(TO_WORDS), Counter(), [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        words = text[at:end].split()
        if n == 1:
            found.update(words)
        else:
            joined = carry + words
            for k in range(1, n + 1):
                # a run that ends within this piece; those that end in the carry were counted before
                found.update(b" ".join(joined[i - k : i]) for i in range(max(k, len(carry) + 1), len(joined) + 1))
            carry = joined[-(n - 1) :]
        at = end
    return found


class Hasher:
    """Buckets of features, remembered."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def row(self, features: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a document, ascending, and its counts in them."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        at = np.empty(len(features), dtype=np.int64)
        for i, f in enumerate(features):
            b = known.get(f)
            if b is None:
                b = known[f] = zlib.crc32(f) % self.buckets
            at[i] = b
        buckets, where = np.unique(at, return_inverse=True)
        return buckets, np.bincount(where, weights=np.fromiter(features.values(), dtype=np.float64, count=len(features)), minlength=len(buckets)).astype(np.int64)


def matrix(docs: DataFrame, buckets: int = BUCKETS, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text", name: str = "csr") -> DataFrame:
    """The table of CSR blocks: ids, n_features, starts, buckets, counts (little-endian 32-bit numbers, 64-bit for counts)."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must lie between 1 and {MOST_BUCKETS}")
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for b in batches:
            at, sizes, held, number = 0, [], [], 0

            def block(at: int) -> pa.RecordBatch:
                starts = np.cumsum([0, *[len(x) for x, _ in held]]).astype("<u4")
                parts = [np.concatenate([x[k] for x in held]).astype(t).tobytes() for k, t in ((0, "<u4"), (1, "<u8"))]
                ids = b.column("id").slice(at, len(held))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), v) for v in (ids, pa.array(sizes, pa.int64()))]
                return pa.RecordBatch.from_arrays([*lists, *[pa.array([v], pa.binary()) for v in (starts.tobytes(), *parts)]], ["ids", "n_features", "starts", "buckets", "counts"])

            for i, raw in enumerate(b.column("text").to_pylist()):
                row = hasher.row(feature_counts(raw or b"", n))
                held.append(row)
                sizes.append(int(row[1].sum()))
                number += len(row[0])
                if len(held) == BLOCK_ROWS or number >= BLOCK_COUNTS:
                    yield block(at)
                    at, sizes, held, number = i + 1, [], [], 0
            if held:
                yield block(at)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return save(rows.mapInArrow(run, f"ids array<{kind}>, {CSR}"), name)


def column_sums(csr: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: added per task, then by bucket; one number a bucket comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for at, n in zip(b.column("buckets").to_pylist(), b.column("counts").to_pylist()):
                np.add.at(total, np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(n, "<u8").astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in csr.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of both distributions, one added to each bucket; floored."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weights(csr: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_features, weight: the matrix times the gains, over the features; floored, 0 without features."""
    shared = csr.sparkSession.sparkContext.broadcast(gain)
    kind = csr.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                starts, at, n = (np.frombuffer(b.column(c)[i].as_py(), t).astype(np.int64) for c, t in (("starts", "<u4"), ("buckets", "<u4"), ("counts", "<u8")))
                size = b.column("n_features")[i].values.to_numpy(zero_copy_only=False)
                before = np.concatenate([[0], np.cumsum(shared.value[at] * n)])
                total = before[starts[1:]] - before[starts[:-1]]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(size, pa.int64()), pa.array(np.where(size > 0, total // np.maximum(size, 1), 0), pa.int64())], ["id", "n_features", "weight"])

    return csr.mapInArrow(run, f"id {kind}, n_features long, weight long")


def ranked(rows: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """rows with rank (from 1) in an order of all, and their number. Equal rows are parted by a salt, so no range is one key's."""
    order = [*order, "__salt"]
    rows = rows.withColumn("__salt", (F.monotonically_increasing_id() % 251).cast("short"))
    # the number's upper bits are the partition's, the lower 33 count its rows
    placed = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__salt").withColumn("__at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    of_part = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    out = placed.withColumn("__part", part).join(F.broadcast(of_part), "__part").withColumn("rank", F.col("__before") + place + 1)
    return out.drop("__part", "__before", "__at"), before


def scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, n: int = WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Per row of docs: id, n_features, weight, score, rank (null where it isn't drawn). target: a table of texts. percent: how many of the documents of enough words are drawn.

    The rule of enough words looks at features where n is 1, else at the words themselves.
    """
    own = matrix(docs, buckets, n, id_col, text_col)
    theirs = matrix(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), buckets, n, "id", "text", "csr-target")
    gain = gains(column_sums(own, buckets), column_sums(theirs, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = save(weights(own, gain).withColumn("score", F.col("weight") + gumbel), "weights")
    forget(own, theirs)
    # n words have n + (n - 1) + ... features, so the number of features tells the number of words
    least = sum(max(0, least_words - k) for k in range(n))
    enough = F.col("n_features") >= least
    placed, number = ranked(rows.filter(enough), [F.desc("score"), F.col("id").asc_nulls_last(), "n_features"], "ranked")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= percent * number // 100, F.col("rank")))
    return placed.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of docs, with all their columns. Rows are drawn by identifier: of a repeated one all rows are in the result if one is drawn."""
    drawn = scores(docs, target, id_col=id_col, **how).filter("rank is not null").select(F.col("id").alias("__id")).distinct()
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").select(*every(docs))
