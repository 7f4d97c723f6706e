"""Lines that other documents have too: of each, the document with the smallest identifier keeps its own.

A text is split at line feeds. A line's key is the line without white space at both ends, A-Z lower-cased; keys of fewer than `LEAST` code points are left alone. Keys
are hashed to 128 bits of SHA-256, and the rows (hash, identifier, text, position) are range-partitioned and sorted by all of these, so a key's rows lie in order,
over several partitions where they are many. Each partition is streamed once: the first row of a run of equal hashes names its owner, rows of other
identifiers are dropped. A partition's first run may continue the one before it; such rows wait, beside the partition's ends (two rows a partition, which is
all that the driver sees), until the owners have been carried over the ends. What comes back are bitmaps of the kept lines, compressed, one for each document that
loses a line; texts don't travel until the bitmaps are applied.

Cases. A null or empty text is one empty line. A null identifier comes last. Rows of one identifier are one document for what is found in two documents: they keep or lose a line
together; their bitmaps are told apart by the digest of the text, so repeated rows lose the same lines. Very long texts are read whole. An empty table gives an empty
result. Other columns pass by `drop_lines` with their names; the others read the two named columns only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import every, forget, save, short_batches

LEAST = 10
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lines that go to Spark at once.
AT_ONCE = 50_000


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The key of a line in UTF-8; None if it has too few code points."""
    key = line.strip(SPACE).translate(LOWER)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def digest_of(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """key, id, text (digest), pos, salt: a row for each line that could be dropped."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, places, at = [], [], [], []

            def flush() -> pa.RecordBatch:
                cells = [pa.array(keys, pa.binary()), b.column("id").take(pa.array(at, pa.int64())), pa.array(texts, pa.binary()), pa.array(places, pa.int32())]
                return pa.RecordBatch.from_arrays(cells, ["key", "id", "text", "pos"])

            for i, raw in enumerate(b.column("text").to_pylist()):
                digest = None
                for pos, line in enumerate(raw.split(b"\n") if raw else ()):
                    key = key_of(line, least)
                    if key is None:
                        continue
                    digest = digest or digest_of(raw)
                    keys.append(digest_of(key))
                    texts.append(digest)
                    places.append(pos)
                    at.append(i)
                    if len(keys) == AT_ONCE:
                        yield flush()
                        keys, texts, places, at = [], [], [], []
            if keys:
                yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # the salt parts repeated rows, so that a range can end between them
    return rows.mapInArrow(run, f"key binary, id {kind}, text binary, pos int").withColumn("salt", (F.monotonically_increasing_id() % 251).cast("short"))


def _run_starts(key: pa.Array) -> np.ndarray:
    """Whether each row's key differs from that of the row before; the first row's is left to the caller."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    return new


def _differs(id: pa.Array, owner: pa.Array) -> np.ndarray:
    """Whether identifiers differ, a null from all but a null."""
    same = pc.or_(pc.fill_null(pc.equal(id, owner), False), pc.and_(pc.is_null(id), pc.is_null(owner)))
    return ~same.to_numpy(zero_copy_only=False)


def _streamed(lines: DataFrame) -> DataFrame:
    """kind drop: a line (id, text, pos) that is dropped. kind wait: the same for rows of the first run of partition `part`, if their owner isn't the one that the
    partition shows. kind first and last: the ends of a partition, with key and owner."""
    kind = lines.schema["id"].dataType.simpleString()
    schema = f"kind string, part int, key binary, id {kind}, text binary, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last_key, owner, leading = None, None, True

        def rows(kind: str, key: pa.Array, id: pa.Array, text: pa.Array, pos: pa.Array) -> pa.RecordBatch:
            n = len(id)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32()), key, id, text, pos], ["kind", "part", "key", "id", "text", "pos"])

        def end(kind: str, key: pa.Array, id: pa.Array) -> pa.RecordBatch:
            return rows(kind, key, id, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()))

        for b in batches:
            if not b.num_rows:
                continue
            key, id = b.column("key"), b.column("id")
            new = _run_starts(key)
            if last_key is None:
                yield end("first", key.slice(0, 1), id.slice(0, 1))
                owner = id.slice(0, 1)
                new[0] = False
            else:
                new[0] = key[0].as_py() != last_key
            # owners: of the run that goes on from before, then of each run that starts here
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)) + 1, 0))
            owners = pa.concat_arrays([owner, id]).take(pa.array(start))
            waits = (np.cumsum(new) == 0) & leading
            drop = _differs(id, owners)
            for kind, mask in (("drop", drop & ~waits), ("wait", waits)):
                if mask.any():
                    got = b.filter(pa.array(mask))
                    yield rows(kind, pa.nulls(got.num_rows, pa.binary()), got.column("id"), got.column("text"), got.column("pos"))
            leading = leading and not new.any()
            owner, last_key = owners.slice(len(owners) - 1, 1), key[len(key) - 1].as_py()
        if last_key is not None:
            yield end("last", pa.array([last_key], pa.binary()), owner)

    return lines.mapInArrow(run, schema)


def carried(ends: list[tuple]) -> dict[int, tuple]:
    """From (part, first key, first owner, last key, last owner) by part: the owner of the first run of each partition, in a tuple."""
    out, before = {}, None
    for part, key, own, last, last_own in ends:
        goes_on = before is not None and before[0] == key
        out[part] = (before[1] if goes_on else own,)
        before = (last, out[part][0] if last == key else last_own)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, text (the digest of the whole text), pos: the lines that go."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    lines = save(_lines(docs, id_col, text_col, least), "lines")
    order = ["key", F.col("id").asc_nulls_last(), "text", "pos", "salt"]
    found = save(_streamed(lines.repartitionByRange(*order).sortWithinPartitions(*order)), "line-stream")
    forget(lines)
    ends: dict[int, dict] = {}
    for r in found.filter("kind in ('first', 'last')").select("part", "kind", "key", "id").collect():  # two rows a partition
        ends.setdefault(r["part"], {})[r["kind"]] = (bytes(r["key"]), r["id"])
    owners = carried([(p, *e["first"], *e["last"]) for p, e in sorted(ends.items())])
    of_part = spark.createDataFrame([(p, o) for p, (o,) in owners.items()], f"part int, owner {kind}")
    waiting = found.filter("kind = 'wait'").join(F.broadcast(of_part), "part").filter(~F.col("id").eqNullSafe(F.col("owner")))
    out = save(found.filter("kind = 'drop'").select("id", "text", "pos").unionByName(waiting.select("id", "text", "pos")), "dropped-lines")
    forget(found)
    return out


def bitmap(places: list[int]) -> bytes:
    """Bit i of byte i // 8 (the lowest first) is 1 if line i stays; lines beyond stay. Compressed."""
    keep = np.ones(-(-(max(places) + 1) // 8) * 8, dtype=np.uint8)
    keep[places] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def places_of(keep: bytes, n: int) -> set[int]:
    """The lines of n that a bitmap drops."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), bitorder="little")[:n]
    return set(np.flatnonzero(bits == 0).tolist())


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, text (digest), n_dropped, keep: one row for each document that loses a line. A document without a row keeps all."""
    kind = docs.schema[id_col].dataType.simpleString()
    # a document has no more places than lines; equal rows' places are one set, made per task first
    places = dropped_lines(docs, id_col, text_col, least).groupBy("id", "text").agg(F.collect_set("pos").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("places").to_pylist()
            cells = [b.column("id"), b.column("text"), pa.array([len(p) for p in lists], pa.int64()), pa.array([bitmap(p) for p in lists], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["id", "text", "n_dropped", "keep"])

    return save(places.mapInArrow(run, f"id {kind}, text binary, n_dropped long, keep binary"), "line-bitmaps", narrow=True)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """row (all columns of docs), body (the text in UTF-8), keep."""
    maps = keep_bitmaps(docs, id_col, text_col, least).select(F.col("id").alias("__id"), F.col("text").alias("__digest"), "keep")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = docs.select(F.struct(*every(docs)).alias("row"), F.col(id_col).alias("id"), body.alias("body"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("digest"))
    return own.join(maps, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select("row", "id", "body", "keep")


def _kept(body: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and what is left of a text."""
    if keep is None:
        return body.count(b"\n") + 1, 0, body
    lines = body.split(b"\n")
    gone = places_of(keep, len(lines))
    return len(lines), len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of docs: id, n_lines, n_dropped, kept_sha256 (lowercase hex of what is left, in UTF-8)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, gone, hashlib.sha256(left).hexdigest()) for n, gone, left in map(_kept, b.column("body").to_pylist(), b.column("keep").to_pylist())]
            n, gone, sha = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_bitmaps(docs.select(id_col, text_col), id_col, text_col, least)
    return rows.select("id", "body", "keep").mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the texts that are left; null texts stay null."""

    @F.pandas_udf("string")
    def left(body, keep):
        import pandas as pd

        return pd.Series([_kept(bytes(b), None if k is None else bytes(k))[2].decode() for b, k in zip(body, keep)], dtype=object)

    rows = _with_bitmaps(docs, id_col, text_col, least)
    text = F.when(F.col("keep").isNull(), F.col(f"row.{text_col}")).otherwise(left("body", "keep"))
    return rows.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
