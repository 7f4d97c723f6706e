"""A content-addressed archive of WARC records.

Two tables make the archive. payloads: key (SHA-256), variant, payload; each payload's bytes are stored once. headers:
one row per record with its exact header block, the key and variant of its payload, and what it is. A record's bytes are its
header block, a blank line, the payload (none in a revisit) and two line ends; they come back by a join. A key is believed only after the
bytes of every record under it are compared with those stored; where they differ, the payload is stored as a variant.

Cases. A null payload is an empty one. Of equal payloads the smallest identifier is the response (a null identifier sorts
last), and of rows repeated with one identifier one is. Payloads of less than min_revisit bytes are all responses. A null
URL gives a record without target; line ends in a URL, which a header can't hold, are escaped in the header, and the URL as given stays beside it. An empty input gives empty tables. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, save, scratch_path, short_batches, small

#: Records of one payload that are compared or rebuilt in one place.
RECORDS_PER_SALT = 500
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload):
    """Column: the bare upper-case base32 SHA-1, from five hex digits (20 bits) to four letters at a time."""
    hexed = F.sha1(payload)
    letters = F.array(*[F.lit(x) for x in BASE32])
    parts = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        parts += [F.element_at(letters, F.shiftright(bits, s).bitwiseAND(31) + 1) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _salted(rows: DataFrame, stored: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows (with `rows` of the same key) to one stored row per key; a hot key's rows go to many places."""
    salts = F.ceil(F.col("group_rows") / RECORDS_PER_SALT).cast("int")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    stored = stored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("group_rows") / RECORDS_PER_SALT).cast("int") - 1))).drop("group_rows")
    return rows.join(stored, [*on, "salt"], how).drop("salt")


class Archive:
    """headers and payloads, in the shared store under path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payloads")

    def records(self) -> DataFrame:
        """Every record's id, url as given, record_type, refers_to, header, payload (of the response for a revisit) and record, its exact bytes."""
        h = self.headers
        joined = _salted(h, self.payloads, ["key", "variant"])
        body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        record = F.concat("header", F.lit(b"\r\n"), body, F.lit(b"\r\n\r\n"))
        return joined.select("id", "url", "record_type", "refers_to", "header", "payload", record.alias("record"))


def header_block(rid, url, kind, refers, length, digest):
    """Column: the header block of a record, as bytes."""
    uid = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", uid(rid)),
        F.when(url.isNull(), "").otherwise(line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uid(refers)))).otherwise(""),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.when(kind == "response", length).otherwise(0).cast("string")),
    ).cast("binary")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, key=None, path: str | None = None) -> Archive:
    """Write pages as an archive. key: from payload bytes to the address (SHA-256); only tests shorten it."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc-archive")
    key = key or (lambda payload: F.unhex(F.sha2(payload, 256)))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("key", key(F.col("payload")))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    # one spool of the batch, from which every later step reads the same row numbers
    rows = save(rows, "warc-spool")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    slim = rows.select("id", "url", "key", "row", "bytes", "digest")
    groups = save(slim.groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("group_rows")), "warc-groups", narrow=True)
    many = groups.filter("group_rows > 1")
    n_many = many.count()
    several = rows.join(small(many.select("key", "first", "group_rows"), 120, n_many), "key")
    stored = several.filter(F.col("row") == F.col("first.row")).select("key", "group_rows", F.col("payload").alias("stored"))
    differ = _salted(several.select("key", "row", "id", "payload", "group_rows"), stored, ["key"]).filter(F.col("payload") != F.col("stored"))
    differ = save(differ.select("key", "row", "id", F.sha2("payload", 512).alias("body"), F.lit(0).alias("zero")), "warc-differ", narrow=True)
    # payloads of their own need no group; the rest meet theirs, broadcast where these are few
    base = slim.join(small(many.select("key", "first", "group_rows"), 120, n_many), "key", "left")
    base = base.withColumn("first", F.coalesce("first", F.struct(F.col("id").isNull().alias("none"), "id", "row"))).withColumn("group_rows", F.coalesce("group_rows", F.lit(1).cast("long"))).withColumn("variant", F.lit(""))
    apart = differ.count()
    if apart:
        # the address was shared by unlike payloads: those apart from the stored one become variants, by a second digest
        own = differ.groupBy("key", "body").agg(F.min(first).alias("own"), F.count("*").alias("own_rows"))
        own = differ.join(own, ["key", "body"]).select("row", "body", "own", "own_rows")
        lost = differ.groupBy("key").agg(F.count("*").alias("lost"))
        base = base.join(own, "row", "left").join(lost, "key", "left")
        mine = F.col("own").isNotNull()
        base = base.withColumn("variant", F.coalesce("body", F.lit(""))).withColumn("group_rows", F.when(mine, F.col("own_rows")).otherwise(F.col("group_rows") - F.coalesce("lost", F.lit(0))))
        base = base.withColumn("first", F.when(mine, F.col("own")).otherwise(F.col("first")))
    response = (F.col("bytes") < min_revisit) | (F.col("row") == F.col("first.row"))
    kind = F.when(response, "response").otherwise("revisit")
    refers = F.when(~response, F.col("first.id"))
    headers = base.withColumn("record_type", kind).withColumn("refers_to", refers)
    headers = headers.withColumn("header", header_block(F.col("id"), F.col("url"), F.col("record_type"), F.col("refers_to"), F.col("bytes"), F.col("digest")))
    headers.select("id", "row", "key", "variant", "group_rows", "record_type", "refers_to", "url", "header").write.parquet(f"{path}/headers")
    body = rows.select("row", "key", "payload")
    if apart:
        store = base.filter(F.col("row") == F.col("first.row")).select("row", "variant", "group_rows")
        body = body.join(store, "row")
    else:
        extra = save(base.filter(F.col("row") != F.col("first.row")).select("row"), "warc-extra", narrow=True)
        body = body.join(small(extra, 16), "row", "left_anti").join(small(many.select("key", "group_rows"), 60, n_many), "key", "left")
        body = body.withColumn("variant", F.lit("")).withColumn("group_rows", F.coalesce("group_rows", F.lit(1).cast("long")))
    body.select("key", "variant", "group_rows", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    forget(rows, groups, differ)
    return Archive(spark, path)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the body of one record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(CRLF)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]}")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length and its bytes disagree")
    return fields, rest[:n]


def read_back(archive: Archive, id_type: str = "bigint") -> DataFrame:
    """Parse the rebuilt records: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Length and digest are those of the payload read; verified says that they agree with the record's own header.
    """
    short_batches(archive.spark, 500)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, refers, payload, record in zip(b["id"], b["refers_to"], b["payload"], b["record"]):
                fields, body = parse_record(bytes(record))
                kind = fields["WARC-Type"]
                data = body if kind == "response" else bytes(payload)
                digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
                out.append((rid, len(data), digest, kind, refers, fields["WARC-Payload-Digest"] == f"sha1:{digest}"))
            frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"}) if id_type == "bigint" else frame

    schema = f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}, verified boolean"
    return archive.records().select("id", "refers_to", "payload", "record").mapInPandas(parse, schema)
