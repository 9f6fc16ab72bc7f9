"""WARC records in a content-addressed archive.

An archive is a folder of two tables. ``payloads`` holds each distinct payload once, under its SHA-256;
``headers`` holds the exact header block of every record and the digest of its full payload. Original
records come back by joining the two. A digest is verified twice: rows that share a SHA-256 must agree in
length and SHA-1 when they are written, and stored bytes are hashed again when they are read.

Of records with equal payloads of at least ``least`` bytes, that with the largest key is a response and
the others are revisits of it; shorter ones are all responses. A record whose key is null is a revisit if
an equal payload has a key, else a response; rows that repeat the largest key are all responses. Null
payloads count as empty, a null URL gives no target line, and line breaks in URLs are escaped. Extra
columns don't enter the archive. An empty table gives an archive without records.

Payload bytes are shuffled once, after a map-side pass has dropped the copies that a task sees; all
other shuffles carry digests and headers. Joins on digests have both sides in tables, so that adaptive
execution can split a digest that many records share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
RECORD = "urn:x-record:"
LEAST = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def write_archive(records: DataFrame, path: str, key: str, url: str, payload: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of ``records`` (``payload``: string or binary) under ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    hashed = records.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n": F.octet_length("payload")})
    seen = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("key").alias("keeper"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "sha1") for f in (F.min, F.max)))
    clash = (F.col("min_n") != F.col("max_n")) | (F.col("min_sha1") != F.col("max_sha1"))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest")))).otherwise(F.col("digest")).cast("string")
    seen.select(checked.alias("digest"), "payload", "keeper").write.option("compression", "zstd").parquet(f"{path}/payloads")

    keepers = records.sparkSession.read.parquet(f"{path}/payloads").select("digest", "keeper")
    first = (F.col("n") < least) | F.col("key").eqNullSafe(F.col("keeper"))
    kind = F.when(first, "response").otherwise("revisit")
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", name(F.col("key"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", safe),
        _field("WARC-Refers-To", F.when(~first, name(F.col("keeper")))),
        _field("WARC-Profile", F.when(~first, F.lit(REVISIT))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(first, F.col("n")).otherwise(0).cast("string")),
        F.lit(END),
    )
    hashed.select("key", "url", "digest", "sha1", "n").join(keepers, "digest").select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers, parsed: record_id, record_type, refers_to, url, declared_sha1, content_length, header, digest."""
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda name: F.regexp_extract("header", rf"\r\n{name}: <{RECORD}(-?\d+)>\r\n", 1).try_cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        number("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("declared_sha1"),
        field("Content-Length").cast("long").alias("content_length"),
        "header",
        "digest",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads (digest, payload), each held against its digest."""
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    right = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("stored bytes don't match digest "), F.col("digest"))).cast("string"))
    return stored.select(right.alias("digest"), "payload")


def with_payloads(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each record with its full payload, or with whatever ``payloads`` holds of it; revisits get the payload that they refer to."""
    return headers.join(payloads, "digest", "left")


def exact_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id and record: the exact bytes of each WARC record (without the blank lines that end it)."""
    whole = with_payloads(read_headers(spark, path), read_payloads(spark, path))
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("record_id", F.concat(F.col("header").cast("binary"), block).alias("record"))


def write_files(records: DataFrame, path: str) -> None:
    """Plain WARC files, one for each partition; the text writer passes bytes on as they are."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END * 2).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """header (string) and block (binary) of every record in WARC files; a file is read by one task."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, headers, blocks = content.as_py(), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    header = data[at:end].decode()
                    length = int(next(x.split(":", 1)[1] for x in header.split(END) if x.lower().startswith("content-length:")))
                    headers.append(header)
                    blocks.append(data[end : end + length])
                    at = end + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(blocks, pa.binary())], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, "header string, block binary")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN n < {LEAST} OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < {LEAST} OR page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""
