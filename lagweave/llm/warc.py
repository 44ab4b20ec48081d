"""Content-addressed WARC archive: payload bytes once by digest, exact headers apart, records rebuilt by a join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, new_path, shared_dir, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(sha1: Column) -> Column:
    """Upper-case base32 of 40 hex digits: every 5 digits are 20 bits, 4 letters."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header(kind: Column, page_id: Column, uri: Column, sha1: Column, size: Column, refers: Column, date: str) -> Column:
    """The record's header block, up to and with its blank line. CR and LF in a URI become spaces, as fields are lines."""
    clean = F.regexp_replace(F.coalesce(uri, F.lit("")), "[\r\n]+", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_uri(page_id)),
        F.concat(F.lit(f"WARC-Date: {date}{CRLF}WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_uri(refers), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(size).cast("string"), F.lit(CRLF * 2)),
    ]
    return F.concat_ws(CRLF, *lines)


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write a record per row to path/heads (rid, page_id, digest, header) and path/payloads (digest, payload).

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least least_bytes, that with
    the largest page_id (null the smallest; of equal ids one) is the response and the others revisit it; smaller ones
    are all responses. A payload is stored once per SHA-256: tasks combine their own copies first, so a hot payload
    moves as one row a task, and each payload crosses one shuffle. An empty table makes an empty archive.
    """
    body = F.coalesce(col(html), F.lit("")).cast("binary")
    page = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), body.alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256))
    heads = page.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("rid"))
    heads = stored(heads, "warc-pages")
    page.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    top = heads.groupBy("digest").agg(F.max(F.struct("page_id", "rid")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    joined = heads.join(stored(top, "warc-tops"), "digest", "left")  # two tables: the rows of a hot digest can be split
    first = F.col("top").isNull() | (F.col("size") < least_bytes) | (F.col("top.rid") == F.col("rid"))
    kind = F.when(first, F.lit("response")).otherwise(F.lit("revisit"))
    head = header(kind, F.col("page_id"), F.col("url"), base32_of_hex(F.col("sha1")), F.col("size"), F.col("top.page_id"), date)
    joined.select("rid", "page_id", "digest", head.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/heads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads whose bytes still have the digest they are stored under; others make the read fail."""
    blobs = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")
    return blobs.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(bad))


def field(name: str) -> Column:
    return F.regexp_extract("header", f"\n{name}: ([^\r\n]*)", 1)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records as they were: page_id, header, payload and `record`, the bytes of the WARC record."""
    heads = spark.read.schema("rid long, page_id long, digest string, header string").parquet(f"{path}/heads")
    both = heads.join(payloads(spark, path), "digest", "left")
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page_id", "header", "payload", F.concat(F.col("header").cast("binary"), block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the record as it is rebuilt: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A record whose header states another digest than its payload has, or another length than its block, makes the
    read fail.
    """
    kind, refers = field("WARC-Type"), F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1)
    found = records(spark, path).select("page_id", "header", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), (F.octet_length("record") - F.octet_length("header") - 4).alias("block"))
    right = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (field("Content-Length").cast("long") == F.col("block")) & (F.col("block") == F.when(kind == "revisit", 0).otherwise(F.col("payload_bytes")))
    return found.select(
        "page_id",
        F.when(right, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record doesn't fit its payload")).cast("long")).alias("payload_bytes"),
        "payload_digest",
        kind.alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """The archive as plain .warc text files in `out`: payloads are UTF-8, so Spark's text writer keeps their bytes."""
    rows = records(spark, path)
    rows.select(F.expr("decode(substring(record, 1, octet_length(record) - 4), 'UTF-8')").alias("value")).write.option("lineSep", CRLF * 2).text(out)


def parse_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc files by their Content-Length: file, offset, header, payload. A file must fit a task's memory."""

    def parse(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows, at = [], 0
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    head = content[at:end]
                    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    rows.append((name, at, head.decode(), content[end : end + size]))
                    at = end + size + 4
                yield pd.DataFrame(rows, columns=["file", "offset", "header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, offset long, header string, payload binary")


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write an archive of the pages in the shared folder, rebuild its records and return what they say."""
    spark = pages.sparkSession
    shared_dir(spark)
    path = new_path(spark, "warc-archive")
    write_archive(pages, path, **options)
    return read_index(spark, path)
