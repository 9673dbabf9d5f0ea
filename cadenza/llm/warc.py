"""Content-addressed WARC archive.

A record is written per page.  The archive is two Parquet tables in one folder:
``payloads`` holds every distinct payload once, by SHA-256, and ``headers`` holds
the exact header bytes of every record.  Reading back joins the two, rebuilds the
records byte for byte, and computes the digests again from what was stored.

Digests are verified when written: all payloads of one digest must agree in
length and in a second, independent hash, or the job fails.

Edge cases: null html is an empty payload; payloads under ``least`` bytes are
always responses; rows that repeat the smallest page id of a payload are all
responses; a null page id never is the smallest, and if no id is known all are
responses; an empty table gives an empty archive; ids of any type that casts from a
string are read back; extra columns are not read.  Joins are plain equi-joins on the digest,
so that adaptive execution can split a hot payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import read, shared_dir

LEAST = 100
DATE = "1970-01-01T00:00:00Z"


def _payload(html_col: str) -> Column:
    return F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")


def _header(kind: Column, length: Column) -> Column:
    """Exact bytes before the payload: WARC headers, then the HTTP header block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    stored = F.when(kind == "response", length).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_page").cast("string"), F.lit(">"))),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.length(http) + stored).cast("string")),
        F.lit("\r\n"),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), http), "UTF-8")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> str:
    """Write the two tables; returns the folder."""
    payload = _payload(html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.length(payload).cast("long").alias("n"),
        F.xxhash64(payload).alias("second"),
    )
    differ = (F.min("second") != F.max("second")) | (F.min("n") != F.max("n"))
    firsts = rows.groupBy("digest").agg(
        F.when(differ, F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast(rows.schema["page_id"].dataType))
        .otherwise(F.min("page_id"))
        .alias("first_page")
    )
    kind = F.when(
        (F.col("n") >= least) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")), "revisit"
    ).otherwise("response")
    (
        rows.join(firsts, "digest", "left")
        .select("page_id", "digest", _header(kind, F.col("n")).alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/headers")
    )
    (
        pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
        .groupBy("digest")
        .agg(F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/payloads")
    )
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, digest, header, payload (full, also of revisits) and record (the exact bytes)."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    kind = F.regexp_extract(F.decode("header", "UTF-8"), "\r\nWARC-Type: (\\w+)\r\n", 1)
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return (
        headers.join(payloads, "digest", "left")
        .withColumn("record_type", kind)
        .withColumn("record", F.when(F.col("record_type") == "response", F.concat("header", "payload", end)).otherwise(F.concat("header", end)))
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read them back, and tell what was found in the archive."""
    folder = write_archive(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/cadenza/warc-{uuid.uuid4().hex}")
    found = read_archive(spark, folder)
    id_type = spark.read.parquet(f"{folder}/headers").schema["page_id"].dataType.simpleString()
    head = F.decode("header", "UTF-8")
    digest = F.sha2("payload", 256)
    return found.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(digest == F.regexp_extract(head, "\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)\r\n", 1), digest)
        .otherwise(F.raise_error(F.lit("stored payload does not match its digest")))
        .alias("payload_digest"),
        "record_type",
        F.expr(f"try_cast(nullif(regexp_extract(decode(header, 'UTF-8'), '\\r\\nWARC-Refers-To: <urn:page:([^>]*)>', 1), '') AS {id_type})").alias("refers_to"),
    )


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_page FROM p GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= {LEAST} AND f.first_page IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= {LEAST} AND f.first_page IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_page THEN f.first_page END AS refers_to
FROM p JOIN f ON p.payload_digest = f.payload_digest
"""
