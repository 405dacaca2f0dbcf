"""Content-addressed WARC archive.

A payload's bytes are stored once, under their SHA-256, in ``payloads``; ``records`` keeps each
record's exact header block with the digest of its payload. Reading joins the two on the digest,
rebuilds the records byte for byte and checks length and digest of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One row a page: page_id, url, payload (binary), sizes, digests, record_type, refers_to.

    Of records with equal payloads of at least ``min_bytes``, those with the largest page_id are
    responses and the others revisits that refer to it; smaller payloads are always responses, and
    so are rows whose page_id is null. A payload's class is found on (digest, length, page_id)
    alone; a hot payload is combined on the map side.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256), "payload_digest": F.sha1("payload")})
    again = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_sha256", "payload_bytes")
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        .select("payload_sha256", "_first")
    )
    rows = rows.join(again, "payload_sha256", "left")
    revisit = F.col("_first").isNotNull() & (F.col("page_id") < F.col("_first"))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first"))}).drop("_first")


def header_block(page_id: Column, url: Column, record_type: Column, refers_to: Column, digest: Column, length: Column) -> Column:
    """The record's header lines, each ended by CRLF, without the blank line. Control characters in a
    URL would end a line, so they are written percent-encoded; a null URL is ``urn:page:<id>``."""
    name = F.coalesce(page_id.cast("string"), F.lit("null"))
    uri = F.coalesce(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.concat(F.lit("urn:page:"), name))
    is_revisit = record_type == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", record_type), _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        _line("WARC-Date", F.lit(WARC_DATE)), _line("WARC-Target-URI", uri), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(is_revisit, F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))))).otherwise(""),
        _line("Content-Type", F.lit("application/octet-stream")), _line("WARC-Payload-Length", length.cast("string")),
        _line("Content-Length", F.when(is_revisit, "0").otherwise(length.cast("string"))),
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes ``folder/payloads`` (sha256, bytes) and ``folder/records`` (headers, sha256).

    The payload table gets each digest once, whatever number of records share it: equal payloads
    are reduced on the map side before the shuffle. Headers never carry payload bytes.
    """
    planned = plan_records(pages, min_bytes)
    fields = [F.col(c) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")]
    planned.select(header_block(*fields).alias("headers"), "payload_sha256").write.option("compression", "zstd").parquet(f"{folder}/records")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    bodies = pages.select(F.sha2(payload, 256).alias("payload_sha256"), payload.alias("payload"))
    bodies.groupBy("payload_sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records: header fields parsed, ``record`` the rebuilt bytes, ``payload`` the full
    payload (a revisit's too), ``verified`` whether length and SHA-1 are those that the header names. Every record has its
    row, whether its payload verifies or not, or is lost (record null then)."""
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads")
    rows = records.join(payloads, "payload_sha256", "left")
    field = lambda n: F.regexp_extract("headers", rf"\r\n{n}: ([^\r\n]*)\r\n", 1)
    page = lambda n: F.regexp_extract("headers", rf"\r\n{n}: <urn:page:(-?\d+)>\r\n", 1).try_cast("bigint")
    rows = rows.withColumns({
        "record_type": field("WARC-Type"), "page_id": page("WARC-Record-ID"), "refers_to": page("WARC-Refers-To"),
        "target_uri": field("WARC-Target-URI"), "payload_digest": F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")),
        "payload_bytes": field("WARC-Payload-Length").cast("long"),
    })
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rows = rows.withColumn("record", F.concat(F.col("headers").cast("binary"), F.lit(b"\r\n"), body, F.lit(b"\r\n\r\n")))
    good = (F.octet_length("payload") == F.col("payload_bytes")) & (F.sha1("payload") == F.col("payload_digest")) & (F.sha2("payload", 256) == F.col("payload_sha256"))
    return rows.withColumn("verified", F.coalesce(good, F.lit(False)))


def verified_records(spark: SparkSession, folder: str) -> DataFrame:
    """``read_archive``, but a record that doesn't verify ends the job with its id."""
    rows = read_archive(spark, folder)
    error = F.raise_error(F.concat(F.lit("the payload of record "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" doesn't verify"))).cast("boolean")
    return rows.where(F.when(F.col("verified"), F.lit(True)).otherwise(error))


def export_warc(spark: SparkSession, archive: str, folder: str) -> None:
    """Writes the archive's records to WARC files (gzip) under ``folder``, one a partition, byte for byte as rebuilt.
    A record ends with two CRLF, which here is the line separator of Spark's text writer."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)")
    records = verified_records(spark, archive).select(body.cast("string").alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(folder)


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p),
n AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to, chr(13) || chr(10) AS e FROM m),
r AS (SELECT n.*, 'WARC/1.1' || e || 'WARC-Type: ' || record_type || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Date: 2024-01-01T00:00:00Z' || e
  || 'WARC-Target-URI: ' || coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), 'urn:page:' || page_id) || e || 'WARC-Payload-Digest: sha1:' || payload_digest || e
  || CASE WHEN record_type = 'revisit' THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e || 'WARC-Refers-To: <urn:page:' || refers_to || '>' || e ELSE '' END
  || 'Content-Type: application/octet-stream' || e || 'WARC-Payload-Length: ' || payload_bytes || e || 'Content-Length: ' || CASE WHEN record_type = 'revisit' THEN 0 ELSE payload_bytes END || e || e
  || CASE WHEN record_type = 'revisit' THEN '' ELSE coalesce(html, '') END || e || e AS record FROM n JOIN pages USING (page_id))
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, sha1(record) AS record_digest, CAST(octet_length(encode(record)) AS BIGINT) AS record_bytes FROM r
"""
