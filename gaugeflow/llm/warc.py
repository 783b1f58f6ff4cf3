"""Content-addressed WARC archive (operator 6).

An archive is two tables. ``payloads`` holds the bytes of each distinct payload once, under its SHA-256.
``headers`` holds each record's exact WARC and HTTP header bytes, the record's position in the archive
and the digest of its payload. Records come back by a join on the digest; the bytes are hashed again on
the way, and bytes that do not match their digest fail the read. Two payloads of one digest fail the write.

Of records with equal payloads of at least ``revisit_bytes`` that with the largest id is a ``response``
and the others are ``revisit`` records that refer to it; smaller payloads are always responses.

Defined results: a null html is an empty payload; a null url is an empty target; a row without id is a
response and is never referred to; rows that share the largest id are all responses. Other columns are
not read. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_URN = "urn:page:"


def _header(date: str) -> tuple[Column, Column]:
    """The WARC header and the HTTP header of a row with id, url, type, refers_to, sha1 and n."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(F.col("type") == "response", F.col("n")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "type"),
        F.concat(F.lit(f"WARC-Record-ID: <{_URN}"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(F.col("type") == "revisit", F.concat(F.lit(f"WARC-Refers-To: <{_URN}"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), http


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    check = F.struct(F.octet_length("payload").alias("n"), F.crc32("payload").alias("crc"))
    bodies = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(check).alias("low"), F.max(check).alias("high"))
    verified = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary"))
    bodies.select("digest", verified.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    light = rows.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    latest = light.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("last"))
    typed = light.join(latest, "digest", "left").withColumn("refers_to", F.when(F.col("id") < F.col("last"), F.col("last")))
    typed = typed.withColumn("type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    warc, http = _header(date)
    typed.select(warc.alias("warc_header"), http.alias("http_header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``warc_header, http_header, payload, record``: every record of the archive and its original bytes.

    ``payload`` is the full payload, for a revisit that of the record it refers to; ``record`` is what a
    WARC file holds: a revisit's ends after its HTTP header.
    """
    headers = spark.read.schema("warc_header string, http_header string, digest string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("binary"))
    found = headers.join(payloads.select("digest", checked.alias("payload")), "digest", "left")
    head = F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"))
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return found.select("warc_header", "http_header", "payload", F.concat(head, body, F.lit(b"\r\n\r\n")).alias("record"))


def field(name: str, header: str = "warc_header") -> Column:
    """A named field of a record's header, null where it is absent."""
    value = F.regexp_extract(header, f"(?m)^{name}: ([^\\r\\n]*)", 1)
    return F.when(value != "", value)


def record_ids(column: Column) -> Column:
    """The id in a record's URN, null where there is none."""
    return F.regexp_extract(column, f"^<{_URN}(-?\\d+)>$", 1).try_cast("long")
