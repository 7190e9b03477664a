"""Content-addressed WARC archives: payloads stored once by digest, exact headers apart (native).

An archive is two tables: ``records`` (the exact header bytes of every record, with the address
of its payload) and ``payloads`` (the bytes, once per SHA-256). A join restores every record.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.storage import materialize, table

#: The alphabet of RFC 4648 and the profile of WARC 1.1 revisits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:warc:page:"


class Archive(NamedTuple):
    records: DataFrame
    payloads: DataFrame


def base32_of_hex(hexed: Column) -> Column:
    """Base 32 of a SHA-1 in hex: 8 groups of 5 hex digits, each 4 characters."""
    def group(g: int) -> list[Column]:
        bits = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]

    return F.concat(*[x for g in range(8) for x in group(g)])


def write_archive(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Store one WARC record per row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest key becomes
    ``response``, the others ``revisit`` it; shorter payloads are all ``response``. A null html is
    an empty payload, a null url an empty target, a null key is written as ``null`` and never leads
    where any key is given. Line ends inside a url become spaces. Repeated rows give a record
    each; of repeated leading rows every one is a response. A payload that many rows share is
    reduced to one copy in each input split before the shuffle, and records meet their leader
    in a join whose large partitions Spark splits.
    """
    bytes_of = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]", " ").alias("target"), bytes_of.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    payloads = materialize(rows.groupBy("address").agg(F.any_value("payload").alias("payload"), F.max("id").alias("lead")), "payloads")
    described = rows.select("id", "target", "address", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    led = described.join(payloads.select("address", "lead"), "address")
    revisit = (F.col("n") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("lead")) & F.col("lead").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("WARC-Target-URI: "), F.col("target"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.rtrim(name(F.col("lead")), F.lit("\r\n")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit("\r\n\r\n"),
    )
    records = materialize(led.select("address", head.cast("binary").alias("header"), http.cast("binary").alias("http_header")), "records")
    return Archive(records, payloads)


def restore_records(archive: Archive) -> DataFrame:
    """Every original record: header, http_header, payload; ``verified`` says that the digest holds.

    ``record`` is the WARC record as bytes (a revisit carries no payload).
    """
    verified = archive.payloads.select("address", "payload", (F.sha2("payload", 256) == F.col("address")).alias("verified"))
    is_revisit = F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n")
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return archive.records.join(verified, "address").withColumn("record", F.concat("header", "http_header", body, F.lit(b"\r\n\r\n")))


def read_records(restored: DataFrame) -> DataFrame:
    """Parse restored records: page_id, payload_bytes, payload_digest, record_type, refers_to, target, intact.

    Length and digest are those of the restored payload; ``intact`` says that the address, the
    digest in the header and the length in the header all agree with it.
    """
    head = F.col("header").cast("string")
    field = lambda name, kind=r"([^\r\n]*)": F.regexp_extract(head, rf"\r\n{name}: {kind}\r\n", 1)
    number = lambda name: field(name, rf"<{URN}([^>]*)>").try_cast("long")
    digest = base32_of_hex(F.sha1("payload"))
    kind = field("WARC-Type")
    length = F.octet_length("http_header") + F.when(kind == "revisit", 0).otherwise(F.octet_length("payload"))
    return restored.select(
        number("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target"),
        (F.col("verified") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (field("Content-Length").cast("long") == length)).alias("intact"),
    )


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_records(restore_records(write_archive(table(spark, sf_dir, "pages"))))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def _base32_sql(hexed: str) -> str:
    parts = [f"substr('{BASE32}', ((CAST('0x' || substr({hexed}, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)]
    return " || ".join(parts)


QUERIES = {"op9_warc_archive": op9_warc_archive}
ORACLES = {
    "op9_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS lead FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32_sql('h')} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM lead AND lead IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM lead THEN lead END AS refers_to, TRUE AS intact
FROM d"""
}
