"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgiving.llm.common import stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"       # pages hold no capture time
RECORDS_PER_FILE = 50_000


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of bytes: five hex digits are four base32 digits."""
    digits = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(F.sha1(payload), at + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*digits)


def _field(name: str, value: Column) -> Column:
    """One header line; a value's line ends are escaped, so it cannot open another line. Null: no line."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _value(name: str) -> Column:
    """The value of a header line of column ``header``; null without such a line."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def _record_id(digest: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws(":", digest, row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
                    F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least: int = 0, date: str = DATE) -> None:
    """Archive ``pages``: one record each under ``path``/headers, each distinct payload once under ``path``/payloads.

    Payload: the column's UTF-8 bytes, null as empty. Of records whose
    payloads are equal and have at least ``least`` bytes, that with the
    smallest id (null ids last, rows that repeat an id by their place) is the
    response and the others are revisits that refer to it; every smaller one
    is a response. Null ids and urls have no header line. Other columns are not read.

    The payload's address is its SHA-256; that equal addresses have equal
    sizes and SHA-1 digests is checked as they are written. Headers, without
    payloads, are numbered in a written table, so a retried task repeats its
    numbers. Copies of a payload merge before the shuffle, and a payload that a third of
    all pages share is one row on its side of the joins.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    facts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes"))
    heads = stored(facts.select("id", "url", "digest", "bytes", sha1_base32(F.col("payload")).alias("sha1"),
                                F.monotonically_increasing_id().alias("row")), "warc-heads")
    first = heads.where(F.col("bytes") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("late"), "id", "row")).alias("first"))
    marked = heads.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("first.row") != F.col("row"), F.lit(False)))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("digest"), F.col("row"))), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")), _field("X-Page-ID", F.col("id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("digest"), F.col("first.row")))),
        _field("WARC-Profile", F.when(F.col("revisit"), PROFILE)), F.lit("Content-Type: text/html\r\n"),
        _field("Content-Length", F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))), F.lit("\r\n"))
    marked.select("row", "digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    sha1 = F.sha1("payload")
    same = (F.min(sha1) == F.max(sha1)) & (F.min("bytes") == F.max("bytes"))
    once = facts.groupBy("digest").agg(F.any_value("payload").alias("payload"), same.alias("same"))
    once.select("digest", F.when(F.col("same"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads share the digest "), "digest")).cast("binary")).alias("payload")
        ).write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of the archive, each checked against its address as it is read."""
    rows = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return rows.select("digest", F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest")).cast("binary")).alias("payload"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(row, digest, header, record_type, record_id, url, id, refers_to_record) of every record, read from its header bytes."""
    rows = spark.read.schema("row long, digest string, header binary").parquet(f"{path}/headers")
    return rows.select("*", _value("WARC-Type").alias("record_type"), _value("WARC-Record-ID").alias("record_id"),
                       _value("WARC-Target-URI").alias("url"), _value("X-Page-ID").alias("id"),
                       _value("WARC-Refers-To").alias("refers_to_record"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(row, id, url, record_type, header, payload): each page's record with its full payload, revisits' included."""
    return headers(spark, path).join(payloads(spark, path), "digest").select("row", "id", "url", "record_type", "header", "payload")


def record_facts(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each record; size and digest of the stored bytes.

    Only digests and sizes of the payloads meet the headers. A revisit refers to the response of its payload.
    """
    stored_once = payloads(spark, path).select("digest", F.length("payload").cast("long").alias("payload_bytes"),
                                               sha1_base32(F.col("payload")).alias("payload_digest"))
    read = stored(headers(spark, path).select("digest", "record_type", "record_id", "id", "refers_to_record"), "warc-records")
    targets = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("id").alias("refers_to"))
    # one row for each payload that has revisits, not one for each revisit
    named = (read.where("record_type = 'revisit'").groupBy("digest").agg(F.any_value("refers_to_record").alias("refers_to_record"))
             .join(targets, "refers_to_record").select("digest", "refers_to"))
    return read.join(stored_once.join(named, "digest", "left"), "digest").select(
        "id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))


def export_warc(spark: SparkSession, path: str, target: str, per_file: int = RECORDS_PER_FILE) -> None:
    """The archive as WARC files: each header with its payload (none for a revisit), two line ends after each record."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    # the text writer copies the bytes as they are and ends each record with the last newline
    whole = F.concat("header", body, F.lit(b"\r\n\r")).cast("string")
    records(spark, path).select(whole.alias("value")).write.option("maxRecordsPerFile", per_file).option("compression", "none").text(target)
