"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, in Parquet compressed by Zstandard; record headers are stored apart, byte for byte, with the digest they
refer to; records come back through a join of the two. Every payload is checked against its digest when it is read.

Of records with equal payloads that reach `least` bytes, the one with the largest id is the response and the others
are revisits of it; smaller payloads are all responses. Rows that repeat the largest id are all responses. Null ids order
below every id. A null payload is the empty one; a null url leaves the target URI out. An empty table gives an empty archive; only the
id, url and payload columns are read, so others may have any name. Rows of one id with different payloads are records of their own. A payload of
any size is one value and is held whole by the task that packs or checks it.

A response's block is an HTTP message of a minimal head and the payload; a revisit has no block. A record's id is made of the page's id (or
null) and a hash of its url and payload, so only rows that repeat all three share one, and a revisit names its response's record.
Rows of one payload meet its digest in a join that Spark's adaptive execution splits where a payload is very frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.ranges import order_key
from tallymill.llm.runtime import new_path, text_bytes

CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Two Parquet folders: payloads (sha256, sha1, size, owner, tag, data) and records (header, sha256)."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def records(self) -> str:
        return f"{self.path}/records"


def _base32(digest: F.Column) -> F.Column:
    """Base 32 of a SHA-1 in hex: 10 hex digits are 40 bits, so 8 digits of base 32 in the other alphabet."""
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in range(1, 41, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _once(rows: DataFrame) -> DataFrame:
    """One row for each digest: its payload, and the largest key (then tag) of its rows. A digest that stands for two payloads stops the job."""
    found = rows.select("key", "tag", "payload", _sha256("payload").alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    mark = F.struct("sha1", "size")
    each = found.groupBy("sha256").agg(F.max(F.struct("key", "tag")).alias("owner"), F.min(mark).alias("low"), F.max(mark).alias("high"), F.first("payload").alias("data"))
    sha1 = F.when(F.col("low") == F.col("high"), F.col("low.sha1")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256")))
    return each.select("sha256", _base32(sha1).alias("sha1"), F.col("low.size").alias("size"), F.col("owner.key").alias("owner"), F.col("owner.tag").alias("tag"), "data")


def _sha256(column: str) -> F.Column:
    return F.unhex(F.sha2(column, 256))


def _header(lines: list[tuple[str, F.Column]]) -> F.Column:
    """Header block of named fields; a field whose value is null is left out."""
    fields = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in lines]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(f, F.lit("")) for f in fields], F.lit(CRLF)).cast("binary")


def _record_id(page: F.Column, tag: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(tag)), F.lit(">"))


def write_archive(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0, path: str | None = None, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """One WARC record for each row. date: of all records, as the input has none."""
    spark = pages.sparkSession
    at = Archive(path or new_path(spark, "warc"))
    body = text_bytes(F.col(payload_column))
    rows = pages.select(order_key(F.col(id_column)).alias("key"), F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), body.alias("payload")).withColumn("tag", F.xxhash64("url", "payload"))
    _once(rows).write.option("compression", "zstd").parquet(at.payloads)

    owners = spark.read.parquet(at.payloads).select("sha256", "sha1", F.col("size").alias("bytes"), "owner", F.col("tag").alias("owner_tag"))
    mine = rows.select("key", "id", "url", "tag", _sha256("payload").alias("sha256"))
    joined = mine.join(owners, "sha256")
    revisit = (F.col("bytes") >= least) & (F.col("key") < F.col("owner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    header = _header(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _record_id(F.col("id"), F.col("tag"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner"), F.col("owner_tag")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("bytes"))),
        ]
    )
    # The HTTP head is part of the record's header bytes here, as the payload alone is shared.
    whole = F.concat(header, F.when(revisit, F.lit("")).otherwise(http).cast("binary"))
    joined.select(whole.alias("header"), "sha256").write.parquet(at.records)
    return at


def _stored(spark: SparkSession, archive: Archive) -> DataFrame:
    """(sha256, payload_digest, payload_bytes, data) of every payload, which must match both its digests."""
    read = spark.read.parquet(archive.payloads).select("sha256", "sha1", "data", _sha256("data").alias("strong"), F.sha1("data").alias("weak"))
    wrong = F.raise_error(F.concat(F.lit("payload "), F.lower(F.hex("sha256")), F.lit(" does not match its digest")))
    digest = F.when((F.col("strong") == F.col("sha256")) & (_base32(F.col("weak")) == F.col("sha1")), F.col("sha1")).otherwise(wrong)
    return read.select("sha256", digest.alias("payload_digest"), F.octet_length("data").cast("long").alias("payload_bytes"), "data")


def _field(name: str) -> F.Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\A[^\r]*\r\n(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _page(name: str) -> F.Column:
    return F.nullif(F.regexp_extract(_field(name), r"^<urn:page:(-?\d+):[0-9a-f]+>$", 1), F.lit("")).cast("long")


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record's parsed header beside the verified size and digest of its full payload."""
    stored = _stored(spark, archive).drop("data")
    records = spark.read.parquet(archive.records)
    parsed = records.select("sha256", _page("WARC-Record-ID").alias("id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"), F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("digest"))
    wrong = F.raise_error(F.concat(F.lit("header and payload differ in digest: "), F.col("digest")))
    checked = F.when(F.col("digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong)
    return parsed.join(stored, "sha256").select("id", "url", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record, payload): each original WARC record, and the full payload it stands for, rebuilt by the join."""

    joined = spark.read.parquet(archive.records).join(_stored(spark, archive), "sha256").where(F.col("payload_digest").isNotNull())
    revisit = F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    return joined.select(F.concat("header", block, F.lit(f"{CRLF}{CRLF}".encode())).alias("record"), F.col("data").alias("payload"))
