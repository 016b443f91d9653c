"""A content-addressed archive of WARC records.

Two tables on shared files. payloads: each distinct payload once, addressed by its SHA-256; that all rows of one address have
the same bytes is checked when it is written, and that the bytes have their address when it is read. records: the exact header
of every record and the address of its payload. Joining them gives the original records, which can also be written as plain
WARC files and read from such files.

Of records with equal payloads of min_bytes or more, the one with the smallest id is a response; the others are revisits that
name it and have no block of their own. Smaller payloads are all responses.

Defined cases: null text counts as an empty payload, a null url as an empty one. A null id comes after all others (its record is
named "none"). Rows that repeat an id and payload are each a record of the same type. An empty table gives an empty archive.
Columns other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: RFC 4648's alphabet beside that of Spark's conv.
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """Five hex digits are four base-32 digits, and 40 of them need no padding."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> tuple[DataFrame, DataFrame]:
    """Write (records, payloads) below the shared folder; the frames read what was written."""
    payload = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))

    same = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("two payloads have one address")).cast("binary"))
    payloads = materialise(
        rows.groupBy("address").agg(F.min("payload").alias("low"), F.max("payload").alias("high"), F.min("id").alias("first_id"))
        .select("address", same.alias("payload"), "first_id"),
        "payloads",
    )
    keys = rows.select("id", "url", "address", sha1_base32(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    typed = keys.join(payloads.select("address", "first_id"), "address").withColumn(
        "record_type",
        F.when((F.col("payload_bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit"),
    )
    typed = typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))
    return materialise(typed.select(_header(date).alias("header"), "address"), "records"), payloads.select("address", "payload")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def _page(name: str) -> Column:
    return F.expr(f"try_cast(regexp_extract(header, '(?:^|\\n){name}: <urn:page:(-?[0-9]+)>', 1) as bigint)")


def parsed(records: DataFrame) -> DataFrame:
    """records with page_id, record_type, refers_to and digest taken from their headers."""
    digest = F.substring_index(_field("WARC-Payload-Digest"), ":", -1)
    return records.withColumns({
        "page_id": _page("WARC-Record-ID"), "url": _field("WARC-Target-URI"), "record_type": _field("WARC-Type"), "refers_to": _page("WARC-Refers-To"), "digest": digest
    })


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """The original records: page_id, url, record_type, refers_to, header, payload, payload_bytes, payload_digest.

    Fails if a payload's bytes have another address, or another digest than a header says.
    """
    good = F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(F.raise_error(F.lit("a payload's bytes have changed")).cast("string"))
    checked = payloads.select(
        good.alias("address"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("sha1")
    )
    joined = parsed(records).join(checked, "address")
    agreed = F.when(F.col("digest") == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header has another digest")).cast("string"))
    return joined.select("page_id", "url", "record_type", "refers_to", "header", "payload", "payload_bytes", agreed.alias("payload_digest"))


def export_warc(original: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """Plain WARC files of records from read_archive: header, block, and the two empty lines as the writer's line end."""
    block = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    original.select(F.concat("header", block).alias("value")).write.options(lineSep="\r\n\r\n", maxRecordsPerFile=records_per_file).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and block of every record in the WARC files below path; a file is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, at = [], 0
                while (end := content.find(b"\r\n\r\n", at)) >= 0:
                    header = content[at : end + 4]
                    length = next(int(x[15:]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    rows.append((header.decode(), content[end + 4 : end + 4 + length]))
                    at = end + 4 + length + 4
                yield pd.DataFrame(rows, columns=["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "header string, block binary")
