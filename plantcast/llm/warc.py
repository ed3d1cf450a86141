"""WARC archives with revisit records instead of repeated payloads.

Headers (page id, payload digest, length) are shuffled by digest; the smallest page id of each
payload is its response and the others join it as revisits. Only payloads that occur again have a row in that
join, so up to ``FEW`` of them go to every task and no payload is shuffled; beyond it pages join by digest.
Payloads of equal SHA-1 and length count as equal. Records are written with fresh headers
by Spark's text writer, whose line separator is the blank line that ends a WARC record, so archives
go to whatever file system the session's shared folder is on.

Defined results: a null html is an empty payload; payloads shorter than ``min_bytes`` are all
responses; rows that repeat the smallest page id are all responses; a null page id comes after all
others and is never referred to unless all ids of the payload are null, then all are responses. Urls
may be null or hold line breaks, which are percent-encoded. An empty table gives an empty archive.
Page ids are whole numbers, other types are refused. Further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.llm.common import broadcast_if_few, require_whole, staged, work_folder

FEW = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: forty hex digits, five at a time as four letters."""
    digest = F.sha1(payload)
    letters = []
    for start in range(1, 41, 5):
        bits = F.conv(F.substring(digest, start, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            index = F.shiftright(bits, shift).bitwiseAND(31)
            letters.append(F.substr(F.lit(BASE32), index + 1, F.lit(1)))
    return F.concat(*letters)


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    require_whole(pages, "page_id")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))}
    )
    heads = pages.select("page_id", payload.alias("payload")).select(
        "page_id", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest")
    )
    first = (
        heads.filter(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    first = broadcast_if_few(staged(first, work_folder(pages.sparkSession, "first")), FEW)
    same = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return (
        rows.join(first, same, "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first")))
        .drop("first", "digest", "bytes")
    )


def _record_id(page_id: Column) -> Column:
    digits = F.lpad(F.lower(F.hex(F.coalesce(page_id, F.lit(0)))), 16, "0")
    kind = F.when(page_id.isNull(), "1").otherwise("0")
    return F.concat(
        F.lit("<urn:uuid:0000000"), kind, F.lit("-0000-4000-"), F.substring(digits, 1, 4), F.lit("-"),
        F.substring(digits, 5, 12), F.lit(">"),
    )


def record_text(dated: str) -> Column:
    """One WARC record without the blank line that ends it."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes"), F.lit(RECORD_END),
    )
    safe_url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.when(
        F.col("record_type") == "revisit",
        F.concat(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit("\r\n")
        ),
    ).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {dated}\r\nWARC-Target-URI: "), safe_url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.octet_length(body), F.lit(RECORD_END), http, body,
    )


def write_archives(resolved: DataFrame, folder: str, dated: str = "2024-01-01T00:00:00Z", per_file: int = 5000) -> None:
    """Write the records as gzip files of at most ``per_file`` records below ``folder``."""
    (
        resolved.select(record_text(dated).alias("value"))
        .write.mode("overwrite")
        .option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(folder)
    )


def _page_of(record_id: str) -> int | None:
    digits = record_id.strip("<>").removeprefix("urn:uuid:").split("-")
    if digits[0].endswith("1"):
        return None
    value = int(digits[3] + digits[4], 16)
    return value - (1 << 64) if value >= 1 << 63 else value


def parse_archive(archive: BinaryIO) -> Iterator[dict]:
    """Records of one archive, a record at a time; the lengths in the headers, not the separators, tell where they end."""
    while archive.readline():  # the version
        head = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends within a record")
            name, _, value = line.decode("utf-8").removesuffix("\r\n").partition(":")
            head[name] = value.removeprefix(" ")
        http, payload = archive.read(int(head["Content-Length"])).split(b"\r\n\r\n", 1)
        archive.read(4)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(http.rsplit(b"Content-Length: ", 1)[1])
        kind = head["WARC-Type"]
        if kind == "response" and (len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield {
            "page_id": _page_of(head["WARC-Record-ID"]),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": _page_of(head["WARC-Refers-To"]) if kind == "revisit" else None,
            "url": head["WARC-Target-URI"],
        }


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives below ``folder``, every response checked against its digest."""
    arrow = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                records = parse_archive(gzip.open(io.BytesIO(data.as_py())))
                while some := list(islice(records, 1000)):
                    yield pa.RecordBatch.from_pylist(some, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(parse, READ_SCHEMA)
