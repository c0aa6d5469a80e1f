"""WARC archives: a writer in DataFrame functions and a salvage reader.

Writer: one record per page. Header lines, the HTTP head and the payload are
one string column; by default each record is a gzip member of its own, so damage
costs the record it lies in. Members are written by Spark's text writer, whose
task commit makes lost or repeated attempts harmless: a member ends with a zero
byte, which is the writer's line end. Of pages with equal payloads the largest page_id
is the response; the others are revisit records without a payload that name its
record id.

Reader: every archive file is one row of the binary reader (the writer keeps
files at about ``FILE_BYTES``). A record is accepted if its version line,
header, length, end mark and payload digest hold. After a failed check the
reader searches for the next version line, or in compressed archives the next
member that can be inflated, goes on from there, and logs the bytes in between
as a quarantined gap. Of a damaged member the records before the damage are
recovered too.

Null html is an empty payload; null url leaves out the target; a null page_id
is written as such and never is the one that others refer to, unless all equal
pages have none. Rows that repeat the largest page_id are all responses. Control
characters and non-ASCII characters of a url are percent-encoded, so a header
can't be broken by them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm.common import fresh_path

FILE_BYTES = 8 << 20
#: compressed bytes inflated at a time: less is lost before a damaged place
CHUNK = 4096
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(data: Column) -> Column:
    """Base32 of the 160-bit digest: 5 hex digits at a time are 4 base32 digits."""
    digest = F.sha1(data)
    out = []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def safe_url(url: Column) -> Column:
    """Header-safe: anything but visible ASCII is percent-encoded (space as %20)."""
    odd = F.regexp_replace(F.url_encode(url), r"\+", "%20")
    return F.when(url.rlike(r"\A[\x21-\x7E]*\z"), url).otherwise(odd)


def plan_records(pages: DataFrame, files: int = 1, id_col="page_id", html_col="html", url_col="url",
                 least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, resp), dealt to so many
    partitions; resp is the page_id of the response with an equal payload.

    The largest id per payload comes from a sum before the shuffle; it is joined
    back by page_id and digest, so a payload that many pages share stays spread,
    and the payloads are shuffled once.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "page": name,
                             "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    slim = rows.select("page_id", "page", "payload_bytes", "payload_digest")
    best = (slim.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("resp"), F.count("*").alias("n"))
            .filter((F.col("n") > 1) & (F.col("payload_bytes") >= least_bytes)).drop("n"))
    links = (slim.join(best, ["payload_digest", "payload_bytes"]).filter("page_id IS NULL OR page_id < resp")
             .select("page", "payload_digest", "resp").distinct())
    return rows.repartition(files, "page", "payload_digest").join(links, ["page", "payload_digest"], "left").drop("page")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(df: DataFrame) -> Column:
    """The record but for its last byte, which the writer's line end adds."""
    revisit = F.col("resp").isNotNull()
    size = F.octet_length("html").cast("string")
    body = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(
        F.concat(F.lit(HTTP_HEAD), size, F.lit("\r\n\r\n"), F.col("html")))
    head = F.concat(
        F.lit(VERSION.decode() + "\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), safe_url(F.col("url"))), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"), F.lit("\r\nX-Payload-Bytes: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: "), record_id(F.col("resp")))).otherwise(F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r"))


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends with a zero byte, without that byte.

    The last byte is the highest of the length; after a record of 16 MB or more
    an empty member follows.
    """
    out = gzip.compress(record, 6, mtime=0)
    return (out if out[-1] == 0 else out + gzip.compress(b"", mtime=0))[:-1]


def member_column(record: Column) -> Column:
    def run(records: pd.Series) -> pd.Series:
        return pd.Series([member(r.encode()) for r in records], dtype=object)

    return F.pandas_udf(run, "binary")(record)


def write_warc(planned: DataFrame, path: str, compression: str = "gzip") -> None:
    """A file per partition; a record is never split. gzip: one member a record."""
    record, end = record_text(planned), "\n"
    if compression == "gzip":
        record, end, compression = member_column(F.concat(record, F.lit("\n"))).cast("string"), "\0", "none"
    planned.select(record.alias("value")).write.option("lineSep", end).option("compression", compression).text(path)


# -- reader -------------------------------------------------------------------

def _headers(block: bytes) -> dict[str, str] | None:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def check_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at a byte, and where it ends; or the check that failed."""
    end = data.find(b"\r\n\r\n", at)
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at) or end < 0:
        return "no version line" if end >= 0 else "no end of header"
    head = _headers(data[at:end])
    if head is None:
        return "bad header line"
    size = head.get("content-length", "")
    if not size.isdigit():
        return "bad length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "no end mark at the stated length"
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = data[start:stop]
    if head.get("content-type", "").startswith("application/http"):
        cut = payload.find(b"\r\n\r\n")
        payload = payload[cut + 4:] if cut >= 0 else b""
    if kind != "revisit" and digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return "payload digest differs"
    return {"head": head, "type": kind, "digest": digest, "payload": payload}, stop + 4


def salvage(data: bytes, base: int = 0):
    """Yield ('record', start, end, record) and ('gap', start, end, reason) of plain WARC bytes."""
    at, gap, why = 0, None, ""
    while at < len(data):
        got = check_record(data, at)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            found = data.find(b"WARC/1.", at + 1)
            at = found if found >= 0 else len(data)
            continue
        if gap is not None:
            yield "gap", base + gap, base + at, why
            gap = None
        yield "record", base + at, base + got[1], got[0]
        at = got[1]
    if gap is not None:
        yield "gap", base + gap, base + len(data), why


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a member holds, as far as it can be inflated; its end; what failed."""
    if data[at:at + 2] != b"\x1f\x8b":
        return b"", at, "no member"
    inflate, plain = zlib.decompressobj(31), []
    try:
        for k in range(at, len(data), CHUNK):
            plain.append(inflate.decompress(data[k:k + CHUNK]))
            if inflate.eof:
                return b"".join(plain), min(k + CHUNK, len(data)) - len(inflate.unused_data), ""
    except zlib.error as e:
        return b"".join(plain), at, str(e)
    return b"".join(plain), at, "cut member"


def salvage_any(data: bytes):
    """The same for plain bytes or gzip members; offsets are those of the file.

    A member that can't be inflated whole gives the records before the damage;
    from its start to the next member that can be inflated is a gap.
    """
    if data[:2] != b"\x1f\x8b" and b"WARC/1." in data:
        yield from salvage(data)
        return
    at, gap, why = 0, None, ""
    while at < len(data):
        plain, end, bad = _inflate(data, at)
        if bad:
            found = data.find(b"\x1f\x8b\x08", at + 1)
            found = found if found >= 0 else len(data)
            for kind, _, _, what in salvage(plain):
                if kind == "record":
                    yield kind, at, found, what
            if gap is None:
                gap, why = at, bad
            at = found
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        for kind, _, _, what in salvage(plain):
            yield kind, at, end, what
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why


READ_SCHEMA = ("file string, start long, stop long, gap string, record_type string, record_id string, "
               "refers_id string, url string, payload_bytes long, payload_digest string, payload binary")


def _read_file(path: str, data: bytes, with_payload: bool):
    for kind, start, stop, what in salvage_any(data):
        if kind == "gap":
            yield path, start, stop, what, None, None, None, None, None, None, None
            continue
        head = what["head"]
        size = head.get("x-payload-bytes", "") if what["type"] == "revisit" else str(len(what["payload"]))
        yield (path, start, stop, None, what["type"], head.get("warc-record-id"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), int(size) if size.isdigit() else None, what["digest"] or None,
               what["payload"] if with_payload else None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of records (gap null) and of quarantined byte gaps (gap: the reason)."""
    fields = [f.split() for f in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for row in _read_file(name.as_py(), content.as_py(), with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 100
                    if held > FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, READ_SCHEMA)


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Write the pages and read them back: (path, records and gaps)."""
    path = path or fresh_path(spark, "warc")
    total = pages.agg(F.sum(F.octet_length("html") + 600)).first()[0] or 0
    write_warc(plan_records(pages, max(1, -(-total // FILE_BYTES))), path)
    return path, read_warc(spark, path, with_payload=False)
