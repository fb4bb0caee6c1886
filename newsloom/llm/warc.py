"""WARC archives: writing captures, resolving revisits, reading records back.

An archive is a text file of WARC/1.1 records, gzipped as one stream (offsets are those of the stream). Spark's own
text writer makes it, so archives go wherever Spark can write and no executor keeps files of its own: a task
joins records to the text of an archive, until it has ``ARCHIVE_RECORDS`` of them or ``ARCHIVE_BYTES``, and each such text is
one file. An archive is read back as one value, so its size is bounded in bytes; only a record that is larger by
itself makes a larger one.

Revisit resolution moves headers, not payloads: each record's payload digest and length are
shuffled, the record with the smallest page id of a digest is found with partial aggregation
(a digest that a third of all records share costs each task one row), revisits are joined to it,
and what is to change in an archive is gathered by archive, so that archives, still compressed, meet one row each. They
are written anew: responses with their payload, revisits with a header that refers
to the response.

Defined results: a null html is an empty payload; a null url is ``urn:newsloom:unknown``; control
characters and spaces in urls are percent-encoded in headers; records without a page id come
after all others when an original is sought; among records that tie on the page id, the first in
the archives is the original; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, shared_path, shared_table

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_RECORDS = 1000
ARCHIVE_BYTES = 16 << 20
"""Records, and uncompressed bytes, in an archive at most."""

RECORD = (
    "archive string, offset bigint, record_type string, page_id bigint, uri string, date string, record_id string, "
    "payload_digest string, payload_bytes bigint, refers_to_record string, payload string"
)
LEVEL = "BEST_SPEED"
"""Of gzip: archives are written twice, and most of the time goes into that."""
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, sha1: str, serial: str, date: str = DATE, refers: dict | None = None) -> str:
    """One record without the CRLF CRLF that ends it. A revisit holds the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head + ("" if kind == "revisit" else payload.decode("utf-8"))
    raw = block.encode("utf-8")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}|{page_id}|{serial}|{sha1}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(uri, safe="%:/?#[]@!$&'()*+,;=~-._") if uri else "urn:newsloom:unknown"),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Block-Digest", f"sha1:{digest(raw)}"),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers["record"]), ("WARC-Refers-To-Target-URI", refers["uri"]), ("WARC-Refers-To-Date", refers["date"])]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(raw)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, lower-cased headers, block) of each record; lengths come from Content-Length alone."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        stop = begin + int(fields["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield at, fields, content[begin:stop]
        at = stop + 4


def _bundles(records: Iterator[str], most: int) -> Iterator[pa.RecordBatch]:
    """Texts of archives, one to a batch."""
    held, size = [], 0

    def text() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["\r\n\r\n".join(held)], pa.string())], names=["value"])

    for value in records:
        if held and (len(held) == ARCHIVE_RECORDS or size + len(value) > most):
            yield text()
            held, size = [], 0
        held.append(value)
        size += len(value) if value.isascii() else len(value.encode("utf-8"))
    if held:
        yield text()


def _captured(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for page_id, url, html, row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            payload = (html or "").encode("utf-8")
            yield record("response", page_id, url, payload, digest(payload), f"capture-{row}")


def _write(archives: DataFrame, label: str) -> str:
    path = shared_path(archives.sparkSession, label)
    archives.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", LEVEL).option("maxRecordsPerFile", 1).text(path)
    return path


def write_captures(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """A response record for each (page_id, url, html) row; the archives' folder."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return _write(rows.mapInArrow(lambda b: _bundles(_captured(b), archive_bytes), "value string"), "warc-captures")


def _read(archive: str, content: bytes) -> Iterator[tuple[tuple, bytes]]:
    """(the RECORD fields but the last, payload) of each record of an archive; payload digests are checked."""
    for offset, fields, block in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
        header, _, payload = block.partition(b"\r\n\r\n")
        sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] != "revisit" and digest(payload) != sha1:
            raise ValueError(f"{archive}, byte {offset}: the payload does not have its digest")
        length = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", header)[1])
        page = fields.get("x-page-id")
        yield (archive, offset, fields["warc-type"], int(page) if page else None, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], sha1, length, fields.get("warc-refers-to")), payload


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()),
            ("record_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_record", pa.string()), ("payload", pa.string()),
        ]
    )
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, held = [], 0
            for head, payload in _read(archive, content):
                rows.append((*head, payload.decode("utf-8") if payloads and head[2] != "revisit" else None))
                held += len(payload)
                if held > 4 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of a folder's archives, digests checked; payload bytes are those the HTTP header states."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _records(batches, payloads), RECORD)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, offset) of each record that is a revisit, with the record it refers to.

    Payloads of fewer than ``min_bytes`` stay responses. Records that are revisits already keep
    what they refer to.
    """
    ranked = headers.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)).withColumn(
        "rank", F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "archive", "offset")
    )
    first = (
        ranked.groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct("rank", "record_id", "uri", "date")).alias("first"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )
    return (
        ranked.join(first, ["payload_digest", "payload_bytes"])
        .filter(F.col("rank") != F.col("first.rank"))
        .select("archive", "offset", F.col("first.rank.page_id").alias("to_page"), F.col("first.uri").alias("to_uri"), F.col("first.date").alias("to_date"), F.col("first.rank.archive").alias("to_archive"), F.col("first.rank.offset").alias("to_offset"))
    )


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The records of (archive, content, changes) rows, written anew."""
    names = ("archive", "offset", "record_type", "page_id", "uri", "date", "record_id", "payload_digest", "payload_bytes", "refers_to_record")
    for batch in batches:
        for archive, content, changes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            to = {c["offset"]: c for c in changes or ()}
            for head, payload in _read(archive, content):
                x = dict(zip(names, head, strict=True))
                sha1, serial, change = x["payload_digest"], f"{archive}:{x['offset']}", to.get(x["offset"])
                if change:
                    original = uuid.uuid5(_NAMESPACE, f"response|{change['to_page']}|{change['to_archive']}:{change['to_offset']}|{sha1}")
                    yield _revisit(x, sha1, serial, f"<urn:uuid:{original}>", change["to_uri"], change["to_date"])
                elif x["record_type"] == "response":
                    yield record("response", x["page_id"], x["uri"], payload, sha1, serial, x["date"])
                else:
                    yield _revisit(x, sha1, serial, x["refers_to_record"], x["uri"], x["date"])


def _revisit(x: dict, sha1: str, serial: str, record_id: str, uri: str, date: str) -> str:
    text = record("revisit", x["page_id"], x["uri"], b"", sha1, serial, x["date"], {"record": record_id, "uri": uri, "date": date})
    # the HTTP header of a revisit states the length of the payload that it stands for
    stated = text.replace("\r\nContent-Length: 0\r\n\r\n", f"\r\nContent-Length: {x['payload_bytes']}\r\n\r\n")
    block = stated.split("\r\n\r\n", 1)[1].encode("utf-8")
    head = re.sub(r"Content-Length: \d+$", f"Content-Length: {len(block)}", stated.split("\r\n\r\n", 1)[0])
    head = re.sub(r"WARC-Block-Digest: sha1:\w+", f"WARC-Block-Digest: sha1:{digest(block)}", head)
    return head + "\r\n\r\n" + block.decode("utf-8")


def deduplicate_archives(spark: SparkSession, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Archives with each payload once, the other records turned into revisits; the new folder."""
    headers = shared_table(read_archives(spark, path).drop("payload"), "warc-headers")
    # an archive has ARCHIVE_RECORDS records at most, so its changes are bounded
    changes = resolve_revisits(headers, min_bytes).groupBy("archive").agg(F.collect_list(F.struct("offset", "to_page", "to_uri", "to_date", "to_archive", "to_offset")).alias("changes"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    met = files.join(changes, F.col("path") == F.col("archive"), "left").select("path", "content", "changes")
    out = _write(met.mapInArrow(lambda b: _bundles(_fresh(b), archive_bytes), "value string"), "warc-deduplicated")
    forget(headers)
    return out


def resolved_records(spark: SparkSession, path: str) -> DataFrame:
    """Headers of deduplicated archives, each revisit with the page id of the response it refers to."""
    headers = shared_table(read_archives(spark, path).drop("payload"), "warc-resolved")
    responses = headers.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.lit(True).alias("found"))
    return headers.join(responses, "refers_to_record", "left").withColumn(
        "refers_to",
        F.when((F.col("record_type") == "revisit") & F.col("found").isNull(), F.raise_error(F.concat(F.lit("no response for "), F.col("refers_to_record"))).cast("bigint")).otherwise(F.col("refers_to")),
    )
