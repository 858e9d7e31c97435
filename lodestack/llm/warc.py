"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Archives are Spark text files of gzip members, one a record, which Spark's own committer makes whole or
not at all; any store that Spark knows will do. They are read as binary files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import grams
from lodestack.llm.shared import saved

#: Payloads under so many bytes are stored wherever they occur.
MIN_REVISIT = 1000
#: Bytes of members that are written as one, and so many of them a file: what a reader holds at once.
SEGMENT_BYTES, SEGMENTS = 4 << 20, 4
#: A gzip member of nothing stands between two segments.
EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"

READ_SCHEMA = (
    "file string, start bigint, end bigint, kind string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes bigint, payload_digest string, payload binary, reason string"
)
_ARROW = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string()),
])


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every row of pages (page_id, url, html).

    Of equal payloads of min_revisit bytes or more that with the largest page_id is the response, others
    revisit it; rows that repeat that page_id are responses too. Null html is an empty payload. Only
    digests are grouped; those met more than once are joined back, by broadcast where they are few.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select("page_id", "url", raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    groups = pages.where(size >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    groups = saved(groups.select("digest", "keeper"), "payload-groups")
    pages = pages.join(groups, "digest", "left")
    again = (size >= min_revisit) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False)) & F.col("keeper").isNotNull()
    return pages.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def _record(date: str):
    """The bytes of a record, all but its last two line ends."""
    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    inside = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), inside.cast("string")),
    )
    return F.concat(F.concat(head, F.lit(CRLF * 2), http).cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit((CRLF * 2).encode()))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for record in batch.column(0):
            press = zlib.compressobj(5, zlib.DEFLATED, 31)
            held.append(press.compress(record.as_buffer()) + press.flush())
            size += len(held[-1])
            if size >= SEGMENT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])


def write_archives(records: DataFrame, out: str, date: str = DATE) -> None:
    """Writes the records of plan_records() as archives into the folder out."""
    grams.bounded_batches(records.sparkSession)
    members = records.select(_record(date).alias("record")).mapInArrow(_segments, "members binary")
    text = members.select(F.col("members").cast("string").alias("value"))
    text.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", SEGMENTS).text(out)


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _number(said: str | None) -> int | None:
    """A length as a header states it: ASCII digits, at most 19; anything else is none."""
    return int(said) if said and re.fullmatch(r"[0-9]{1,19}", said) else None


def _hex(digest: str) -> str | None:
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def parse_record(raw: bytes, at: int = 0) -> tuple[dict | None, int, str]:
    """The record that starts at a version line, its end, and why it failed its checks if it is None."""
    if not re.match(rb"WARC/\d+\.\d+\r\n", raw[at : at + 20]):
        return None, at, "no version line"
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "header does not end"
    fields = _fields(raw[at:stop])
    length = _number(fields.get("content-length"))
    if length is None:
        return None, at, "no length"
    begin = stop + 4
    end = begin + length
    if raw[end : end + 4] != b"\r\n\r\n":
        return None, at, "length does not meet the record's end"
    block = raw[begin:end]
    record = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
        size = len(payload)
        if record["record_type"] == "revisit":
            told = _number(_fields(block[: max(cut, 0)]).get("content-length"))
            size = size if told is None or told >= 1 << 63 else told
    named = _hex(fields.get("warc-payload-digest", ""))
    if record["record_type"] == "revisit":
        digest, payload = named, None
    else:
        digest = hashlib.sha1(payload).hexdigest()
        if named and named != digest:
            return None, at, "payload digest differs"
    return record | {"payload": payload, "payload_bytes": size, "payload_digest": digest}, end + 4, ""


def _inflate(raw: memoryview, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at at holds as far as it inflates, its end, and whether that is all and its checksum is right."""
    press, out, step = zlib.decompressobj(31), [], 1 << 16
    spot = at
    while not press.eof and spot < len(raw):
        before = press.copy()
        try:
            out.append(press.decompress(raw[spot : spot + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), at, False
            press, step = before, max(1, step >> 8)  # what comes out before the error is kept
            continue
        spot += step
    if not press.eof:
        return b"".join(out), at, False
    return b"".join(out), min(spot, len(raw)) - len(press.unused_data), True


def _plain(raw: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, end, record, reason) of plain bytes: records, and runs without a valid one. After a failure the next version line is searched for."""
    at, gap, why = 0, None, ""
    while at < len(raw):
        record, end, reason = parse_record(raw, at)
        if record is None:
            if gap is None:
                gap, why = at, reason
            found = raw.find(b"WARC/", at + 1)
            at = found if found >= 0 else len(raw)
            continue
        if gap is not None:
            yield gap, at, None, why
            gap = None
        yield at, end, record, ""
        at = end
    if gap is not None:
        yield gap, len(raw), None, why


def salvage(raw: bytes) -> Iterator[dict]:
    """Records of an archive, gzip members or plain, with their byte places; and gaps, the bytes that failed the checks.

    After a failure the search goes on, from the next byte, for a gzip magic number or a version line at
    which a whole valid record stands. Members that hold several records are searched inside as well: a
    record that fails there is a gap of kind 'inner gap', with the member's place and the inflated bytes
    in its reason, and the records around it are kept. Of a member that does not inflate to its end,
    whole records that pass their own checks are kept too, with the member's start and no end; the
    member itself is in a gap.
    """
    view, at, gap, why = memoryview(raw), 0, None, ""
    near = {b"\x1f\x8b\x08": -1, b"WARC/": -1}  # the next place of each mark, searched for once
    while at < len(raw):
        found, end, reason = [], at, ""
        if raw.startswith(b"\x1f\x8b\x08", at):
            inside, end, whole = _inflate(view, at)
            found = list(_plain(inside)) if inside or not whole else []
            if not whole:
                reason = "member does not inflate or its checksum differs"
                for *_, record, _ in found:
                    if record is not None:
                        yield record | {"kind": "record", "start": at, "end": None}
            elif found and all(record is None for *_, record, _ in found):
                reason = found[0][3]
        elif raw.startswith(b"WARC/", at):
            record, end, reason = parse_record(raw, at)
            found = [(at, end, record, reason)]
        else:
            reason = "neither a member nor a version line"
        if not reason:
            if gap is not None:
                yield {"kind": "gap", "start": gap, "end": at, "reason": why}
                gap = None
            for low, high, record, why in found:
                if record is None:
                    yield {"kind": "inner gap", "start": at, "end": end, "reason": f"{why}: bytes {low} to {high} inside the member"}
                else:
                    yield record | {"kind": "record", "start": at, "end": end}
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        for mark, place in near.items():
            if place <= at:
                spot = raw.find(mark, at + 1)
                near[mark] = spot if spot >= 0 else len(raw)
        at = min(near.values())
    if gap is not None:
        yield {"kind": "gap", "start": gap, "end": len(raw), "reason": why}


def _salvaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for row in salvage(content.as_py()):
                rows.append(row | {"file": file.as_py()})
                size += len(row.get("payload") or b"") + 500
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record (kind 'record') and per quarantined run of bytes (kinds 'gap' and 'inner gap', with the reason).

    A file is read by one task, which holds it whole, as write_archives() bounds files (about
    SEGMENT_BYTES * SEGMENTS); foreign archives should be of a like size; see READ_SCHEMA.
    payload is null for revisits, whose payload_bytes and payload_digest are those of what they refer to.
    Empty files give no rows, files without any record one gap; records that are repeated are rows of
    their own. A payload of any length is read whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, READ_SCHEMA)


def page_number(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def page_report(read: DataFrame) -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest, record_type and refers_to."""
    return read.where("kind = 'record'").select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
