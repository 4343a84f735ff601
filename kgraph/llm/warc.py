"""WARC archives: a writer of one gzip member per record and a reader that salvages damaged files.

Writing goes through Spark's text sink, so archives land on whatever file system the path names. A gzip member
ends in the high byte of its 32-bit length, which is zero below 16 MiB; the sink's separator supplies that byte,
and records beyond that length are spread over several members. Equal payloads of at least `min_revisit` bytes
are stored once: the record with the smallest page_id is the response, the others revisit it.

A file takes FILE_BYTES of compressed records at most, or one record.

The reader checks each member's CRC, each record's version line, Content-Length, end mark and payload digest. It decodes
a member piece by piece, in time linear in the file, and gives each record as soon as it is whole. After a failed
check it looks for the next version line in the decoded bytes, then for the next place in the file where a valid member or
a version line starts, goes on from there, and reports the bytes between (of a damaged record inside a sound member: the
member) as a gap. A file is read whole, so archives of others may have 2 GiB at most.

Defined results: null html is an empty payload; payloads under `min_revisit` bytes are always responses; rows that
repeat the smallest page_id are responses too; null page_ids and urls are kept; an empty table gives an
archive without records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import new_path, slices, table

MIN_REVISIT, MEMBER_BYTES, FILE_BYTES, PIECE, LONGEST_HEAD = 100, (1 << 24) - 1, 1 << 27, 1 << 16, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_bytes(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """A response (first is None), or a revisit of the record with page_id `first`; the payload is its HTTP body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> list[bytes]:
    return [_gzip(data[i : i + MEMBER_BYTES]) for i in range(0, len(data), MEMBER_BYTES)]


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, first (the response's page_id for revisits, else null)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    recs = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    groups = recs.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    recs = recs.join(groups.where("_n > 1").drop("_n"), "digest", "left")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")), F.col("_first"))
    return recs.select("page_id", "url", "payload", "digest", first.alias("first"))


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    def run(batches):
        held = 0
        for piece in slices(batches, 100):
            parts, out = [], []
            for page_id, url, payload, digest, first in zip(*(piece.column(i).to_pylist() for i in range(5))):
                one = b"".join(members(record_bytes(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, first)))
                held += len(one)
                parts.append(held // FILE_BYTES)
                out.append(one[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int64())], names=["record", "part"])

    records = plan_records(pages, min_revisit).mapInArrow(run, "record binary, part long")
    records.select(F.col("record").cast("string").alias("value"), "part").write.option("lineSep", "\0").partitionBy("part").text(path)


class Damaged(ValueError):
    pass


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _record(buf, at: int = 0, longest: int | None = None):
    """(headers, block, end) of the record at `at`; None if more bytes are needed; Damaged if it can't be one. longest: of its headers."""
    if not _VERSION.match(buf, at):
        if len(buf) - at < 10:
            return None
        raise Damaged("no version line")
    stop = buf.find(b"\r\n\r\n", at, *([] if longest is None else [at + longest]))
    if stop < 0:
        if longest is not None and len(buf) - at > longest:
            raise Damaged("headers do not end")
        return None
    head = {}
    for line in bytes(buf[at:stop]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or b"\r" in line or b"\n" in line:
            raise Damaged("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise Damaged("no length")
    begin = stop + 4
    end = begin + int(head["content-length"])
    if end + 4 > len(buf):
        return None
    if buf[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end mark")
    return head, bytes(buf[begin:end]), end + 4


def _interpret(head: dict, block: bytes) -> dict:
    http, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise Damaged("no HTTP header")
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and digest and hashlib.sha256(body).hexdigest() != digest:
        raise Damaged("digest differs")
    m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    page = lambda k: int(x) if (x := re.sub(r"^<urn:page:|>$", "", head.get(k, ""))).lstrip("-").isdigit() else None
    url = head.get("warc-target-uri")
    return {"record_type": kind, "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"), "payload_digest": digest or hashlib.sha256(body).hexdigest(), "payload_bytes": int(m[1]) if m and kind == "revisit" else len(body), "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), "payload": body if kind == "response" else None}


def _taken(buf: bytearray, flaws: list[str]):
    """The whole records at the start of buf, which loses them; damaged ones are skipped up to the next version line."""
    at = 0
    while at < len(buf):
        try:
            got = _record(buf, at)
            if got is None:
                break
        except Damaged as e:
            flaws.append(str(e))
            m = _VERSION.search(buf, at + 1)
            if m is None:  # a version line may begin in the last bytes
                at = max(at + 1, len(buf) - 9)
                break
            at = m.start()
            continue
        at = got[2]
        try:
            record = _interpret(*got[:2])
        except Damaged as e:
            flaws.append(str(e))
            continue
        yield record
    del buf[:at]


def _before_error(member, last: int) -> bytes:
    """What the last bytes of a damaged member still decode to, up to the error."""
    z, out = zlib.decompressobj(31), []
    for lo in range(0, len(member) - last, PIECE):
        z.decompress(member[lo : min(lo + PIECE, len(member) - last)])
    try:
        for k in range(len(member) - last, len(member)):
            out.append(z.decompress(member[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def salvage(data: bytes):
    """Yield (offset, record) and (offset, (end, reason)) for gaps, in file order."""
    view, n = memoryview(data), len(data)
    at, gap, why = 0, None, ""
    buf, begin = bytearray(), 0  # decoded bytes of a record that goes on in the next member, and where it began
    while at < n:
        found, end, reason = [], None, ""
        if data[at : at + 3] == b"\x1f\x8b\x08":
            begin = begin if buf else at
            z, pos, flaws = zlib.decompressobj(31), at, []
            while not z.eof and pos < n and not reason:
                piece = view[pos : pos + PIECE]
                pos += len(piece)
                try:
                    buf += z.decompress(piece)
                except zlib.error as e:
                    reason = f"member: {e}"
                    buf += _before_error(view[at:pos], len(piece))
                for r in _taken(buf, flaws):
                    if gap is not None:
                        yield gap, (begin, why)
                        gap = None
                    yield begin, r
                    begin = at
            if z.eof:
                end = pos - len(z.unused_data)
                if buf and data[end : end + 3] != b"\x1f\x8b\x08":
                    flaws.append("cut off")
                    buf.clear()
                if flaws and gap is None:
                    gap, why = at, flaws[0]
            else:
                reason = reason or "member is cut off"
                buf.clear()
        else:
            buf.clear()
            try:
                got = _record(data, at, LONGEST_HEAD)
                if got is None:
                    raise Damaged("cut off")
                found, end = [_interpret(*got[:2])], got[2]
            except Damaged as e:
                reason = str(e)
        if reason:
            if gap is None:
                gap, why = at, reason
            m = _START.search(data, at + 1)
            at = m.start() if m else n
            continue
        for r in found:
            if gap is not None:
                yield gap, (at, why)
                gap = None
            yield at, r
        at = end
        if gap is not None and gap < at and not found and not buf:
            yield gap, (at, why)
            gap = None
    if gap is not None:
        yield gap, (n, why)


ENTRY = "file string, offset long, gap_end long, reason string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record or quarantined gap (record_type null, gap_end and reason set)."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ENTRY.split(", "))])

    def run(batches):
        for piece in slices(batches, 1):
            file, content = piece.column(0)[0].as_py(), piece.column(1)[0].as_py()
            rows, held = [], 0
            for at, got in salvage(content):
                r = {"gap_end": got[0], "reason": got[1]} if isinstance(got, tuple) else {**got, "payload": got["payload"] if payloads else None}
                rows.append({"file": file, "offset": at, **r})
                held += len(rows[-1].get("payload") or b"")
                if len(rows) >= 200 or held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "content")
    return files.mapInArrow(run, ENTRY)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payloads=False).where("record_type IS NOT NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH r AS (SELECT page_id, url, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, url, octet_length(encode(p))::BIGINT AS payload_bytes, sha256(p) AS payload_digest FROM r),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
