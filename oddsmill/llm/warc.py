"""WARC archives: a de-duplicating writer and a salvage reader.

Writer: each record is a gzip member, and its closing CRLFCRLF a member of constant bytes, so Spark's own text writer
can put archives on any file system it knows: a row is a record's member, the line separator the closing member.
Decompressed, an archive is plain WARC/1.1. Of equal payloads the row with the largest id is written as response, all
others as revisit records without payload. Payloads move through one shuffle by id, and only those of responses; what
decides who is response are digests. Null payloads are empty; rows that repeat an id and a payload are all responses if
they are the largest; null ids are smallest; other columns are ignored; an empty table writes no record.

Reader: walks an archive, gzip or plain. When a check fails (gzip checksum, version line, header, length, closing bytes,
block or payload digest) it searches for the next member or version line that parses, goes on from there, and logs the
quarantined bytes as a gap with its reason. Records and gaps tile the file: none overlap, no byte is left out. A record that
says it is longer than it is ends where a new member begins with a header: it is quarantined at once, not read to the end of
the file. Where several records share a gzip member, the first has the member's bytes, and those after it none.

Archives are read whole by Spark's binaryFile source, one at a time per task, so they must stay below 2 GB. The writer begins
another one when ARCHIVE_BYTES or RECORDS_PER_FILE are reached; only a single record can make one larger.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, shuffles_freed, small_batches

#: Bytes and records of an archive, beyond which the next one begins.
ARCHIVE_BYTES, RECORDS_PER_FILE = 128 << 20, 20_000
#: Fixed values of the format.
VERSION, CLOSE, MAGIC = b"WARC/1.1", b"\r\n\r\n", b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
READ = "archive string, offset long, length long, kind string, page_id long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A record without its closing bytes; payload None makes it a revisit of refers_to."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + CLOSE + block


def numbered(members, archive_bytes: int):
    """Batches of (part, member) of an iterator of members: part goes up by one with each archive that is full."""
    part, held, rows = 0, 0, []
    for m in members:
        if held and held + len(m) > archive_bytes:
            part, held = part + 1, 0
        held += len(m)
        rows.append((part, m))
        if len(rows) >= 256:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "member"])


def _members(date: str, archive_bytes: int):
    def make(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
        return numbered((member(record(i, url, payload, base32_sha1(payload), len(payload), None, date)) for i, url, payload in rows), archive_bytes)

    return make


def _revisits(date: str, archive_bytes: int):
    def make(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return numbered((member(record(i, url, None, base64.b32encode(bytes.fromhex(sha)).decode(), n, keep, date)) for i, url, sha, n, keep in rows), archive_bytes)

    return make


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    facts = rows.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n"))
    # best is (is there an id, id): its size is one row for each distinct payload
    best = facts.groupBy("sha").agg(F.max("page_id").alias("keep"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    revisits = facts.join(best, "sha").where(~same("page_id", "keep")).select("page_id", "url", "sha", "n", "keep")
    chosen = best.select(F.col("keep").alias("k"), F.col("sha").alias("s"))
    responses = rows.join(hashed(chosen, pages.count()), same("page_id", "k") & same("sha", "s"), "left_semi").select("page_id", "url", "payload", F.lit(0).alias("keep"))
    members = responses.mapInArrow(_members(date, archive_bytes), "part int, member binary").unionByName(revisits.mapInArrow(_revisits(date, archive_bytes), "part int, member binary"))
    closing = member(CLOSE).decode("latin-1")
    with shuffles_freed(pages.sparkSession):
        members.select(F.col("member").cast("string").alias("value"), "part").write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", closing).option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _header(text: bytes) -> dict[str, str] | None:
    lines = text.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out if out.get("content-length", "").isdigit() and "warc-type" in out else None


def _one(data, at: int, final: bool):
    """The record at data[at:]: (end, header, block), a reason why there's none, or None if bytes are missing."""
    if not data.startswith(b"WARC/1.", at):
        return None if not final and len(data) - at < 7 and b"WARC/1.".startswith(bytes(data[at:])) else "no version line"
    head = data.find(CLOSE, at)
    if head < 0:
        return "header without end" if final or len(data) - at > 1 << 20 else None
    header = _header(bytes(data[at:head]))
    if header is None:
        return "bad header"
    start, end = head + 4, head + 4 + int(header["content-length"])
    if end + 4 > len(data):
        return "block cut short" if final else None
    if data[end : end + 4] != CLOSE:
        return "length does not meet the closing bytes"
    block = bytes(data[start:end])
    said = header.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        return "block digest differs"
    if header["warc-type"] == "response" and header.get("warc-payload-digest", "").startswith("sha1:") and header["warc-payload-digest"][5:] != base32_sha1(payload_of(header, block)):
        return "payload digest differs"
    return end + 4, header, block


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    return block.partition(CLOSE)[2] if header.get("content-type", "").startswith("application/http") else block


def _next_record(data, at: int, final: bool) -> int:
    """Where the next version line is at which a record can be read, or may be when more bytes come; -1 if there's none."""
    while (at := data.find(b"WARC/1.", at)) >= 0:
        if not isinstance(_one(data, at, final), str):
            return at
        at += 1
    return -1


def _plain(data, final: bool):
    """Records and gaps of decompressed bytes; the last item is ("rest", at, ...) with where the unread part starts."""
    at = 0
    while at < len(data):
        found = _one(data, at, final)
        if found is None:
            break
        if isinstance(found, str):
            nxt = _next_record(data, at + 1, final)
            to = len(data) if nxt < 0 else nxt
            yield "gap", at, to, found
            at = to
        else:
            end, header, block = found
            yield "record", at, end, (header, block)
            at = end
    yield "rest", at, at, None


def _begins_record(text: bytes) -> bool:
    """If decompressed bytes start with a version line and a whole header."""
    head = text.find(CLOSE, 0, 1 << 20) if text.startswith(b"WARC/1.") else -1
    return head >= 0 and _header(text[:head]) is not None


def salvage(data: bytes):
    """("record", offset, length, (header, block)) and ("gap", offset, length, reason): in order, they tile an archive's bytes.

    Offsets are those of the file: of the gzip members that a record begins in, or of its version line in a plain archive.
    """
    if not data.startswith(MAGIC) and data.find(b"WARC/1.", 0, 1 << 16) >= 0 or MAGIC not in data:
        yield from ((kind, at, end - at, what) for kind, at, end, what in _plain(data, True) if kind != "rest")
        return
    out = Unread()
    at = 0
    while at < len(data):
        reason, end = "no gzip member", at
        if data.startswith(MAGIC, at):
            try:
                text, end = _unpack(data, at)
                reason = ""
            except zlib.error as e:
                reason = str(e)
        if reason:
            nxt = data.find(MAGIC, at + 1)
            while nxt >= 0 and not _starts(data, nxt):
                nxt = data.find(MAGIC, nxt + 1)
            end = len(data) if nxt < 0 else nxt
            yield from out.read(True)
            yield "gap", out.since if out.since is not None else at, end - (out.since if out.since is not None else at), reason
            out.clear()
        else:
            if out.text and _begins_record(text):
                yield from out.read(True)
            out.add(at, end, text)
            yield from out.read(False)
        at = end
    yield from out.read(True)


class Unread:
    """Decompressed bytes not yet told as records or gaps, with the file positions at which their members begin and end."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.text, self.members, self.wanted, self.since, self.end = b"", [], 0, None, 0

    def add(self, start: int, end: int, text: bytes) -> None:
        if self.since is None:
            self.since = start
        self.members.append((len(self.text), start))
        self.text, self.end = self.text + text, end

    def place(self, at: int) -> int:
        """File position of a position in the text: that of its member if it is the member's first, else where the member ends."""
        for text_at, start in self.members:
            if text_at >= at:
                return start
        return self.end

    def read(self, final: bool):
        """Tells what can be told; with final, all of it."""
        if not self.text or not final and len(self.text) < self.wanted:
            return
        rest = 0
        for kind, at, end, what in _plain(self.text, final):
            if kind == "rest":
                rest = at
            else:
                first, last = self.place(at), self.place(end)
                first = self.since if at == 0 else first
                if kind == "record" or last > first:
                    yield kind, first, last - first, what
        since = self.place(rest)
        self.members = [(max(0, t - rest), start) for t, start in self.members if t >= rest]
        self.text = self.text[rest:]
        self.since = since if self.text else None
        # a record that has told its length isn't looked at again before it is whole
        head = self.text.find(CLOSE)
        header = _header(self.text[:head]) if head >= 0 else None
        self.wanted = head + 8 + int(header["content-length"]) if header else 0


def _unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at data[at:], and where it ends; zlib.error if it is damaged or cut short."""
    unpack, out = zlib.decompressobj(31), []
    while at < len(data) and not unpack.eof:
        some = memoryview(data)[at : at + (1 << 16)]
        out.append(unpack.decompress(some))
        at += len(some) - len(unpack.unused_data)
    if not unpack.eof:
        raise zlib.error("member cut short")
    return b"".join(out), at


def _starts(data: bytes, at: int) -> bool:
    """If a gzip member that begins a record can be opened here."""
    try:
        return zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 7).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(URN)
    return int(number) if number.lstrip("-").isdigit() else None


def reader(with_payload: bool):
    """mapInArrow function: (path, content) to READ."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.strip().split(" ")[0] for x in READ.split(",")]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for kind, offset, length, what in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((archive, offset, length, "gap: " + what, *[None] * 7))
                        continue
                    header, block = what
                    payload, again = payload_of(header, block), header["warc-type"] == "revisit"
                    size = int(header["x-payload-length"]) if again and header.get("x-payload-length", "").isdigit() else len(payload)
                    digest = header.get("warc-payload-digest", "").removeprefix("sha1:") if again else base32_sha1(payload)
                    rows.append((archive, offset, length, "record", _page(header.get("warc-record-id", "")), header.get("warc-target-uri"), header["warc-type"], _page(header.get("warc-refers-to", "")) if again else None, size, digest, payload if with_payload else None))
                    held += len(payload) * with_payload
                    if len(rows) >= 2048 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return read


def read_archives(spark: SparkSession, path: str, glob: str = "part-*", with_payload: bool = True) -> DataFrame:
    """Records (kind "record") and quarantined gaps (kind "gap: reason") of all archives in a folder."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != 1:  # a row is a whole archive here
        small_batches(spark, 512)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(reader(with_payload), READ)
