"""WARC: archives as a table of chunks.

A record is one gzip member. Its stored bytes lie in rows (record, chunk, data) of at most about CHUNK bytes, each with the running CRC-32 and length of the record's stored
bytes so far; the last row also has the payload's SHA-256. Writer and reader stream: payloads go through the compressor and the digest a slice at a time, chunks leave the
writer BATCH bytes at a time, inside a record too, and a reader holds one chunk. Concatenated in order of record and chunk, the data are a .warc.gz file.

Payloads of REVISIT bytes or more that are equal share one response, that of the smallest id; the others are revisit records. Records of one chunk are read where they lie;
only those of several chunks are brought together and sorted.

Defined results: null html is empty; a null url is written as about:blank; null ids count as the smallest id and return as null;
rows that repeat the smallest id of a payload are responses too.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.textblocks import NULL_ID, Numbers
from evalloom.runtime import materialize, ship

CHUNK = 64 << 10
BATCH = 4 << 20
REVISIT = 100
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "record long, chunk int, last boolean, data binary, stored_bytes long, stored_crc32 long, payload_sha256 string"


def _uri(page: int) -> str:
    return f"<urn:page:{page}>"


def heads(page: int, url: str | None, digest: str, size: int, first: int | None) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header) of a response, or of a revisit to the page `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if first is None else 0)}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(first)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROW.split(", ")]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    rows: list[tuple] = []
    held = 0
    numbers = Numbers()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        html = batch.column("html")
        for i, (page, url, digest, size, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "url", "digest", "size", "first")), strict=True)):
            revisit = first is not None and first != page
            head, http = heads(page, url, digest, size, first if revisit else None)
            payload = memoryview(b"" if revisit else (html[i].as_buffer() or b""))
            record, squeeze, sha = numbers.take()[0], zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha256()
            buffer, number, total, crc = bytearray(squeeze.compress(head + http)), 0, 0, 0
            for at in range(0, len(payload), CHUNK):
                piece = payload[at : at + CHUNK]
                sha.update(piece)
                buffer += squeeze.compress(piece)
                while len(buffer) > CHUNK:
                    data, buffer = bytes(buffer[:CHUNK]), buffer[CHUNK:]
                    total, crc = total + len(data), zlib.crc32(data, crc)
                    rows.append((record, number, False, data, total, crc, None))
                    number, held = number + 1, held + len(data)
                    if held >= BATCH - CHUNK:
                        yield out()
                        rows, held = [], 0
            buffer += squeeze.compress(b"\r\n\r\n") + squeeze.flush()
            if not revisit and sha.hexdigest() != digest:
                raise ValueError("a payload changed while it was written")
            data = bytes(buffer)
            rows.append((record, number, True, data, total + len(data), zlib.crc32(data, crc), digest))
            held += len(data)
            if held >= BATCH - CHUNK:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


class _Reader:
    """One record, fed a chunk at a time."""

    def __init__(self):
        self.squeeze, self.head, self.warc, self.http, self.sha, self.left, self.crc = zlib.decompressobj(31), b"", None, None, hashlib.sha256(), 0, 0

    def feed(self, data: bytes, crc: int) -> None:
        self.crc = zlib.crc32(data, self.crc)
        if self.crc != crc:
            raise ValueError("a stored chunk doesn't match its running CRC-32")
        full = True
        while data or full:  # a full piece may leave output behind in the decompressor
            raw = self.squeeze.decompress(data, CHUNK)
            self.take(raw)
            data, full = self.squeeze.unconsumed_tail, len(raw) == CHUNK

    def take(self, raw: bytes) -> None:
        if self.http is None:
            self.head += raw
            if self.warc is None and b"\r\n\r\n" in self.head:
                top, self.head = self.head.split(b"\r\n\r\n", 1)
                self.warc = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
            if self.warc is None or b"\r\n\r\n" not in self.head:
                return
            top, raw = self.head.split(b"\r\n\r\n", 1)
            self.http = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
            self.left = int(self.warc["Content-Length"]) - len(top) - 4
        body = raw[: self.left]
        self.left -= len(body)
        self.sha.update(body)

    def result(self) -> tuple:
        page = lambda k: int(self.warc[k][10:-1])
        kind, digest = self.warc["WARC-Type"], self.warc["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.left or not self.squeeze.eof or self.squeeze.unused_data or kind == "response" and self.sha.hexdigest() != digest:
            raise ValueError("a record is damaged")
        return page("WARC-Record-ID"), int(self.http["Content-Length"]), digest, kind, page("WARC-Refers-To") if kind == "revisit" else None


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_record, reader = None, None
    for batch in batches:
        out = []
        for record, chunk, last, data, crc in zip(*(batch.column(c).to_pylist() for c in ("record", "chunk", "last", "data", "stored_crc32")), strict=True):
            if chunk == 0:
                open_record, reader, expected = record, _Reader(), 0
            if record != open_record or chunk != expected:
                raise ValueError("chunks of a record are missing or out of order")
            expected += 1
            reader.feed(data, crc)
            if last:
                out.append(reader.result())
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in PAGES.split(", ")])


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The record table of all pages: columns of ROW, in the shared folder."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    # short payloads have keys of their own, or empty pages would be one hot key
    key = F.when(F.col("size") >= REVISIT, F.col("digest")).otherwise(F.concat(F.lit("page "), F.col("page").cast("string")))
    rows = rows.withColumn("key", key)
    firsts = rows.where(F.col("size") >= REVISIT).groupBy("key").agg(F.min("page").alias("first"))
    both = rows.hint("merge").join(firsts, "key", "left").select("page", "url", "html", "digest", "size", "first")
    return materialize(both.mapInArrow(_write, ROW), "warc_records")


def read_archive(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from its stored chunks."""
    columns = ["record", "chunk", "last", "data", "stored_crc32"]
    whole = records.where("chunk = 0 AND last").select(*columns)
    several = records.where("NOT (chunk = 0 AND last)").select(*columns).repartition("record").sortWithinPartitions("record", "chunk")
    out = whole.mapInArrow(_read, PAGES).unionByName(several.mapInArrow(_read, PAGES))
    return out.select(F.nullif("page_id", F.lit(NULL_ID)).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.nullif("refers_to", F.lit(NULL_ID)).alias("refers_to"))
