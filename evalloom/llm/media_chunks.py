"""Media columns: content-defined chunking of payloads.

A payload is a text's UTF-8 bytes, padded by zeros to a positive multiple of UNIT, as 8-bit samples. A rolling gear hash over the last 32 bytes cuts it
where its low bits are zero, between LEAST and MOST bytes. Chunks meet by their SHA-256 in hash slices, where each is stored once together with the
blocks that refer to it. Reading joins what the store sends to a block with the block's ordered chunk lists, checks every digest and
rebuilds each medium. Within a block equal payloads are one medium, so hot chunks and copies cost one reference a block.

The stored form of a medium is: EVCM1, payload length (8 bytes), chunks (4 bytes), length (4 bytes) and SHA-256 of each chunk, then the samples;
numbers are little-endian. Defined results: null text is empty, so its payload is one unit of zeros; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import textblocks as tb
from evalloom.runtime import materialize, ship, slices

UNIT = 64
LEAST, MOST, BITS = 1024, 16384, 12
BLOCK_BYTES = 24 << 20
LEVEL = 6
GEAR = (tb.mix(np.arange(1, 257, dtype=np.uint64) * tb.BASE) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[data[i - j]] << j over j < 32, by doubling the window."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w] << np.uint32(w)
    return h


def cuts(points: np.ndarray, lo: int, hi: int) -> list[int]:
    """Chunk ends of the payload data[lo:hi], by the positions after which the hash would cut."""
    out, at = [], lo
    while hi - at > LEAST:
        k = int(np.searchsorted(points, at + LEAST))
        end = min(int(points[k]) if k < len(points) else hi, at + MOST, hi)
        out.append(end)
        at = end
    if at < hi:
        out.append(hi)
    return out


def pad(n: int) -> int:
    return max(1, -(-n // UNIT)) * UNIT


def _part(digests: list[bytes], chunks: list[bytes]) -> bytes:
    return len(digests).to_bytes(4, "little") + b"".join(digests) + np.array(list(map(len, chunks)), dtype="<u4").tobytes() + zstandard.compress(b"".join(chunks), LEVEL)


def _unpart(body: bytes) -> tuple[list[bytes], list[bytes]]:
    n = int.from_bytes(body[:4], "little")
    digests = [body[4 + 32 * i : 36 + 32 * i] for i in range(n)]
    ends = np.cumsum(np.frombuffer(body, dtype="<u4", count=n, offset=4 + 32 * n).astype(np.int64)).tolist()
    raw = zstandard.decompress(body[4 + 36 * n :])
    return digests, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


SENT = "slice int, block long, kind int, body binary"


def _chunk(n_slices: int):
    """Chunks of a block by slices (kind 0) and its media with their documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[bytes, bytes] = {}
        media: dict[bytes, tuple[int, list[bytes]]] = {}
        docs: list[tuple[int, int, int]] = []
        held = 0
        numbers = tb.Numbers()

        def flush() -> pa.RecordBatch:
            block, by = numbers.take()[0], {}
            for d in sorted(chunks):
                by.setdefault(int.from_bytes(d[:4], "big") % n_slices, []).append(d)
            number = {d: i for i, d in enumerate(chunks)}
            lists = [v[1] for v in media.values()]
            ids, which, sizes = (np.array(x, dtype=np.int64) for x in zip(*docs, strict=True))
            manifest = [
                tb.pack(ids.astype(np.uint64), tb.narrow(which), tb.narrow(sizes)),
                tb.pack(np.array([v[0] for v in media.values()], dtype=np.uint64), np.array([len(x) for x in lists], dtype=np.uint32)),
                tb.pack(tb.narrow(np.array([number[d] for x in lists for d in x], dtype=np.int64))),
                b"".join(number),
            ]
            body = b"".join(len(m).to_bytes(4, "little") + m for m in manifest)
            rows = [(s, 0, _part(ds, [chunks[d] for d in ds])) for s, ds in by.items()] + [(int(tb.mix(np.array([block], dtype=np.uint64))[0]) % n_slices, 1, body)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "block", "kind", "body"])

        place: dict[bytes, int] = {}
        for batch in batches:
            ids, (offsets, data) = tb.ids_of(batch.column("doc_id")).tolist(), tb.utf8(batch.column("text"))
            for lo, hi in tb.parts(offsets):
                sizes = np.diff(offsets[lo : hi + 1]).tolist()
                begin = np.concatenate([[0], np.cumsum([pad(n) for n in sizes])]).tolist()
                buffer = np.zeros(begin[-1], dtype=np.uint8)
                for i, n in enumerate(sizes):
                    buffer[begin[i] : begin[i] + n] = data[offsets[lo + i] : offsets[lo + i] + n]
                points = np.flatnonzero((gear(buffer) & np.uint32((1 << BITS) - 1)) == 0) + 1
                raw = buffer.tobytes()
                for i, n in enumerate(sizes):
                    payload = raw[begin[i] : begin[i + 1]]
                    key = hashlib.sha256(payload).digest()
                    if key not in place:
                        own, at = [], begin[i]
                        for end in cuts(points, begin[i], begin[i + 1]):
                            piece = raw[at:end]
                            digest = hashlib.sha256(piece).digest()
                            if digest not in chunks:
                                chunks[digest] = piece
                                held += len(piece)
                            own.append(digest)
                            at = end
                        place[key] = len(media)
                        media[key] = len(payload), own
                    docs.append((ids[lo + i], place[key], n))
                if held >= BLOCK_BYTES or len(docs) >= 1 << 18:
                    yield flush()
                    chunks, media, docs, held, place = {}, {}, [], 0, {}
        if docs:
            yield flush()

    return run


STORE = "kind int, block long, digests binary, owners binary, data binary"


def _store(table: pa.Table) -> pa.Table:
    """Each chunk of a slice once, with the blocks that refer to it; block manifests pass."""
    seen: dict[bytes, int] = {}
    pieces: list[bytes] = []
    refs: list[tuple[int, int]] = []
    rows = []
    for block, kind, body in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "body")), strict=True):
        if kind:
            rows.append((1, block, None, None, body))
            continue
        for d, c in zip(*_unpart(body), strict=True):
            if d not in seen:
                seen[d] = len(pieces)
                pieces.append(c)
            refs.append((seen[d], block))
    if pieces:
        number, block = (np.array(x, dtype=np.uint64) for x in zip(*refs, strict=True))
        sizes = np.array(list(map(len, pieces)), dtype=np.uint32)
        rows.append((0, None, tb.pack(sizes) + b"".join(seen), tb.pack(tb.narrow(number), block), zstandard.compress(b"".join(pieces), LEVEL)))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "block", "digests", "owners", "data"])


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the stored chunks, what each block refers to."""
    for batch in batches:
        for digests, owners, data in zip(*(batch.column(c).to_pylist() for c in ("digests", "owners", "data")), strict=True):
            (sizes,) = tb.unpack(digests, 1)
            names, ends, raw = digests[5 + 4 * len(sizes) :], np.cumsum(sizes.astype(np.int64)), zstandard.decompress(data)
            number, block = tb.unpack(owners, 2)
            number = number.astype(np.int64)
            order = np.argsort(block, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                some = number[group].tolist()
                body = _part([names[32 * k : 32 * k + 32] for k in some], [raw[ends[k] - sizes[k] : ends[k]] for k in some])
                yield pa.RecordBatch.from_arrays([pa.array([int(block[group[0]])], pa.int64()), pa.array([body], pa.binary())], ["block", "body"])


def feature(samples: np.ndarray) -> str:
    """Level, spread, peak, entropy and mean crossings of 8-bit samples."""
    n = len(samples)
    counts = np.bincount(samples, minlength=256)
    level = float(counts @ np.arange(256)) / n
    spread = float(np.sqrt(max(0.0, float(counts @ (np.arange(256) - level) ** 2) / n)))
    p = counts[counts > 0] / n
    above = samples > level
    return f"level={level:.6f};spread={spread:.6f};peak={int(samples.max())};entropy={float(-(p * np.log2(p)).sum()):.6f};crossings={int(np.count_nonzero(above[1:] != above[:-1]))}"




RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def media_of(payload: bytes, chunks: list[bytes], digests: list[bytes]) -> bytes:
    """The stored form's head; the samples follow it."""
    return b"EVCM1" + struct.pack("<QI", len(payload), len(chunks)) + b"".join(struct.pack("<I", len(c)) + d for c, d in zip(chunks, digests, strict=True))


def _rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
    """The media of one block, from its ordered chunk lists and the stored chunks."""
    out: list[tuple] = []
    have: dict[bytes, bytes] = {}
    for body in right.column("body").to_pylist():
        for d, c in zip(*_unpart(body), strict=True):
            if hashlib.sha256(c).digest() != d:
                raise ValueError("a stored chunk doesn't match its digest")
            have[d] = c
    for manifest in left.column("data").to_pylist():
        parts, at = [], 0
        while at < len(manifest):
            n = int.from_bytes(manifest[at : at + 4], "little")
            parts.append(manifest[at + 4 : at + 4 + n])
            at += 4 + n
        ids, which, sizes = tb.unpack(parts[0], 3)
        lengths, counts = tb.unpack(parts[1], 2)
        (number,) = tb.unpack(parts[2], 1)
        names = [parts[3][32 * k : 32 * k + 32] for k in number.tolist()]
        values, k = [], 0
        for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            digests = names[k : k + n]
            chunks = [have[d] for d in digests]
            k += n
            payload = b"".join(chunks)
            if len(payload) != length:
                raise ValueError("a rebuilt payload has another length")
            head = media_of(payload, chunks, digests)
            whole = hashlib.sha256(head)
            whole.update(payload)
            values.append((length, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(head) + length, whole.hexdigest(), feature(np.frombuffer(payload, dtype=np.uint8)), n))
        for i, w, n in zip(ids.astype(np.int64).tolist(), which.tolist(), sizes.tolist(), strict=True):
            out.append((None if i == tb.NULL_ID else i, n, *values[w]))
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the chunk store of all payloads: columns of STORE, as a table in the shared folder."""
    ship(docs.sparkSession)
    n = slices(docs, 8 << 20, least=64)
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tb.tidy(_chunk(n)), SENT)
    return materialize(sent.groupBy("slice").applyInArrow(_store, STORE), "chunk_store")


def read_back(stored: DataFrame) -> DataFrame:
    """The columns of RESULT for every document, from the store alone."""
    served = stored.where("kind = 0").select("digests", "owners", "data").mapInArrow(tb.tidy(_serve), "block long, body binary")
    manifests = stored.where("kind = 1").select("block", "data")
    return manifests.groupBy("block").cogroup(served.groupBy("block")).applyInArrow(_rebuild, RESULT)
