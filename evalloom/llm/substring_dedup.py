"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeated windows merge into maximal removal intervals.

Each task hashes all windows of its texts and keeps the first of each hash in its block; the others are repeats at once.
The firsts go to slices by the hash's leading bits, where all occurrences of a hash meet and the one with the smallest
(doc_id, start) stays. As a block sends each hash at most once, a window that a third of all documents share costs a slice
one entry a block. Repeats return by buckets of documents as removal intervals, which the texts are joined with.
Windows are told apart by 88 bits: a 64-bit hash and 24 bits of another polynomial of other word hashes (n windows share one with a probability of about n^2 / 2^89).

Defined results: null text and texts below `size` words lose nothing; a null doc_id comes before all others; rows of one doc_id, null or not, with different texts
are different documents, in order of a hash of the text; those with equal texts are one document; other columns, whatever their names, pass through or are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import textblocks as tb
from evalloom.runtime import global_index, materialize, ship, slices

BLOCK_WINDOWS = 1 << 20


def _send(key: np.ndarray, blobs: list[bytes], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "kind", "body"])


SENT = "slice int, kind int, body binary"


def _by_bucket(doc: np.ndarray, start: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Windows of documents, as one blob a bucket: distinct ids with counts, then starts."""
    bucket = (tb.mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, bucket))
    doc, start, bucket = doc[order], start[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=np.int64)
    keys, blobs = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        ids, counts = np.unique(doc[a:b], return_counts=True)
        keys.append(int(bucket[a]))
        blobs.append(len(ids).to_bytes(4, "little") + ids.astype("<i8").tobytes() + tb.pack(tb.narrow(counts)) + tb.pack(tb.narrow(start[a:b])))
    return keys, blobs


def _from_bucket(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    ids = np.frombuffer(blob, dtype="<i8", count=n, offset=4)
    (counts,) = tb.unpack(blob[4 + 8 * n :], 1)
    (start,) = tb.unpack(blob[4 + 8 * n + 5 + n * counts.dtype.itemsize :], 1)
    return np.repeat(ids, counts.astype(np.int64)), start.astype(np.int64)


def _block(h: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    sorted_already = len(doc) < 2 or (doc[1:] >= doc[:-1]).all()
    order, first = tb.by_key(h, check) if sorted_already else tb.by_key(h, check, doc, start)
    h, check, doc, start = h[order], check[order], doc[order], start[order]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    later = ~first & ((doc != doc[lead]) | (start != start[lead]))
    keys, blobs = _by_bucket(doc[later], start[later], buckets)
    if keys:
        yield _send(np.array(keys) % (1 << bits), [k.to_bytes(4, "little") + b for k, b in zip(keys, blobs, strict=True)], 1)
    h, check, doc, start = h[first], check[first], doc[first], start[first]
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.searchsorted(at, np.arange((1 << bits) + 1))
    low = int(doc.min()) if len(doc) else 0
    off = tb.narrow((doc - low).astype(np.uint64))
    start, raw, more = tb.narrow(start), tb.low(h, 5), tb.low(check, 3)
    high = h >> np.uint64(40) & np.uint64(0xFFFF)  # of a slice's 56 bits: ascending, so differences are small
    some = np.flatnonzero(np.diff(cut))
    for group in np.array_split(some, max(1, len(some) // 256)):
        blobs = [low.to_bytes(8, "little", signed=True) + tb.pack(off[cut[s] : cut[s + 1]], start[cut[s] : cut[s + 1]], tb.narrow(np.diff(high[cut[s] : cut[s + 1]], prepend=np.uint64(0)))) + raw[cut[s] : cut[s + 1]].tobytes() + more[cut[s] : cut[s + 1]].tobytes() for s in group]
        if blobs:
            yield _send(group, blobs, 0)


def _joined(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The columns of a block; the list is emptied, so that its parts don't stay beside them."""
    out = [np.concatenate(c) for c in zip(*held, strict=True)]
    held.clear()
    return out


def _hash_windows(size: int, bits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            ids, (offsets, data) = tb.ids_of(batch.column("doc_id")), tb.utf8(batch.column("text"))
            for lo, hi in tb.parts(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                first, starts, ends = tb.words(off, part)
                words = tb.word_hashes(part, starts, ends, False)
                h, row, start = tb.windows(words, first, size)
                held.append((h, tb.window_checks(words, first[row] + start, size), ids[lo:hi][row], start))
                n += len(h)
                if n >= BLOCK_WINDOWS:
                    yield from _block(*_joined(held), bits, buckets)
                    n = 0
        if n:
            yield from _block(*_joined(held), bits, buckets)

    return run


def _meet(buckets: int):
    """All occurrences of the hashes of one slice: what isn't the first of its hash, by buckets of documents."""

    def run(table: pa.Table) -> pa.Table:
        hashes, checks, docs, starts, keys, blobs = [], [], [], [], [], []
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            if kind:
                keys.append(int.from_bytes(body[:4], "little"))
                blobs.append(body[4:])
                continue
            low = int.from_bytes(body[:8], "little", signed=True)
            off, start, rise = tb.unpack(body[8:], 3)
            hashes.append(np.cumsum(rise, dtype=np.uint64) << np.uint64(40) | tb.from_low(body, len(off), len(body) - 8 * len(off), 5))
            checks.append(tb.from_low(body, len(off), len(body) - 3 * len(off), 3))
            docs.append((off.astype(np.uint64) + np.uint64(low & (1 << 64) - 1)).astype(np.int64))
            starts.append(start.astype(np.int64))
        if hashes:
            h, check, doc, start = map(np.concatenate, (hashes, checks, docs, starts))
            order = np.argsort(h)
            s = h[order]
            same = np.zeros(len(s), dtype=bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= same[1:]
            take = order[same]
            h, check, doc, start = h[take], check[take], doc[take], start[take]
            order, first = tb.by_key(h, check, doc, start)
            h, doc, start = h[order], doc[order], start[order]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) if len(h) else np.zeros(0, dtype=np.int64)
            later = ~first & ((doc != doc[lead]) | (start != start[lead]))
            more = _by_bucket(doc[later], start[later], buckets)
            keys += more[0]
            blobs += more[1]
        return pa.table([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "body"])

    return run


def _intervals(size: int):
    def run(table: pa.Table) -> pa.Table:
        got = [_from_bucket(b) for b in table.column("body").to_pylist()]
        doc, start = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(doc)) - 1
        ids, cut = np.unique(doc[at], return_index=True)
        offsets = pa.array(np.append(cut, len(at)), pa.int32())
        return pa.table([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(start[at], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(start[last] + size, pa.int32()))], ["__id", "starts", "ends"])

    return run


def removal_intervals(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, starts, ends): maximal word intervals covered by windows that occur earlier; only documents with some."""
    ship(docs.sparkSession)
    n = slices(docs, 1 << 20)
    bits, buckets = n.bit_length() - 1, max(64, n // 4)
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tb.tidy(_hash_windows(size, bits, buckets)), SENT)
    met = sent.groupBy("slice").applyInArrow(_meet(buckets), "bucket int, body binary")
    found = met.groupBy("bucket").applyInArrow(_intervals(size), "__id long, starts array<int>, ends array<int>")
    return materialize(found, "removal_intervals")


def _cut(text: bytes, starts, ends) -> tuple[int, int, list[bytes]]:
    tokens = text.split()
    kept, at, removed = [], 0, 0
    for a, b in zip(starts or (), ends or (), strict=True):
        b = min(b, len(tokens))
        a = min(a, b)
        kept += tokens[at:a]
        removed += b - a
        at = b
    return len(tokens), removed, kept + tokens[at:] if at else tokens


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = tb.utf8(batch.column("text"))
        raw, rows = data.tobytes(), []
        for i, (s, e) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            n, gone, kept = _cut(raw[offsets[i] : offsets[i + 1]], s, e)
            rows.append((n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a document number in order of doc_id: the id itself, or where ids repeat the ordinal by id and hash of the text."""
    doc, print_, count = (tb.fresh([*docs.columns, name], c) for c in ("doc", "print", "count"))
    rows = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(tb.NULL_ID)))
    if rows.groupBy(name).agg(F.count("*").alias(count)).where(F.col(count) > 1).isEmpty():
        return rows
    rows = rows.withColumnRenamed(name, doc).withColumn(print_, F.xxhash64(F.col("text").cast("string")))
    numbers = materialize(global_index(rows.select(doc, print_).distinct(), [doc, print_], name), "document_numbers")
    return rows.join(numbers, [doc, print_]).select(*docs.columns, name)


def _with_intervals(docs: DataFrame, size: int, number: str, starts: str, ends: str) -> DataFrame:
    left = _numbered(docs, number)
    found = removal_intervals(left.select(F.col(number).alias("doc_id"), F.col("text").cast("string").alias("text")), size)
    return left.hint("merge").join(found.select(F.col("__id").alias(number), F.col("starts").alias(starts), F.col("ends").alias(ends)), number, "left")


def removal_report(docs: DataFrame, size: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    both = _with_intervals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, "number", "starts", "ends")
    return both.select("doc_id", "text", "starts", "ends").mapInArrow(tb.tidy(_apply), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the removed words; the white space between kept words stays, untouched texts stay as they are. The last two columns are the starts and ends."""
    for batch in batches:
        offsets, data = tb.utf8(batch.column("text"))
        out = []
        nulls = batch.column("text").is_null().to_pylist()
        for i, (s, e) in enumerate(zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)):
            part = data[offsets[i] : offsets[i + 1]]
            if not s:
                out.append(part.tobytes().decode())
                continue
            _, begin, _ = tb.words(np.array([0, len(part)]), part)
            begin, raw, at, kept = np.append(begin, len(part)), part.tobytes(), 0, []
            for a, b in zip(s, e, strict=True):
                kept.append(raw[at : begin[min(a, len(begin) - 1)]])
                at = int(begin[min(b, len(begin) - 1)])
            out.append(b"".join([*kept, raw[at:]]).decode().strip())
        table = dict(zip(batch.schema.names[:-2], batch.columns[:-2], strict=True))
        table["text"] = pa.array([None if null else x for null, x in zip(nulls, out, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(list(table.values()), list(table))


def drop_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """docs with repeated passages removed from the texts; the other columns are as they were."""
    plain = docs.withColumn("text", F.col("text").cast("string"))
    number, starts, ends = (tb.fresh(docs.columns, c) for c in ("number", "starts", "ends"))
    both = _with_intervals(plain, size, number, starts, ends)
    return both.select(*plain.columns, starts, ends).mapInArrow(tb.tidy(_rewrite), plain.schema)
