"""Packing: deficit round-robin over source queues.

Texts are tokenized once into a written table. Shards take rows by hash of their number, so ids that repeat or are null make no hot shard; in a shard every source is a queue. Each round adds a source's
target share of one window to its deficit and serves packets (whole documents, or PACKET ids of longer ones) while the deficit covers
them; what isn't served is carried to the next window. Between shards deficits carry in closed form: target share times all tokens of the earlier
shards, less the source's own tokens there. The stream is cut into full windows; the rest of a shard goes to windows of powers of two, so nothing is padded.

Targets are token shares by source; by default those of the corpus. Defined results: null text is empty and has the end id alone; a null source is a
source of its own; repeated rows are packed as often as they occur; sources without a target are served as soon as there is room.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import textblocks as tb
from evalloom.llm import tokens
from evalloom.runtime import materialize, ship, sums_before

WINDOW = 2048
PACKET = 512
SHARD_TOKENS = 500_000
END_ID = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


TOKENS = "uid long, doc_id long, source string, n int, ids binary"


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = tb.Numbers()
        for batch in batches:
            offsets, data = tb.utf8(batch.column("text"))
            inner = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=inner[1:])
            for lo, hi in tb.parts(offsets):
                text = data[offsets[lo] : offsets[hi]].tobytes().decode()
                ids, at = tokens.encode(text, np.diff(inner[offsets[lo : hi + 1]]), path)
                end = np.array([end_id], dtype=ids.dtype).tobytes()
                blobs = [ids[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers.take(len(blobs)), pa.int64()), part.column("doc_id"), part.column("source"), pa.array(np.diff(at) + 1, pa.int32()), pa.array(blobs, pa.binary())],
                    ["uid", "doc_id", "source", "n", "ids"],
                )

    return run


class Queues:
    """Deficit round-robin over queues of (uid, tokens)."""

    def __init__(self, queues: dict, share: dict, deficit: dict):
        self.queues, self.share, self.deficit = queues, share, deficit

    def stream(self, quantum: int, packet: int) -> Iterator[tuple[int, int, int]]:
        """(uid, start, length) in the order served."""
        at = dict.fromkeys(self.queues, 0)
        while self.queues:
            total = sum(self.share[s] for s in self.queues) or 1.0
            for s in list(self.queues):
                queue, d = self.queues[s], self.deficit[s] + quantum * (self.share[s] or total / len(self.queues)) / total
                while queue:
                    uid, n = queue[0]
                    size = min(packet, n - at[s])
                    if size > d:
                        break
                    yield uid, at[s], size
                    d -= size
                    at[s] += size
                    if at[s] == n:
                        queue.popleft()
                        at[s] = 0
                self.deficit[s] = d
                if not queue:
                    del self.queues[s]


def windows(stream: Iterator[tuple[int, int, int]], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(uid, start, length, sequence, offset): full windows, then powers of two for the rest."""
    sequence, room, waiting, held = 0, window, [], 0
    # the last window is only cut when its length is known
    for uid, start, n in stream:
        while n:
            take = min(n, room)
            if waiting and waiting[-1][0] == uid and waiting[-1][1] + waiting[-1][2] == start:
                waiting[-1][2] += take
            else:
                waiting.append([uid, start, take])
            start, n, room, held = start + take, n - take, room - take, held + take
            if room == 0:
                offset = 0
                for u, s, k in waiting:
                    yield u, s, k, sequence, offset
                    offset += k
                sequence, room, waiting, held = sequence + 1, window, [], 0
    size, offset = 1 << held.bit_length() >> 1, 0
    for uid, start, n in waiting:
        while n:
            take = min(n, size - offset)
            yield uid, start, take, sequence, offset
            start, n, offset, held = start + take, n - take, offset + take, held - take
            if offset == size:
                sequence, size, offset = sequence + 1, 1 << held.bit_length() >> 1, 0


PLAN = "uid long, pieces binary"


def _plan(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    columns = [table.column(c).to_pylist() for c in ("source", "doc_id", "uid", "n", "share", "owed")]
    queues: dict = {}
    share, deficit = {}, {}
    for source, _, uid, n, part, owed in sorted(zip(*columns, strict=True), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2])):
        queues.setdefault(source, deque()).append((uid, n))
        share[source], deficit[source] = part, owed
    pieces: dict[int, list[tuple[int, ...]]] = {}
    base = key[0].as_py() << 32
    for uid, *piece, sequence, offset in windows(Queues(queues, share, deficit).stream(WINDOW, PACKET), WINDOW):
        pieces.setdefault(uid, []).append((*piece, base + sequence, offset))
    blobs = [tb.pack(*(tb.narrow(np.array(c, dtype=np.int64)) for c in zip(*p, strict=True))) for p in pieces.values()]
    return pa.table([pa.array(pieces, pa.int64()), pa.array(blobs, pa.binary())], ["uid", "pieces"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut(itemsize: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, source, n, blob, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "ids", "pieces")), strict=True):
                ids = np.frombuffer(blob, dtype=f"<u{itemsize}").astype("<u4")
                for start, length, sequence, offset in zip(*(c.tolist() for c in tb.unpack(pieces, 4)), strict=True):
                    raw = ids[start : start + length].tobytes()
                    for o, v in zip(out, (doc, start, length, zlib.crc32(raw), n, sequence, offset, source, raw), strict=True):
                        o.append(v)
            arrays = [*(pa.array(o, pa.int64()) for o in out[:7]), pa.array(out[7], pa.string())]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[8], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The columns of PIECES (with_ids: and the ids as little-endian unsigned 32-bit); each id of each document lies in exactly one piece."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    coded = materialize(source.mapInArrow(tb.tidy(_tokenize(path, end_id)), TOKENS), "token_ids")
    light = coded.select("uid", "doc_id", "source", "n")
    total = light.agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(total / SHARD_TOKENS))
    light = light.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))

    cells = light.groupBy("shard", "source").agg(F.sum("n").alias("t"))
    whole = cells.groupBy("source").agg(F.sum("t").alias("all"))
    if targets is None:
        whole = whole.withColumn("share", F.col("all") / F.lit(float(max(total, 1))))
    else:
        wanted = F.lit(0.0)
        for name, value in targets.items():
            wanted = F.when(F.col("source") == name, F.lit(float(value))).otherwise(wanted)
        whole = whole.withColumn("share", wanted)
    before = sums_before(cells.groupBy("shard").agg(F.sum("t").alias("t")), [], "shard", "t", "before").select("shard", "before")
    own = sums_before(cells, ["source"], "shard", "t", "own")
    owed = own.join(before, "shard").join(whole.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("shard").alias("k"), F.col("source").alias("s"), "share", (F.col("share") * F.col("before") - F.col("own")).alias("owed"))
    rows = light.join(owed, (F.col("shard") == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))).select("shard", "uid", "doc_id", "source", "n", "share", "owed")
    plan = rows.groupBy("shard").applyInArrow(_plan, PLAN)
    both = coded.hint("merge").join(plan, "uid").select("doc_id", "source", "n", "ids", "pieces")
    return both.mapInArrow(_cut(int(tokens.id_type(path)[2:]), with_ids), PIECES + (", ids binary" if with_ids else ""))
