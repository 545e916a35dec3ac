"""N-gram Jaccard join by prefix tree.

Every document becomes the set of its distinct word shingles, as 64-bit hashes. Slices by leading bits of the hash count in how many
documents a shingle occurs; one that occurs once can't be shared, so only documents whose shared part reaches the threshold go
on. Equal sets are one class. The classes' sets are put in one global order (rare shingles first, then by hash); two sets that
reach the threshold share a shingle of their prefixes, so components over prefix shingles split the join into groups. In a
group, sets enter a path-compressed trie one by one, each after walking it: paths share the overlap counted so far, and a subtree is left
when the remaining lengths can't reach the threshold, or when all its sets are already linked with the walking one. A group with many sets
is cut into chunks and joined chunk by chunk. Each task returns a spanning forest of its links, never all pairs.

Defined results: without words a document is linked with nothing; with fewer words than a shingle has, the whole sequence is its only shingle;
rows of one doc_id with equal texts are one document; null ids count as the smallest id and return as null. Where ids repeat, null or not, rows go by a
64-bit hash of id and text instead, so that different texts of one id stay different documents; a component is still named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import textblocks as tb
from evalloom.llm.components import connected_components
from evalloom.runtime import materialize, ship, slices

BLOCK_SHINGLES = 1 << 20
CHUNKS, LEAST_CHUNK, MOST_CHUNK = 32, 64, 1024
SALT = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles, by row and hash; set sizes."""
    first, starts, ends = tb.words(offsets, data)
    h = tb.word_hashes(data, starts, ends, True)
    out, row, _ = tb.windows(h, first, size)
    lens = np.diff(first)
    short = np.flatnonzero((lens > 0) & (lens < size))
    if len(short):
        whole = []
        for r in short:
            x = np.uint64(lens[r])
            for v in h[first[r] : first[r + 1]]:
                with np.errstate(over="ignore"):
                    x = x * tb.BASE + v
            whole.append(x)
        out, row = np.append(out, tb.mix(np.array(whole, dtype=np.uint64))), np.append(row, short)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, row, np.bincount(row, minlength=len(lens))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True]) if len(sorted_keys) else np.zeros(1, dtype=np.int64)


def _infos(ids, n, f1, f2, buckets: int, n_slices: int) -> pa.RecordBatch:
    b = _bucket(ids, buckets)
    order = np.argsort(b, kind="stable")
    keys, blobs = [], []
    cut = _cuts(b[order])
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        at = order[lo:hi]
        keys.append(int(b[at[0]]))
        blobs.append(keys[-1].to_bytes(4, "little") + tb.pack(ids[at].astype(np.uint64), n[at].astype(np.uint32), f1[at], f2[at]))
    return _rows(np.array(keys) % n_slices, 1, blobs)


def _rows(keys, kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "kind", "body"])


def _block(h: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    new = _cuts(h)
    u, counts = h[new[:-1]], tb.narrow(np.diff(new))
    low = int(ids.min())
    off, raw = tb.narrow((ids - low).astype(np.uint64)), tb.low7(u)
    cut = np.searchsorted((u >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    some = np.flatnonzero(np.diff(cut))
    for group in np.array_split(some, max(1, len(some) // 256)):
        blobs = []
        for s in group:
            a, b = cut[s], cut[s + 1]
            blobs.append(low.to_bytes(8, "little", signed=True) + tb.pack(counts[a:b]) + raw[a:b].tobytes() + tb.pack(off[new[a] : new[b]]))
        if blobs:
            yield _rows(group, 0, blobs)


def _sets(size: int, bits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_n = 0
        for batch in batches:
            ids, (offsets, data) = tb.ids_of(batch.column("doc_id")), tb.utf8(batch.column("text"))
            for lo, hi in tb.parts(offsets):
                h, row, n = shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], size)
                prints = []
                for salt in SALT:
                    f = np.zeros(len(n), dtype=np.uint64)
                    if len(h):
                        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                        f[row[at]] = np.add.reduceat(tb.mix(h ^ salt), at)
                    prints.append(f)
                yield _infos(ids[lo:hi], n, *prints, buckets, 1 << bits)
                held.append((h, ids[lo:hi][row]))
                held_n += len(h)
                if held_n >= BLOCK_SHINGLES:
                    yield from _block(*map(np.concatenate, zip(*held, strict=True)), bits)
                    held, held_n = [], 0
        if held_n:
            yield from _block(*map(np.concatenate, zip(*held, strict=True)), bits)

    return run


def _count(bits: int, buckets: int):
    """The shingles of one slice: those of two documents or more, with their counts, by buckets of documents."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, kinds, blobs, hs, ds = [], [], [], [], []
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            if kind:
                keys.append(int.from_bytes(body[:4], "little"))
                kinds.append(1)
                blobs.append(body[4:])
                continue
            low = int.from_bytes(body[:8], "little", signed=True)
            (counts,) = tb.unpack(body[8:], 1)
            at = 8 + 5 + len(counts) * counts.dtype.itemsize
            u = tb.from7(body, len(counts), at)
            (off,) = tb.unpack(body[at + 7 * len(counts) :], 1)
            hs.append(np.repeat(u, counts.astype(np.int64)))
            ds.append((off.astype(np.uint64) + np.uint64(low & (1 << 64) - 1)).astype(np.int64))
        if hs:
            h, d = np.concatenate(hs), np.concatenate(ds)
            order = np.argsort(h)
            s = h[order]
            same = np.zeros(len(s), dtype=bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= same[1:]
            at = order[same]
            at = at[np.lexsort((d[at], h[at]))]
            h, d = h[at], d[at]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[once], d[once]
            cut = _cuts(h)
            df = np.repeat(np.diff(cut), np.diff(cut))
            h |= np.uint64(key[0].as_py()) << np.uint64(64 - bits)
            h, d, df = h[df > 1], d[df > 1], df[df > 1]
            b = _bucket(d, buckets)
            order = np.argsort(b, kind="stable")
            cut = _cuts(b[order])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                at = order[lo:hi]
                at = at[np.argsort(d[at], kind="stable")]
                low = int(d[at[0]])
                keys.append(int(b[at[0]]))
                kinds.append(0)
                blobs.append(low.to_bytes(8, "little", signed=True) + tb.pack(h[at], tb.narrow((d[at] - low).astype(np.uint64)), tb.narrow(df[at])))
        return pa.table([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "body"])

    return run


CANDIDATE = "doc_id long, n int, f1 long, f2 long, prefix array<long>, body binary"


def _assemble(percent: int):
    """Documents of one bucket; those whose shared shingles reach the threshold carry them in the global order."""

    def run(table: pa.Table) -> pa.Table:
        infos, shared = [], []
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            if kind:
                infos.append(tb.unpack(body, 4))
            else:
                low = int.from_bytes(body[:8], "little", signed=True)
                h, off, df = tb.unpack(body[8:], 3)
                shared.append((h, (off.astype(np.uint64) + np.uint64(low & (1 << 64) - 1)).astype(np.int64), df.astype(np.int64)))
        ids, n, f1, f2 = (np.concatenate(x) for x in zip(*infos, strict=True)) if infos else (np.zeros(0, dtype=np.uint64),) * 4
        ids, n = ids.astype(np.int64), n.astype(np.int64)
        prefixes: list = [None] * len(ids)
        bodies: list = [None] * len(ids)
        if shared:
            h, d, df = (np.concatenate(x) for x in zip(*shared, strict=True))
            order = np.lexsort((h, df, d))
            h, d, df = h[order], d[order], df[order]
            cut = _cuts(d)
            where = {int(d[a]): (a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)}
            for i, (doc, size) in enumerate(zip(ids.tolist(), n.tolist(), strict=True)):
                a, b = where.get(doc, (0, 0))
                need = -(-percent * size // 100)
                if size and b - a >= need:
                    # of the prefix of size - need + 1 shingles, those of this document alone come first
                    take = max(0, size - need + 1 - (size - (b - a)))
                    prefixes[i] = h[a : a + take].astype(np.int64)
                    bodies[i] = tb.pack(h[a:b], tb.narrow(df[a:b]))
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(f1.astype(np.int64), pa.int64()), pa.array(f2.astype(np.int64), pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bodies, pa.binary())], ["doc_id", "n", "f1", "f2", "prefix", "body"])

    return run


class _Node:
    __slots__ = ("run", "kids", "ends", "low", "high", "below", "label")

    def __init__(self, run: np.ndarray, size: int, label: int):
        self.run, self.kids, self.ends, self.low, self.high, self.below, self.label = run, {}, [], size, size, 0, label


class Trie:
    """Sets as paths of ranked shingles, with the least and largest set size, longest rest and common class below each node."""

    def __init__(self, percent: int, ranks: int):
        self.percent, self.root, self.sizes, self.parent, self.mask = percent, _Node(np.zeros(0, dtype=np.int64), 1 << 60, -1), [], [], np.zeros(ranks, dtype=bool)
        self.root.high = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, tokens: np.ndarray, size: int) -> list[int]:
        """Enter a set; the earlier sets whose links joined its class."""
        d = len(self.sizes)
        self.sizes.append(size)
        self.parent.append(d)
        found = self._walk(d, tokens, size)
        self._insert(d, tokens, size)
        return found

    def _walk(self, d: int, tokens: np.ndarray, size: int) -> list[int]:
        percent, mask, found = self.percent, self.mask, []
        mask[tokens] = True
        stack = [(self.root, 0)]
        while stack:
            node, matched = stack.pop()
            if node.label >= 0 and self.find(node.label) == self.find(d):
                continue
            if node.high * 100 < percent * size:
                continue
            run = node.run
            if len(run):
                matched += int(np.count_nonzero(mask[run]))
                rest = len(tokens) - int(np.searchsorted(tokens, run[-1], side="right"))
            else:
                rest = len(tokens)
            most = matched + min(node.below, rest)
            if 100 * most < percent * (size + node.low - most):
                continue
            for e in node.ends:
                if 100 * matched >= percent * (size + self.sizes[e] - matched):
                    a, b = self.find(e), self.find(d)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        found.append(e)
            for kid in node.kids.values():
                stack.append((kid, matched))
            if node.label < 0 and len(node.kids) < 9:
                labels = {self.find(k.label) if k.label >= 0 else -1 for k in node.kids.values()} | {self.find(e) for e in node.ends}
                if len(labels) == 1:
                    node.label = labels.pop()
        mask[tokens] = False
        return found

    def _insert(self, d: int, tokens: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        while True:
            run = node.run
            k = min(len(run), len(tokens) - at)
            differ = np.flatnonzero(run[:k] != tokens[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(run):
                rest = _Node(run[same:], node.low, node.label)
                rest.kids, rest.ends, rest.high, rest.below = node.kids, node.ends, node.high, node.below
                node.run, node.kids, node.ends, node.below = run[:same], {int(run[same]): rest}, [], node.below + len(run) - same
            at += same
            node.low, node.high, node.below = min(node.low, size), max(node.high, size), max(node.below, len(tokens) - at)
            if node.label >= 0 and self.find(node.label) != self.find(d):
                node.label = -1
            if at == len(tokens):
                node.ends.append(d)
                return
            kid = node.kids.get(int(tokens[at]))
            if kid is None:
                kid = node.kids[int(tokens[at])] = _Node(tokens[at:], size, d)
                kid.ends.append(d)
                return
            node = kid


def _trie_join(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, n, bodies = (table.column(c).to_pylist() for c in ("doc_id", "n", "body"))
        sets = [tb.unpack(b, 2) for b in bodies]
        h, df = np.concatenate([s[0] for s in sets]), np.concatenate([s[1].astype(np.int64) for s in sets])
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        rank = np.empty(len(u), dtype=np.int64)
        rank[np.lexsort((u, df[first]))] = np.arange(len(u))
        ranked = np.split(rank[back], np.cumsum([len(s[0]) for s in sets])[:-1])
        trie, order, links = Trie(percent, len(u)), sorted(range(len(ids)), key=lambda i: (n[i], ids[i])), []
        for i in order:
            links += [(ids[order[e]], ids[i]) for e in trie.add(ranked[i], n[i])]
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(number, doc_id, text) of the rows, null ids as NULL_ID; whether the number is the id, as no id repeats."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(tb.NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    alone = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    return rows.select((F.col("doc_id") if alone else F.xxhash64("doc_id", "text")).alias("number"), "doc_id", "text"), alone


def link_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; documents link when 100 * intersection >= percent * union."""
    rows, alone = _numbered(docs, id_col, text_col)
    out = _link(rows, size, percent)
    if not alone:
        out = materialize(out.join(rows.select("number", F.col("doc_id").alias("id")).distinct(), F.col("doc_id") == F.col("number")), "link_ids")
        least = out.groupBy("component_id").agg(F.min("id").alias("least"))
        out = out.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    none = F.lit(tb.NULL_ID)
    return out.select(F.nullif("doc_id", none).alias("doc_id"), "n_shingles", F.nullif("component_id", none).alias("component_id"))


def _link(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) by the numbers of the rows; rows of one number have one text."""
    docs = rows.select(F.col("number").alias("doc_id"), "text")
    ship(docs.sparkSession)
    k = slices(docs, 1 << 20)
    bits, buckets = k.bit_length() - 1, max(64, k // 4)
    sent = docs.mapInArrow(tb.tidy(_sets(size, bits, buckets)), "slice int, kind int, body binary")
    counted = sent.groupBy("slice").applyInArrow(_count(bits, buckets), "bucket int, kind int, body binary")
    found = materialize(counted.groupBy("bucket").applyInArrow(_assemble(percent), CANDIDATE), "shingle_sets")

    info = found.select("doc_id", "n", "f1", "f2")
    classes = info.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    sets = found.where("body IS NOT NULL").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(sets, "class_sets")
    tokens = sets.select("doc_id", F.explode("prefix").alias("token"))
    hubs = tokens.groupBy("token").agg(F.min("doc_id").alias("hub"), F.count("*").alias("m")).where("m > 1")
    near = connected_components(tokens.join(hubs, "token").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    many = near.groupBy("component").agg(F.count("*").alias("m"))
    chunk = F.least(F.lit(MOST_CHUNK), F.greatest(F.lit(LEAST_CHUNK), F.ceil(F.col("m") / CHUNKS)))
    placed = near.join(many, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("block"), F.ceil(F.col("m") / chunk).cast("int").alias("k"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own")))))
    tasks = sets.select("doc_id", "n", "body").join(placed, "doc_id").select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "n", "body")
    links = tasks.groupBy("block", "i", "j").applyInArrow(_trie_join(percent), "a long, b long")
    linked = connected_components(links)

    whole = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    return info.join(whole, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, that of the smallest id, for each component of links; rows of one doc_id and equal texts count once."""
    rows, alone = _numbered(docs, "doc_id", "text")
    linked = _link(rows, size, percent)
    if alone:
        keep = linked.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id"))
        number = F.coalesce(F.col("doc_id").cast("long"), F.lit(tb.NULL_ID))
    else:
        ids = rows.select("number", F.col("doc_id").alias("id")).distinct()
        first = linked.join(ids, F.col("doc_id") == F.col("number")).groupBy("component_id").agg(F.min(F.struct("id", "number")).alias("first"))
        keep = first.select(F.col("first.number").alias("__id"))
        number = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(tb.NULL_ID)), F.col("text").cast("string"))
    return docs.withColumn("__id", number).join(keep, "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)
