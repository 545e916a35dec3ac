"""Embedding near-dedup: PCA-ordered tiled comparison.

Equal vectors are one class. Unit vectors are projected to the leading principal axes, in order of variance. Blocks hold vectors that are near each other on the first
ORDER axes: quantiles of a code that interleaves their coordinates. Unit vectors whose cosine reaches the threshold are at most sqrt(2 - 2 * threshold) apart, so only blocks whose
boxes over the leading axes are within that reach are compared. A tile first multiplies leading axes; the product of the norms of what remains bounds
the rest, and pairs that can't reach the threshold stop there. What remains is settled in double precision over all components. A tile returns counts of links by
vector and a spanning forest, never pairs.

The axes come from the second moments up to MOMENTS components, and above from subspace iteration; any orthonormal axes keep the results exact.

Defined results: vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do vectors of different lengths with each other;
null ids count as the smallest id and return as null; rows that repeat id and vector link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.components import connected_components
from evalloom.llm.textblocks import NULL_ID, pack, unpack
from evalloom.runtime import materialize, ship

BLOCK = 65536  # vectors of a block at most, and BLOCK_BYTES of them in double precision
BLOCK_BYTES = 16 << 20
LEAST_BLOCK = 1024
SIDES = 4  # blocks of a table that is smaller than so many whole ones
MOST_BLOCKS = 1 << 16  # by quantiles; more vectors are dealt to several blocks of a quantile
STRIP, WIDE = 512, 4096
STEPS = (16, 32)
ORDER, BITS = 4, 12
FAN = 64
MOMENTS = 512
SPARE, ROUNDS = 16, 3  # of subspace iteration


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors padded by zeros, lengths) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lens), width))
    out[np.arange(width) < lens[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True)), lens


def _moments(width: int, basis: np.ndarray | None):
    """The sum of x x^T over a partition's unit vectors, or of x (x^T basis)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width if basis is None else basis.shape[1]))
        for batch in batches:
            x, _ = matrix(batch.column("x"), width)
            total += x.T @ (x if basis is None else x @ basis)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "body"])

    return run


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("part")  # so that the sum doesn't depend on the order of arrival
    total = sum(np.frombuffer(b) for b in table.column("body").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "body"])


def _moment_sum(vectors: DataFrame, width: int, basis: np.ndarray | None = None) -> np.ndarray | None:
    """Moments of all vectors, merged FAN at a time."""
    rows, n = vectors.select("x").mapInArrow(_moments(width, basis), "part int, body binary"), vectors.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        rows = rows.withColumn("group", F.floor(F.col("part") / FAN).cast("int")).groupBy("group").applyInArrow(_sum, "part int, body binary")
    got = rows.collect()
    return np.frombuffer(got[0]["body"]).reshape(width, -1) if got else None


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """(width, up to the last of STEPS): leading principal axes by falling second moment."""
    most = min(width, STEPS[-1])
    if width <= MOMENTS:
        total = _moment_sum(vectors, width)
        if total is None:
            return np.eye(width)[:, :most]
        values, out = np.linalg.eigh(total)
        return np.ascontiguousarray(out[:, np.argsort(-values)[:most]])
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(width, most + SPARE)))[0]
    for _ in range(ROUNDS):
        total = _moment_sum(vectors, width, basis)
        if total is None:
            return basis[:, :most]
        values, turn = np.linalg.eigh(basis.T @ total)
        first, basis = basis @ turn[:, np.argsort(-values)], np.linalg.qr(total)[0]
    return np.ascontiguousarray(first[:, :most])


def code(x: np.ndarray) -> np.ndarray:
    """Coordinates in [-1, 1] on the first axes, interleaved bit by bit, the first axis leading."""
    cell = np.clip(((x[:, :ORDER] + 1.0) * (1 << BITS - 1)).astype(np.int64), 0, (1 << BITS) - 1)
    out = np.zeros(len(x), dtype=np.int64)
    for bit in range(BITS - 1, -1, -1):
        for axis in range(cell.shape[1]):
            out = out << 1 | cell[:, axis] >> bit & 1
    return out


def _codes(rotation: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = matrix(batch.column("x"), len(rotation))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("m"), batch.column("x"), pa.array(code(x @ rotation))], ["rep", "m", "x", "code"])

    return run


def _bins(edges: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(np.array(edges, dtype=np.int64), batch.column("code").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at.astype(np.int32))], ["rep", "m", "x", "bin"])

    return run


def _build(width: int, rotation: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = table.column("x").combine_chunks()
        unit, lens = matrix(column, width)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        raw = np.zeros((len(lens), width), dtype=flat.dtype)
        raw[np.arange(width) < lens[:, None]] = flat
        reps, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
        body, x = pack(reps.astype(np.uint64), m.astype(np.uint64), lens.astype(np.uint32)) + raw.tobytes(), unit @ rotation
        floats = pa.list_(pa.float64())
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([raw.dtype.itemsize], pa.int32()), pa.array([x.min(axis=0)], floats), pa.array([x.max(axis=0)], floats), pa.array([body], pa.binary())], ["bin", "chunk", "itemsize", "low", "high", "body"])

    return run


class Block:
    """Vectors in order of the first axis."""

    def __init__(self, body: bytes, itemsize: int, rotation: np.ndarray):
        reps, m, lens = (c.astype(np.int64) for c in unpack(body, 3))
        n, width = len(reps), len(rotation)
        plain = np.frombuffer(body, dtype=f"<f{itemsize}", offset=len(body) - n * width * itemsize).reshape(n, width).astype(np.float64)
        plain /= np.abs(plain).max(axis=1, keepdims=True)
        plain /= np.sqrt((plain * plain).sum(axis=1, keepdims=True))
        x = plain @ rotation
        order = np.argsort(x[:, 0], kind="stable")
        self.reps, self.m, self.lens, self.plain, self.x = reps[order], m[order], lens[order], plain[order], x[order]
        self.short = self.x[:, : STEPS[0]].astype(np.float32)
        lead = np.cumsum(self.x * self.x, axis=1)
        self.rest = {d: np.sqrt(np.maximum(1.0 - lead[:, min(d, x.shape[1]) - 1], 0.0)) for d in STEPS}


def pairs(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (row of a, row of b), strip by strip; of a block with itself, each pair once."""
    width, reach = a.plain.shape[1], reach_of(threshold)
    step = max(256, (1 << 23) // width)
    for lo in range(0, len(a.x), STRIP):
        hi = min(lo + STRIP, len(a.x))
        left, right = np.searchsorted(b.x[:, 0], [a.x[lo, 0] - reach, a.x[hi - 1, 0] + reach])
        for at in range(max(left, lo) if same else left, right, WIDE):
            end = min(at + WIDE, right)
            bound = a.short[lo:hi] @ b.short[at:end].T
            bound += a.rest[STEPS[0]][lo:hi, None].astype(np.float32) * b.rest[STEPS[0]][at:end].astype(np.float32)
            i, j = np.nonzero(bound >= np.float32(threshold - 1e-4))
            i, j = i + lo, j + at
            keep = a.lens[i] == b.lens[j]
            if same:
                keep &= i < j
            i, j = i[keep], j[keep]
            for k in range(0, len(i), step):
                p, q = i[k : k + step], j[k : k + step]
                total, done = np.zeros(len(p)), 0
                for d in STEPS:
                    total, done = total + np.einsum("ij,ij->i", a.x[p, done:d], b.x[q, done:d]), d
                    keep = total + a.rest[d][p] * b.rest[d][q] >= threshold - 1e-6
                    p, q, total = p[keep], q[keep], total[keep]
                keep = (a.plain[p] * b.plain[q]).sum(axis=1) >= threshold
                yield p[keep], q[keep]


def reach_of(threshold: float) -> float:
    """The distance that unit vectors of this cosine are apart at most."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row that links reach, for each of n rows."""
    label = np.arange(n)
    while len(p):
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        open_ = label[p] != label[q]
        p, q = p[open_], q[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _tile(threshold: float, rotation: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sides = {s: Block(b, k, rotation) for s, b, k in zip(table.column("side").to_pylist(), table.column("body").to_pylist(), table.column("itemsize").to_pylist(), strict=True)}
        a = sides[0]
        b = sides.get(1, a)
        same = b is a
        n = len(a.reps) + (0 if same else len(b.reps))
        count, ps, qs = np.zeros(n), [], []
        for p, q in pairs(a, b, threshold, same):
            if len(p):
                shift = 0 if same else len(a.reps)
                count += np.bincount(p, weights=b.m[q], minlength=n) + np.bincount(q + shift, weights=a.m[p], minlength=n)
                label = forest(n, p, q + shift)
                some = np.flatnonzero(label != np.arange(n))
                ps.append(some)
                qs.append(label[some])
        reps = a.reps if same else np.concatenate([a.reps, b.reps])
        some = np.flatnonzero(count)
        p, q = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ps, qs))
        label = forest(n, p, q)
        link = np.flatnonzero(label != np.arange(n))
        kind = np.r_[np.zeros(len(some), dtype=np.int32), np.ones(len(link), dtype=np.int32)]
        return pa.table([pa.array(kind), pa.array(np.r_[reps[some], reps[link]]), pa.array(np.r_[count[some].astype(np.int64), reps[label[link]]])], ["kind", "a", "b"])

    return run


def _neighbours(blocks: DataFrame, reach: float) -> DataFrame:
    """(i, ci, j, cj): blocks, in order, whose boxes are within reach; they meet in the first cell of the first axis that both may need."""
    cell = lambda c: F.floor(c / F.lit(reach)).cast("int")
    near = lambda a, b, c: blocks.select(F.col("bin").alias(a), F.col("chunk").alias(f"c{a}"), F.col("low").alias(f"low_{a}"), F.col("high").alias(f"high_{a}"), F.explode(F.sequence(cell(F.get("low", F.lit(0)) - c), cell(F.get("high", F.lit(0)) + c))).alias("cell"))
    both = near("i", "j", 0.0).join(near("j", "i", reach), "cell").where("i < j OR i = j AND ci <= cj")
    first = F.greatest(cell(F.get("low_i", F.lit(0))), cell(F.get("low_j", F.lit(0)) - F.lit(reach)))
    gap = lambda x, y: F.zip_with(x, y, lambda u, v: F.greatest(u - v, F.lit(0.0)))
    gaps = F.zip_with(gap(F.col("low_j"), F.col("high_i")), gap(F.col("low_i"), F.col("high_j")), lambda u, v: u * u + v * v)
    return both.where((F.col("cell") == first) & (F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) <= reach * reach)).select("i", "ci", "j", "cj")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("x")
    good = x.isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_col).alias("x"))
    # zeros of one sign, so that equal vectors have equal hashes
    kind = dict(rows.dtypes)["x"]
    rows = rows.withColumn("x", F.when(good, F.transform(x, lambda v: F.when(v == 0, F.lit(0)).otherwise(v)).cast(kind)))
    prints = (F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    classes = materialize(rows.where("x IS NOT NULL").groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "vector_classes")
    width, n = classes.agg(F.max(F.size("x")), F.count("*")).first()
    if width is None:
        none = rows.select(F.nullif("id", F.lit(NULL_ID)).alias("vec_id"))
        return none.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rotation = axes(classes, width)
    size = min(BLOCK, max(1, BLOCK_BYTES // (8 * width)), max(LEAST_BLOCK, n // SIDES))
    bins = min(MOST_BLOCKS, -(-n // size))
    placed = materialize(classes.select("rep", "m", "x").mapInArrow(_codes(rotation), f"rep long, m long, x {kind}, code long"), "placed")
    edges = placed.agg(F.percentile_approx("code", [i / bins for i in range(1, bins)], max(10000, 16 * bins))).first()[0] if bins > 1 else []
    placed = placed.mapInArrow(_bins(sorted(set(edges))), f"rep long, m long, x {kind}, bin int")
    # at most MOST_BLOCKS bins to broadcast
    sizes = placed.groupBy("bin").agg(F.ceil(F.count("*") / (1.5 * size)).cast("int").alias("k"))
    chunks = placed.join(F.broadcast(sizes), "bin").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    blocks = materialize(chunks.groupBy("bin", "chunk").applyInArrow(_build(width, rotation), "bin int, chunk int, itemsize int, low array<double>, high array<double>, body binary"), "vector_blocks")
    reached = _neighbours(blocks, reach_of(threshold))
    sides = reached.select("*", F.explode(F.when((F.col("i") == F.col("j")) & (F.col("ci") == F.col("cj")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.select("*", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")).alias("bin"), F.when(F.col("side") == 0, F.col("ci")).otherwise(F.col("cj")).alias("chunk"))
    tiles = sides.join(blocks, ["bin", "chunk"]).select("i", "ci", "j", "cj", "side", "itemsize", "body").groupBy("i", "ci", "j", "cj").applyInArrow(_tile(threshold, rotation), "kind int, a long, b long")
    found = materialize(tiles, "vector_links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    components = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("id", "rep")
    whole = classes.select("rep", "m", *prints).join(counts, "rep", "left").join(components, "rep", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = rows.where("x IS NOT NULL").select("id", *prints).join(whole, ["h1", "h2"]).select("id", "n_links", "component")
    out = linked.unionByName(rows.where("x IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    none = F.lit(NULL_ID)
    return out.select(F.nullif("id", none).alias("vec_id"), "n_links", F.nullif("component", none).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
