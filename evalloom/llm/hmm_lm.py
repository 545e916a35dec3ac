"""LM scoring: a hidden Markov language model over words.

The states emit word classes: the most frequent training words are a class each, the others fall into classes by their last bytes, and a word has
probability (c + 1) / (sum of its class) within its class; an unknown word has probability 1 / (N + V + 1) in every state, as
in the unigram base. Baum-Welch counts are summed over all partitions for each round; a bounded sample of documents only gives the round-zero
parameters. Counts are those of whole texts: texts of more than SEGMENT tokens are worked on in segments, between which the forward and backward
messages are carried by the segments' transfer matrices. The scaled forward recursion over whole texts gives the exact likelihood of the sequence, its end token included.

Tables: blocks of texts as word numbers; hash slices that sum the training count of every word and answer each block; coded blocks of classes.
Sums over slices and partitions merge in trees of fan-in MERGE. What is broadcast is bounded by parameters: the frequent words (their number grows with the input
from TOP_WORDS to MOST_TOP_WORDS) and the state tables.

Defined results: null text is empty, so only its end token counts; a null doc_id counts as a document that isn't held out; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm import textblocks as tb
from evalloom.runtime import materialize, ship, size_hint, slices

STATES = 8
TOP_WORDS, MOST_TOP_WORDS, BYTES_A_TOP_WORD = 16384, 1 << 18, 1 << 19
ENDINGS = 4096
BLOCK_TOKENS = 1 << 20
SEGMENT = 2048
GROUP_TOKENS = 1 << 18
PRIOR = 200.0
SAMPLE_DOCS, SAMPLE_LENGTH = 400, 20000
SAMPLE_ROUNDS = 30
ROUNDS = 3
MERGE = 64
CHUNK = 1024


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class by a word's last three bytes (all of a shorter one)."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in (1, 2, 3):
        at = ends - k
        out = out * np.uint64(257) + np.where(at >= starts, tb.LOWER[data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (tb.mix(out) % np.uint64(ENDINGS)).astype(np.uint16)


BLOCKS = "block long, docs binary, tokens binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n = 0
    numbers = tb.Numbers()

    def flush() -> pa.RecordBatch:
        ids, test, lens, h, end = map(np.concatenate, zip(*held, strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        train = np.bincount(back[np.repeat(~test, lens)], minlength=len(u)) if len(u) else np.zeros(0, dtype=np.int64)
        docs = tb.pack(ids.astype(np.uint64), test.astype(np.uint8), lens.astype(np.uint32))
        words = tb.pack(u, tb.narrow(train), end[first])
        return pa.RecordBatch.from_arrays([pa.array(numbers.take(), pa.int64()), *(pa.array([x], pa.binary()) for x in (docs, tb.pack(tb.narrow(back)), words))], ["block", "docs", "tokens", "words"])

    for batch in batches:
        ids, (offsets, data) = tb.ids_of(batch.column("doc_id")), tb.utf8(batch.column("text"))
        test = batch.column("test").to_numpy(zero_copy_only=False)
        for lo, hi in tb.parts(offsets):
            part = data[offsets[lo] : offsets[hi]]
            first, starts, ends = tb.words(offsets[lo : hi + 1] - offsets[lo], part)
            held.append((ids[lo:hi], test[lo:hi], np.diff(first), tb.word_hashes(part, starts, ends, True), endings(part, starts, ends)))
            n += len(starts) + hi - lo
            if n >= BLOCK_TOKENS:
                yield flush()
                held.clear()
                n = 0
    if held:
        yield flush()


def _ask(bits: int):
    """The distinct words of each block, by slices of the hash; blocks keep them in order of hash, so answers align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                u, c, end = tb.unpack(words, 3)
                cut = np.searchsorted((u >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(cut))
                blobs = [tb.pack(tb.narrow(c[cut[s] : cut[s + 1]]), end[cut[s] : cut[s + 1]]) + tb.low7(u[cut[s] : cut[s + 1]]).tobytes() for s in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["slice", "block", "body"])

    return run


def _best(h: np.ndarray, c: np.ndarray, end: np.ndarray, top: int | None = None) -> np.ndarray:
    return np.lexsort((h, -c.astype(np.int64)))[: top or TOP_WORDS]


def _answer(bits: int, top: int):
    """Training counts of the words of one slice: an answer for each block, and (block null) the slice's totals and frequent words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s, blocks, got = key[0].as_py(), table.column("block").to_pylist(), []
        for body in table.column("body").to_pylist():
            c, end = tb.unpack(body, 2)
            got.append((tb.from7(body, len(c), len(body) - 7 * len(c)), c.astype(np.int64), end))
        h, c, end = map(np.concatenate, zip(*got, strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=c, minlength=len(u)).astype(np.int64)
        answers = [tb.pack(tb.narrow(x)) for x in np.split(total[back], np.cumsum([len(g[0]) for g in got])[:-1])]
        known, end = total > 0, end[first]
        sums = np.bincount(end[known], weights=total[known] + 1, minlength=ENDINGS).astype(np.uint64)
        word = u[known] | np.uint64(s) << np.uint64(64 - bits)
        best = _best(word, total[known], end[known], top)
        stats = np.array([known.sum(), total.sum()], dtype=np.uint64).tobytes() + sums.tobytes() + tb.pack(word[best], total[known][best].astype(np.uint64), end[known][best])
        return pa.table([pa.array([*blocks, None], pa.int64()), pa.array([s] * (len(blocks) + 1), pa.int32()), pa.array([*answers, stats], pa.binary())], ["block", "slice", "body"])

    return run


def _stats(bodies: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Sums of (types, tokens), of the ending classes, and the most frequent words."""
    head, sums, top = np.zeros(2, dtype=np.uint64), np.zeros(ENDINGS, dtype=np.uint64), []
    for b in bodies:
        head = head + np.frombuffer(b, dtype=np.uint64, count=2)
        sums = sums + np.frombuffer(b, dtype=np.uint64, count=ENDINGS, offset=16)
        top.append(tb.unpack(b[16 + 8 * ENDINGS :], 3))
    h, c, end = map(np.concatenate, zip(*top, strict=True))
    best = _best(h, c, end, most)
    return head, sums, (h[best], c[best], end[best])


def _merge_stats(most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        head, sums, top = _stats(table.column("body").to_pylist(), most)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([head.tobytes() + sums.tobytes() + tb.pack(*top)], pa.binary())], ["slice", "body"])

    return run


class Vocabulary:
    """Classes: 0 the end token, then the frequent words, then the endings, then unknown words."""

    def __init__(self, bodies: list[bytes], train_docs: int, most: int | None = None):
        if bodies:
            head, sums, (h, c, end) = _stats(bodies, most)
        else:
            head, sums, (h, c, end) = np.zeros(2, dtype=np.uint64), np.zeros(ENDINGS, dtype=np.uint64), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16))
        self.tokens, self.types, self.ends = int(head[1]) + train_docs, int(head[0]) + (train_docs > 0), train_docs
        self.denominator = float(self.tokens + self.types + 1)
        sums = sums.astype(np.float64) - np.bincount(end, weights=c.astype(np.float64) + 1, minlength=ENDINGS)
        order = np.argsort(h)
        self.words, self.numbers = h[order], (order + 1).astype(np.int64)
        self.sums = np.maximum(sums, 1.0)
        self.unknown = 1 + len(h) + ENDINGS
        weight = np.concatenate([[train_docs + (train_docs > 0)], c.astype(np.float64) + 1, sums, [0.0]])
        self.base = weight / max(1.0, weight.sum())
        self.seen = weight > 0

    def code(self, u: np.ndarray, c: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, log10 of the probability within it) of words."""
        cls = len(self.words) + 1 + end.astype(np.int64)
        within = np.log10((c + 1) / self.sums[end])
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
            top = self.words[at] == u
            cls[top], within[top] = self.numbers[at[top]], 0.0
        cls[c == 0], within[c == 0] = self.unknown, 0.0
        return cls, within


CODED = "docs binary, classes binary"


def _code(vocabulary: Vocabulary):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("slice")
        answers = [tb.unpack(b, 1)[0].astype(np.int64) for b in right.column("body").to_pylist()]
        c = np.concatenate(answers) if answers else np.zeros(0, dtype=np.int64)
        for docs, tokens, words in zip(*(left.column(x).to_pylist() for x in ("docs", "tokens", "words")), strict=True):
            ids, test, lens = tb.unpack(docs, 3)
            (back,), (u, _, end) = tb.unpack(tokens, 1), tb.unpack(words, 3)
            cls, within = vocabulary.code(u, c, end)
            lens = lens.astype(np.int64)
            row = np.repeat(np.arange(len(ids)), lens)
            per = lambda w: np.bincount(row, weights=w[back], minlength=len(ids))
            base = per(np.log10((c + 1) / vocabulary.denominator)) + np.log10((vocabulary.ends + 1) / vocabulary.denominator)
            known = per((c > 0).astype(np.float64)).astype(np.uint32) + np.uint32(vocabulary.ends > 0)
            flat = np.zeros(len(back) + len(ids), dtype=np.int64)
            flat[np.arange(len(back)) + row] = cls[back]
            if not vocabulary.ends:
                flat[np.cumsum(lens + 1) - 1] = vocabulary.unknown
            out.append((tb.pack(ids, test, (lens + 1).astype(np.uint32), known, base.view(np.uint64), per(within).view(np.uint64)), tb.pack(tb.narrow(flat))))
        return pa.table([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["docs", "classes"])

    return run


def _active(lens: np.ndarray) -> np.ndarray:
    """For lengths in falling order: how many are longer than t, for each t."""
    return len(lens) - np.searchsorted(lens[::-1], np.arange(int(lens[0])), side="right")


class Model:
    """start (K), move (K, K), emit (classes, K): rows by class, so that a class's emissions lie together."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def log10(self, cls: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion, all sequences a step at a time."""
        order = np.argsort(-lens, kind="stable")
        at, active, out = first[order], _active(lens[order]), np.zeros(len(lens))
        alpha = self.start * self.emit[cls[at]]
        for t, n in enumerate(active):
            if t:
                alpha = (alpha[:n] @ self.move) * self.emit[cls[at[:n] + t]]
            s = alpha.sum(axis=1)
            out[:n] += np.log10(s)
            alpha /= s[:, None]
        back = np.empty(len(lens))
        back[order] = out
        return back

    def counts(self, cls: np.ndarray, first: np.ndarray, lens: np.ndarray, head: np.ndarray | None = None, tail: np.ndarray | None = None, opens: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Expected counts (start, moves, emissions) and log likelihood over segments. head: the distribution of each one's first state, given what came before;
        tail: the message that comes back from what follows; opens: those that begin a document."""
        k, n = len(self.start), len(lens)
        order = np.argsort(-lens, kind="stable")
        at, active = first[order], _active(lens[order])
        alpha = np.broadcast_to(self.start, (n, k)) if head is None else head[order]
        alphas, scales, seen = [], [], []
        for t, m in enumerate(active):
            c = cls[at[:m] + t]
            alpha = (alpha if t == 0 else alpha[:m] @ self.move) * self.emit[c]
            s = alpha.sum(axis=1)
            alpha /= s[:, None]
            alphas.append(alpha)
            scales.append(s)
            seen.append(c)
        moves, likelihood, nxt = np.zeros((k, k)), 0.0, None
        for t in range(len(active) - 1, -1, -1):
            beta, done = np.ones((active[t], k)), 0
            if nxt is not None:
                done = len(nxt)
                beta[:done] = nxt @ self.move.T
                moves += alphas[t][:done].T @ nxt
            if tail is not None and done < active[t]:
                last = tail[order[done : active[t]]]
                beta[done:] = last / (alphas[t][done:] * last).sum(axis=1, keepdims=True)
            nxt = self.emit[seen[t]] * beta / scales[t][:, None]
            alphas[t] = alphas[t] * beta
            likelihood += float(np.log10(scales[t]).sum())
        start = (alphas[0] if opens is None else alphas[0][opens[order]]).sum(axis=0)
        flat, gamma = np.concatenate(seen), np.concatenate(alphas)
        emit = np.stack([np.bincount(flat, weights=gamma[:, i], minlength=len(self.emit)) for i in range(k)], axis=1)
        return start, moves * self.move, emit, likelihood

    def transfers(self, cls: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For each segment the product of its emissions and inner moves, up to a factor: from its first state to its last."""
        order = np.argsort(-lens, kind="stable")
        at, active = first[order], np.append(_active(lens[order]), 0)
        out = np.empty((len(lens), len(self.start), len(self.start)))
        p = np.broadcast_to(np.eye(len(self.start)), out.shape)
        for t in range(len(active) - 1):
            m = active[t]
            p = (p if t == 0 else p[:m] @ self.move) * self.emit[cls[at[:m] + t]][:, None, :]
            p /= p.sum(axis=(1, 2), keepdims=True)
            out[order[active[t + 1] : m]] = p[active[t + 1] :]
        return out

    def expected(self, cls: np.ndarray, first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Expected counts and log likelihood of whole documents, in groups of segments of about GROUP_TOKENS."""
        k, n = len(self.start), -(-lens // SEGMENT)
        doc = np.repeat(np.arange(len(lens)), n)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = first[doc] + number * SEGMENT
        size = np.minimum(first[doc] + lens[doc] - begin, SEGMENT)
        head, tail, moves = np.tile(self.start, (len(doc), 1)), np.ones((len(doc), k)), np.zeros((k, k))
        long = np.flatnonzero(n[doc] > 1)
        if len(long):
            across = np.empty((len(doc), k, k))
            across[long] = self.transfers(cls, begin[long], size[long])
            ends = np.empty((len(doc), k))
            by = [long[number[long] == j] for j in range(int(n.max()))]
            scaled = lambda x: x / x.sum(axis=1, keepdims=True)
            for now in by[1:]:
                ends[now] = scaled((head[now - 1][:, None, :] @ across[now - 1])[:, 0])
                head[now] = scaled(ends[now] @ self.move)
            for now in by[:0:-1]:
                back = (across[now] @ tail[now][:, :, None])[:, :, 0]
                tail[now - 1] = scaled(back @ self.move.T)
                both = ends[now][:, :, None] * self.move * back[:, None, :]
                moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        start, emit, likelihood = np.zeros(k), np.zeros((len(self.emit), k)), 0.0
        order = np.argsort(-size, kind="stable")
        group = np.cumsum(size[order]) // GROUP_TOKENS
        for some in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ():
            a, b, c, d = self.counts(cls, begin[some], size[some], head[some], tail[some], number[some] == 0)
            start, moves, emit, likelihood = start + a, moves + b, emit + c, likelihood + d
        return start, moves, emit, likelihood

    @staticmethod
    def fit(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, vocabulary: Vocabulary) -> Model:
        """The maximum a posteriori parameters; unknown words keep the base's probability in every state."""
        rare = 1.0 / vocabulary.denominator
        full = emit + PRIOR * vocabulary.base[:, None]
        full[vocabulary.unknown] = 0.0
        full = full / np.maximum(full.sum(axis=0), 1e-300) * (1.0 - rare)
        full[vocabulary.unknown] = rare
        return Model((start + 1.0) / (start + 1.0).sum(), (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True), full)


def _expect(model: Model):
    """Baum-Welch counts of a partition, in rows of CHUNK classes; the last row has the starts, moves and likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.start)
        start, moves, emit, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k)), 0.0
        for batch in batches:
            for docs, classes in zip(batch.column("docs").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                _, test, lens, *_ = tb.unpack(docs, 6)
                cls = tb.unpack(classes, 1)[0].astype(np.int64)
                lens, train = lens.astype(np.int64), test == 0
                a, b, c, d = model.expected(cls, (np.cumsum(lens) - lens)[train], lens[train])
                start, moves, emit, likelihood = start + a, moves + b, emit + c, likelihood + d
        rows = [emit[lo : lo + CHUNK] for lo in range(0, len(emit), CHUNK)] + [np.concatenate([start, moves.ravel(), [likelihood]])]
        leaf = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([leaf] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "leaf", "body"])

    return run


SUMS = "part int, leaf int, body binary"


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("leaf")  # so that the sum doesn't depend on the order of arrival
    total = sum(np.frombuffer(b, dtype=np.float64) for b in table.column("body").to_pylist())
    return pa.table([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([total.tobytes()], pa.binary())], ["part", "leaf", "body"])


def _round(coded: DataFrame, model: Model, vocabulary: Vocabulary) -> Model:
    k, n = len(model.start), coded.rdd.getNumPartitions()
    rows = coded.mapInArrow(tb.tidy(_expect(model)), SUMS)
    while n > 1:
        n = -(-n // MERGE)
        rows = rows.withColumn("leaf", F.floor(F.col("leaf") / MERGE).cast("int")).groupBy("part", "leaf").applyInArrow(_sum, SUMS)
    rows = sorted(rows.select("part", "body").collect())
    if not rows:
        return model
    tail = np.frombuffer(rows[-1]["body"])
    emit = np.concatenate([np.frombuffer(r["body"]) for r in rows[:-1]]).reshape(-1, k)
    return Model.fit(tail[:k], tail[k : k + k * k].reshape(k, k), emit, vocabulary)


def _sampled(limit: int):
    """The classes of the training documents of at most SAMPLE_LENGTH tokens whose mixed id lies below a limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, out = [], []
            for docs, classes in zip(batch.column("docs").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                ids, test, lens, *_ = tb.unpack(docs, 6)
                cls, ends = tb.unpack(classes, 1)[0], np.cumsum(lens.astype(np.int64))
                drawn = tb.mix(ids)
                for i in np.flatnonzero((test == 0) & (lens <= SAMPLE_LENGTH) & (drawn < np.uint64(limit))):
                    ids_out.append(int(drawn[i] >> np.uint64(1)))
                    out.append(cls[ends[i] - lens[i] : ends[i]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), pa.array(out, pa.binary())], ["draw", "classes"])

    return run


def _first_model(coded: DataFrame, vocabulary: Vocabulary) -> Model:
    """Round-zero parameters from a bounded sample of whole training documents: SAMPLE_DOCS expected, twice as many at most, in the order of a hash of their ids."""
    limit = min((1 << 64) - 1, int((1 << 64) * SAMPLE_DOCS / max(1, vocabulary.ends)))
    rows = coded.mapInArrow(_sampled(limit), "draw long, classes binary").orderBy("draw", "classes").limit(2 * SAMPLE_DOCS).collect()
    texts = [np.frombuffer(r["classes"], dtype="<u4").astype(np.int64) for r in rows]
    k = STATES
    rng = np.random.default_rng(7)
    emit = np.zeros((len(vocabulary.base), k))
    for t in texts:  # every document leans to one state
        lean = np.full(k, 0.3)
        lean[rng.integers(k)] = 1.0
        emit += np.bincount(t, minlength=len(emit))[:, None] * lean
    move = np.full((k, k), 0.1) + np.eye(k) * 9
    model = Model.fit(np.ones(k), move * 1000, emit, vocabulary)
    if not texts:
        return model
    cls, lens = np.concatenate(texts), np.array([len(t) for t in texts])
    for _ in range(SAMPLE_ROUNDS):
        start, moves, emit, _ = model.expected(cls, np.cumsum(lens) - lens, lens)
        model = Model.fit(start, moves, emit, vocabulary)
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model, vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, classes in zip(batch.column("docs").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                ids, test, lens, known, base, within = tb.unpack(docs, 6)
                cls, lens = tb.unpack(classes, 1)[0].astype(np.int64), lens.astype(np.int64)
                score = model.log10(cls, np.cumsum(lens) - lens, lens) + within.view(np.float64)
                ids = ids.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == tb.NULL_ID), pa.array(test == 1), pa.array(lens, pa.int64()), pa.array(known, pa.int64()), pa.array([vocabulary.tokens] * len(ids), pa.int64()), pa.array(base.view(np.float64)), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _train_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        for docs in batch.column("docs").to_pylist():
            n += int((tb.unpack(docs, 3)[1] == 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of SCORES for every row; learns from the rows that aren't held out."""
    ship(docs.sparkSession)
    bits = slices(docs, 2 << 20).bit_length() - 1
    top = max(TOP_WORDS, min(MOST_TOP_WORDS, size_hint(docs) // BYTES_A_TOP_WORD))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(texts.withColumn("test", held_out()).mapInArrow(tb.tidy(_blocks), BLOCKS), "lm_blocks")
    train_docs = blocks.select("docs").mapInArrow(_train_docs, "n long").agg(F.sum("n")).first()[0] or 0
    answers = materialize(blocks.select("block", "words").mapInArrow(_ask(bits), "slice int, block long, body binary").groupBy("slice").applyInArrow(_answer(bits, top), "block long, slice int, body binary"), "lm_counts")
    stats, n = answers.where("block IS NULL").select("slice", "body"), 1 << bits
    while n > 1:
        n = -(-n // MERGE)
        stats = stats.withColumn("slice", F.floor(F.col("slice") / MERGE).cast("int")).groupBy("slice").applyInArrow(_merge_stats(top), "slice int, body binary")
    vocabulary = Vocabulary([bytes(r["body"]) for r in stats.collect()], train_docs, top)
    coded = materialize(blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInArrow(_code(vocabulary), CODED), "lm_classes")
    model = _first_model(coded, vocabulary)
    for _ in range(ROUNDS):
        model = _round(coded, model, vocabulary)
    return coded.mapInArrow(tb.tidy(_score(model, vocabulary)), SCORES)
