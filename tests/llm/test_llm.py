"""The training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from evalloom.llm import chat_format, components, hmm_lm, jaccard_join, language_id, media_chunks, packing, sentencepiece_sampling, substring_dedup, textblocks, tokens, vector_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=1):
    """Copies, near copies, shared passages, short and long texts, nulls and odd white space."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 30, 90]))]
        if i % 7 == 3:
            words[len(words) // 2 : len(words) // 2] = passage
        if i % 11 == 5 and texts:
            words = WORD.findall(texts[-1] or "")
        if i % 13 == 6 and texts:
            words = WORD.findall(texts[-1] or "")
            if words:
                words[rng.randrange(len(words))] = "changed"
        texts.append(rng.choice([" ", "\n", "\t  "]).join(words))
    texts += [None, "", "  \n", "one", "One TWO", " ".join(passage * 40), "x " * 50, "\x0b\x0c", "a\x1cb c d"]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4 * (i % 2)}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def data():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def extra(df):
    """Columns whose names clash with those that operators use inside."""
    return df.selectExpr("*", "1 AS slice", "'x' AS body", "2 AS block", "doc_id AS uid", "3 AS n", "4 AS kind", "text AS word", "5 AS bucket", "6 AS starts")


# --- primitives


def test_words_and_hashes():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x1c日") for _ in range(rng.randrange(30))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    first, starts, ends = textblocks.words(offsets, data)
    got = [[bytes(data[starts[k] : ends[k]]).decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    want = [WORD.findall(t) for t in texts]
    assert got == want
    h = textblocks.word_hashes(data, starts, ends, False)
    seen = {}
    for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for size in (1, 3, 7, 20):
        win, row, start = textblocks.windows(h, first, size)
        by = {}
        for x, r, s in zip(win.tolist(), row.tolist(), start.tolist(), strict=True):
            assert by.setdefault(tuple(want[r][s : s + size]), x) == x
        assert len(set(by.values())) == len(by) and len(win) == sum(max(0, len(w) - size + 1) for w in want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language model


def test_lm_base_and_normalisation(spark, docs, data):
    got = {r["doc_id"]: r for r in hmm_lm.score(extra(docs)).collect()}
    toks = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t, *_ in data}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    assert hmm_lm.score(empty(spark)).count() == 0


def test_lm_forward_and_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    k, m = 3, 5
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm_lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0))
    seqs = [rng.integers(m, size=n) for n in (1, 4, 6, 2)]
    lens = np.array([len(s) for s in seqs])
    cls, first = np.concatenate(seqs), np.cumsum(lens) - lens

    def paths(s):
        import itertools

        for z in itertools.product(range(k), repeat=len(s)):
            p = model.start[z[0]] * model.emit[s[0], z[0]]
            for t in range(1, len(s)):
                p *= model.move[z[t - 1], z[t]] * model.emit[s[t], z[t]]
            yield z, p

    want = [math.log10(sum(p for _, p in paths(s))) for s in seqs]
    assert model.log10(cls, first, lens) == pytest.approx(want)
    start, moves, emit, likelihood = model.expected(cls, first, lens)
    a, b, e = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    for s in seqs:
        total = sum(p for _, p in paths(s))
        for z, p in paths(s):
            a[z[0]] += p / total
            for t, x in enumerate(s):
                e[x, z[t]] += p / total
                if t:
                    b[z[t - 1], z[t]] += p / total
    assert np.allclose(start, a) and np.allclose(moves, b) and np.allclose(emit, e) and likelihood == pytest.approx(sum(want))


@pytest.mark.parametrize("segment", [2048, 64, 1])
def test_lm_counts_are_those_of_whole_texts(segment, monkeypatch):
    """Against a plain forward-backward pass over texts of up to 1,000 tokens, in segments of any size."""
    monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
    monkeypatch.setattr(hmm_lm, "GROUP_TOKENS", 300)
    rng = np.random.default_rng(5)
    k, m = 4, 9
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm_lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)) ** 3, 1), norm(rng.random((m, k)), 0))
    seqs = [rng.integers(m, size=n) for n in (1000, 3, 64, 65, 1, 500)]
    a, b, e, want = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), 0.0
    for s in seqs:
        alpha, scale, beta = np.zeros((len(s), k)), np.zeros(len(s)), np.ones((len(s), k))
        for t, x in enumerate(s):
            alpha[t] = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[x]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        for t in range(len(s) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[s[t + 1]] * beta[t + 1]) / scale[t + 1]
            b += np.outer(alpha[t], model.emit[s[t + 1]] * beta[t + 1]) * model.move / scale[t + 1]
        a += alpha[0] * beta[0]
        np.add.at(e, s, alpha * beta)
        want += np.log10(scale).sum()
    lens = np.array([len(s) for s in seqs])
    start, moves, emit, likelihood = model.expected(np.concatenate(seqs), np.cumsum(lens) - lens, lens)
    assert np.allclose(start, a) and np.allclose(moves, b) and np.allclose(emit, e) and likelihood == pytest.approx(want)


def test_lm_sums_merge_in_trees(spark, docs, monkeypatch):
    """Fan-in 2 gives the scores of fan-in 64."""
    want = {r["doc_id"]: r["score"] for r in hmm_lm.score(docs).collect()}
    monkeypatch.setattr(hmm_lm, "MERGE", 2)
    assert {r["doc_id"]: r["score"] for r in hmm_lm.score(docs).collect()} == {i: pytest.approx(x) for i, x in want.items()}


def test_lm_distribution_sums_to_one(monkeypatch):
    monkeypatch.setattr(hmm_lm, "TOP_WORDS", 3)
    h, c, end = np.array([5, 9, 1, 7], dtype=np.uint64), np.array([4, 1, 2, 8], dtype=np.uint64), np.array([3, 3, 8, 3], dtype=np.uint16)
    sums = np.bincount(end, weights=c + 1.0, minlength=hmm_lm.ENDINGS).astype(np.uint64)
    best = hmm_lm._best(h, c, end)
    body = np.array([4, 15], dtype=np.uint64).tobytes() + sums.tobytes() + textblocks.pack(h[best], c[best], end[best])
    v = hmm_lm.Vocabulary([body], 6)
    assert (v.tokens, v.types) == (21, 5)
    model = hmm_lm.Model.fit(np.ones(2), np.ones((2, 2)), np.ones((len(v.base), 2)) * v.seen[:, None], v)
    assert np.allclose(model.emit.sum(axis=0), 1.0)
    cls, within = v.code(np.array([1, 5, 7, 9], dtype=np.uint64), np.array([2, 4, 8, 1]), np.array([8, 3, 3, 3]))
    # the words of a class share all of its probability
    share = Counter()
    for a, b in zip(cls.tolist(), within.tolist(), strict=True):
        share[a] += 10**b
    assert all(x == pytest.approx(1.0) for x in share.values())


def test_lm_beats_base_on_held_out(spark, sf):
    r = hmm_lm.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# --- 2 SentencePiece


def all_segmentations(v, text):
    """{ids: log probability} of every segmentation of a text, by recursion over its pieces."""
    marked = "\u2581" + text.replace(" ", "\u2581")
    weights = {v.pieces[i]: i for i in range(sentencepiece_sampling.FIRST_RANKED, len(v.pieces))}

    def rest(at):
        if at == len(marked):
            return [((), 0.0)]
        here = [((weights[marked[at:end]],), float(v.log_p[weights[marked[at:end]]]), end) for end in range(at + 1, len(marked) + 1) if marked[at:end] in weights]
        if not any(end == at + 1 for *_, end in here):
            raw = marked[at].encode()
            here.append((tuple(v.bytes[b] for b in raw), v.byte_log_p * len(raw), at + 1))
        return [(ids + more, p + q) for ids, p, end in here for more, q in rest(end)]

    out = rest(0)
    total = sum(math.exp(p) for _, p in out)
    assert len(dict(out)) == len(out)
    return {ids: p - math.log(total) for ids, p in out}


def drawn(v, texts, k, seed=0):
    """[(perturbed, log probability, ids)] and the threshold of each text, with its place as its key."""
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *(len(r) for r in raw)])
    part = sentencepiece_sampling.Part(v, offsets, np.frombuffer(b"".join(raw), dtype=np.uint8))
    seeds = textblocks.mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(seed << 32))
    done, threshold = sentencepiece_sampling.sample(part, seeds, k)
    return [([(g, p, tuple(sentencepiece_sampling.piece_ids(v, part.lattices, e)[0].tolist())) for g, p, e in found], t) for found, t in zip(done, threshold, strict=True)]


@pytest.mark.parametrize("text", ["the dog s", "a 日é on", "  no"])
def test_gumbel_top_k_is_a_sample_without_replacement(text):
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.default_model())
    every = all_segmentations(v, text)
    assert len(every) > 5
    n, k = 4000, 3
    first, second, estimate = Counter(), Counter(), 0.0
    for found, threshold in drawn(v, [text] * n, k):
        paths = [ids for _, _, ids in found]
        assert len(set(paths)) == k and all(abs(every[x] - p) < 1e-9 for x, (_, p, _) in zip(paths, found, strict=True))
        assert [g for g, _, _ in found] == sorted((g for g, _, _ in found), reverse=True) and found[-1][0] >= threshold
        first[paths[0]] += 1
        second[paths[1]] += 1
        estimate += sum(math.exp(p) / sentencepiece_sampling.inclusion(p, threshold) for _, p, _ in found)
    assert estimate / n == pytest.approx(1.0, abs=0.03)  # Horvitz-Thompson
    for path, p in every.items():
        q = math.exp(p)
        assert abs(first[path] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
        # the second of a sample without replacement
        q = sum(math.exp(x) * math.exp(p) / -math.expm1(x) for other, x in every.items() if other != path)
        assert abs(second[path] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_sampled_segmentations_are_all_there_and_apart():
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.default_model())
    # with k beyond their number, all segmentations come out
    for text in ("ab", "a b", "日", "to \t"):
        (found, threshold), *_ = drawn(v, [text], 1000)
        assert {ids: pytest.approx(p, abs=1e-9) for _, p, ids in found} == all_segmentations(v, text) and threshold == -math.inf
    # a long run without blanks, and rows that don't depend on their neighbours
    texts = ["x" * 70_000, "", "the house of the dog " * 500, "日本語" * 300, "the house"]
    several = {texts[0], texts[2], texts[4]}  # no piece joins the signs of texts[3]
    together = drawn(v, texts, 4)
    for i, t in enumerate(texts):
        alone = drawn(v, [""] * i + [t], 4)[i]
        assert alone == together[i]
        assert len({ids for *_, ids in alone[0]}) == (4 if t in several else 1) and all(v.decode(ids) == t for *_, ids in alone[0])


def test_chunks_of_colliding_hashes_stay_apart(monkeypatch):
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.default_model())
    texts = ["the cat and the dog", "one two six ten", "the the the"]
    want = drawn(v, texts, 3)
    monkeypatch.setattr(sentencepiece_sampling.tb, "powers", lambda base, n: np.zeros(n, dtype=np.uint64))
    assert drawn(v, texts, 3) == want


def test_lattices_are_kept_and_shared_by_suffix(monkeypatch):
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.default_model())
    monkeypatch.setattr(v, "lattices", None)
    texts = ["walking talking talking stalking", "the stalking 日本 \U0001f600x", "  two  blanks ", ""]
    want = drawn(v, texts, 3)
    kept = v.lattices
    # of "▁walking", "▁talking" and "▁stalking" the end is there once: "alking" and what is in front of it
    assert drawn(v, texts[:1], 3) == want[:1] and v.lattices is kept
    chunks = ["▁walking", "▁talking", "▁stalking", "▁the", "▁日本", "▁\U0001f600x", "▁▁▁two", "▁▁blanks", "▁"]
    assert kept.nodes == 1 + len({c[i:] for c in chunks for i in range(len(c))})
    size = kept.nodes, kept.edges, kept.signs
    assert drawn(v, texts, 3) == want and (kept.nodes, kept.edges, kept.signs) == size  # the same texts add nothing
    # other texts before these, or lattices that start anew with each part, don't change a row's samples
    drawn(v, ["xwalking alking ing", "g 本"], 3)
    assert v.lattices is kept and drawn(v, texts, 3) == want
    # full ones keep what they have, later nodes stay for a part; with many of those, and after large parts, they start anew
    others = ["quite another text", "stalking the 本 g quite"]
    later = drawn(v, others, 3)
    monkeypatch.setattr(sentencepiece_sampling, "MOST_EDGES", kept.edges - 1)
    size = kept.nodes, kept.edges, kept.signs
    for _ in range(2):
        assert drawn(v, ["zebra zebras", *texts[1:]], 3)[1:] == want[1:] and kept.full == size and kept.edges > size[1]
        assert drawn(v, others, 3) == later and drawn(v, texts, 3) == want and v.lattices is kept and (kept.nodes, kept.edges, kept.signs) == size
    kept.passed = 8 * kept.edges
    assert drawn(v, others, 3) == later and v.lattices is not kept
    kept = v.lattices
    monkeypatch.setattr(sentencepiece_sampling, "MOST_EDGES", 1)
    assert drawn(v, texts, 3) == want and v.lattices is not kept


def test_key_columns_may_have_names_of_the_output(spark):
    df = spark.createDataFrame([(1, "the dog", 5)], "sample long, text string, ids long")
    got = sentencepiece_sampling.sampled(df, ["sample", "ids"], k=2)
    assert got.columns[:2] == ["sample_", "ids_"] and [r["sample_"] for r in got.collect()] == [1, 1]


def test_sentencepiece_round_trip(spark):
    texts = ["", None, " ", "  two  blanks ", "a\u2581b", "\x00\n\t日本 😀", "the " * 300, "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(7, "x", 1)], "id long, text string, rank int").repartition(3)
    got = sentencepiece_sampling.sampled(df, ["id"], k=4)
    rows = got.collect()
    assert all(r["decoded"] for r in rows) and {r["id"] for r in rows} == set(range(8))
    assert [(r["n_pieces"], r["log_prob"], r["inclusion"]) for r in rows if r["id"] in (0, 1)] == [(0, 0.0, 1.0)] * 2
    back = {(r["id"], r["text"]) for r in sentencepiece_sampling.decode(got).collect()}
    assert back == {(i, t or "") for i, t in enumerate(texts)}
    twice = sorted(r["ids"] for r in rows if r["id"] == 7)
    assert twice[::2] == twice[1::2]  # repeated rows give equal samples
    assert sorted(map(str, rows)) == sorted(map(str, sentencepiece_sampling.sampled(df.repartition(1), ["id"], k=4).collect()))
    assert sentencepiece_sampling.sampled(df.limit(0), ["id"]).count() == 0


def test_sentencepiece_query_takes_all_documents(spark, sf):
    from evalloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op2_sentencepiece_sampling(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("decoded").alias("decoded"))
    rows = docs.select("doc_id", "text").join(got, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(r["decoded"] for r in rows)
    assert all(r["n"] == 3 for r in rows if len(r["text"] or "") > 20)


# --- 3 media


def test_media_round_trip(spark, docs, data):
    got = {r["doc_id"]: r for r in media_chunks.read_back(media_chunks.store(extra(docs))).collect()}
    for i, t, *_ in data:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"] == media_chunks.feature(np.frombuffer(payload, dtype=np.uint8)) and r["media_bytes"] > len(payload)
    assert got[len(data) - 9]["media_sha256"] == got[len(data) - 8]["media_sha256"]  # null and empty
    assert media_chunks.read_back(media_chunks.store(empty(spark))).count() == 0


def test_media_chunks_are_content_defined(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(60000))
    pair = spark.createDataFrame([(1, long), (2, "inserted " + long), (3, long)], "doc_id long, text string")
    stored = media_chunks.store(pair)
    got = {r["doc_id"]: r for r in media_chunks.read_back(stored).collect()}
    assert got[1]["media_sha256"] == got[3]["media_sha256"] != got[2]["media_sha256"]
    sizes = [n for r in stored.where("kind = 0").collect() for n in textblocks.unpack(r["digests"], 1)[0].tolist()]
    assert len(sizes) < got[1]["n_chunks"] + 6 and max(sizes) <= media_chunks.MOST  # what follows the insertion is shared
    data = np.frombuffer(long.encode(), dtype=np.uint8)
    h, rolled = media_chunks.gear(data), 0
    for i, b in enumerate(data[:500].tolist()):
        rolled = ((rolled << 1) + int(media_chunks.GEAR[b])) & 0xFFFFFFFF
        if i >= 31:
            assert int(h[i]) == rolled


# --- 4 packing


def check_packing(pieces, data, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = {i: np.array([*e.ids, 1], dtype="<u4") for (i, *_), e in zip(data, t.encode_batch([r[1] or "" for r in data], add_special_tokens=False), strict=True)}
    by, seqs = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert by.keys() == want.keys()
    for i, rs in by.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[i]) and r["ids_crc32"] == zlib.crc32(want[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[i])
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0  # full windows and powers of two: no padding


def test_packing(spark, docs, data):
    check_packing(packing.pack(extra(docs)).collect(), data, packing.default_tokenizer())
    assert packing.pack(empty(spark)).count() == 0


def test_packing_in_shards(spark, docs, data, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    check_packing(packing.pack(docs, targets={"s0": 0.5, "s2": 0.5}).collect(), data, packing.default_tokenizer())


def test_windows_hold_the_target_proportions(spark, monkeypatch):
    """Sources of very different sizes of documents, null and repeated ids: the token shares of windows, over several shards."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 40_000)
    rng = random.Random(13)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])
    rows = [(None if i % 3 else 5, " ".join(word() for _ in range({"a": 40, "b": 900, "c": 3000}[s])), "en", s, 1) for s, n in (("a", 1500), ("b", 60), ("c", 10)) for i in range(n)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5)).select("sequence_id", "source", "length").collect()
    whole, windows = Counter(), {}
    for r in got:
        whole[r["source"]] += r["length"]
        windows.setdefault(r["sequence_id"], Counter())[r["source"]] += r["length"]
    total = sum(whole.values())
    full = [w for w in windows.values() if sum(w.values()) == packing.WINDOW]
    assert len({s >> 32 for s in windows}) > 2 and len(full) * packing.WINDOW > 0.9 * total
    for s in whole:  # a window misses its share by no more than the packets that straddle its ends and the rests of sources
        off = [abs(w[s] / packing.WINDOW - whole[s] / total) for w in full]
        assert sum(off) / len(off) < packing.PACKET / packing.WINDOW and abs(sum(w[s] for w in full) / (len(full) * packing.WINDOW) - whole[s] / total) < 0.03


def test_round_robin_keeps_proportions():
    from collections import deque

    queues = {s: deque((f"{s}{i}", 300) for i in range(n)) for s, n in (("a", 400), ("b", 200), ("c", 100))}
    share = {"a": 4 / 7, "b": 2 / 7, "c": 1 / 7}
    served, total = Counter(), 0
    for uid, _, n in packing.Queues(queues, share, dict.fromkeys(share, 0.0)).stream(2048, 512):
        served[uid[0]] += n
        total += n
        assert all(abs(served[s] - share[s] * total) < 2048 * 3 for s in share)
    assert total == 700 * 300


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = [*" '  \n\n\t.,stremlvd0½²’日😀\x1c\x85\xa0_-", "'s", "don't", "I'LL", "l'été", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "'", "'ll", "''s", "a'", "  ", "\n"]
    ids, at = tokens.encode("".join(texts), np.array([len(x) for x in texts]), path)
    for a, b, e in zip(at[:-1], at[1:], t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == e.ids


# --- 5 chat


def brute_chat(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return {
        c: (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest(), sum(len(x) for r, x in ts if r == "assistant"), hashlib.sha256("".join(x for r, x in ts if r == "assistant").encode()).hexdigest())
        for c, ts in out.items()
    }


def test_chat(spark):
    odd = r"\### Assistant: </turn> ok <turn user> \l \\ <"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "assistant", ""), (2, 1, "assistant", "日本 😀"), (3, 0, None, None), (3, 1, "a>b\n<turn", "x\n"), (None, 0, "assistant", "z"), (4, 1, "user", "t"), (4, 1, "user", "t"), (4, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    segments = chat_format.format_turns(chat_format.canonical_turns(records))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(segments).collect()}
    assert got == brute_chat(rows)
    for r in segments.collect():
        assert r["formatted"].count("</turn>") == 1 and r["formatted"].count("<turn ") == 1
    assert chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(records.limit(0)))).count() == 0


def test_layouts_by_fingerprint(spark):
    layouts = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "do", "input": "this", "output": "a"}, {"instruction": "do", "output": None}, {"question": "q", "answer": "a"}, {"other": 1},
    ]
    df = spark.createDataFrame([(i, None, json.dumps(x)) for i, x in enumerate(layouts)] + [(99, None, "no json"), (98, None, None)], "conv_id long, turn long, record string")
    got = {}
    for r in chat_format.canonical_turns(df).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    plain = [("user", "q"), ("assistant", "a")]
    assert [got[i] for i in (0, 2, 3, 6)] == [plain] * 4 and got[1] == [("system", "s"), *plain]
    assert got[4] == [("user", "do\n\nthis"), ("assistant", "a")] and got[5] == [("user", "do"), ("assistant", "")] and got[7] == got[98] == got[99] == [(None, None)]
    a, b = chat_format.paths({"a": [{"b": 1}, {"c": []}], "d": {}}), {"a[].b", "a[].c[]", "d"}
    assert a == b and chat_format.fingerprint(a) == chat_format.fingerprint(b) != chat_format.fingerprint({"a"})


# --- 6 near duplicates


def brute_jaccard(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, docs, data, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(extra(docs), size, percent).collect()}
    assert got == brute_jaccard(data, size, percent)


def test_jaccard_hot_group_in_chunks(spark, monkeypatch):
    """A large group of near copies, chained by edits, over several chunks."""
    monkeypatch.setattr(jaccard_join, "LEAST_CHUNK", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(i + 1000, r[1]) for i, r in enumerate(rows[:30])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == brute_jaccard(rows, 3, 80)


def test_jaccard_edges(spark):
    assert jaccard_join.link_components(empty(spark)).count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (7, None), (7, None), (3, "A B c d"), (9, "a"), (8, "A")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, None), (5, None), (3, None), (7, 7), (9, 8), (8, 8)}
    kept = jaccard_join.keep_one(spark.createDataFrame(rows[1:], "doc_id long, text string"), 3, 90)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]


def test_keep_one_with_repeated_and_null_ids(spark):
    """Different texts of one id, null or not, are different documents; only linked or equal texts go."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(None, text(i)) for i in range(20)] + [(4, text(i)) for i in range(30, 36)] + [(None, text(0)), (4, text(30)), (9, text(31)), (None, text(32)), (2, text(40)), (1, text(40) + " more"), (5, None), (5, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS number", "2 AS id")
    kept = jaccard_join.keep_one(df, 3, 80)
    want = [(None, text(i)) for i in range(20)] + [(4, text(i)) for i in (30, 31, 33, 34, 35)] + [(None, text(32)), (1, text(40) + " more"), (5, None), (5, ""), (None, None)]
    assert kept.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    linked = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df, 3, 80).collect()]
    assert len(linked) == len(rows) and {x[1] for x in linked} == {0, 10, 11} and (9, 10, 4) in linked and (4, 10, None) in linked and (2, 10, 1) in linked and linked.count((4, 10, 4)) == 6


def test_trie_finds_all_classes():
    rng = random.Random(8)
    for _ in range(60):
        percent, sets = rng.choice([50, 80, 90]), []
        base = sorted(rng.sample(range(40), 20))
        for _ in range(rng.randrange(2, 25)):
            s = set(base)
            for _ in range(rng.randrange(5)):
                s.symmetric_difference_update({rng.randrange(40)})
            sets.append(np.array(sorted(s), dtype=np.int64))
        trie, parent = jaccard_join.Trie(percent, 40), list(range(len(sets)))
        sets.sort(key=len)
        for s in sets:
            trie.add(s, len(s))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                o = len(set(a.tolist()) & set(sets[j].tolist()))
                if 100 * o >= percent * (len(a) + len(sets[j]) - o):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
        assert [trie.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


# --- 7 vectors


def brute_vectors(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = (i, np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)))
    links, parent = Counter(), {k: k for k in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = sorted(good)
    for a in ks:
        for b in ks:
            if a < b and len(good[a][1]) == len(good[b][1]) and float(good[a][1] @ good[b][1]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, links[k], low[find(k)], low[find(k)] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 24))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.3, 1.5])]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 24), (204, [float("nan")] + [1.0] * 23), (205, [None] + [1.0] * 23), (206, []), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [float("inf")] * 24), (210, [-x for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 AS bin", "2 AS m", "vec_id AS rep")
    got = sorted(tuple(r) for r in vector_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute_vectors(rows)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
    assert vector_dedup.near_duplicates(df.where("vec_id = 202")).first()["kept"]


def test_wide_vectors_have_principal_axes(spark):
    """Above MOMENTS components the leading axes come from subspace iteration; links are exact."""
    rng = np.random.default_rng(6)
    width = vector_dedup.MOMENTS + 88
    spread = np.r_[np.full(5, 20.0), np.ones(width - 5)]
    rows = [(i, (rng.normal(size=width) * spread).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i][1]) + rng.normal(size=width) * c).tolist()) for i, c in enumerate([0.01, 0.5, 1.0, 1.5, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vector_dedup.near_duplicates(df).collect()) == brute_vectors(rows)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vector_dedup.axes(df.select(F.col("embedding").alias("x")), width)
    best = np.sort(np.linalg.eigvalsh(x.T @ x))[::-1]
    held = np.linalg.norm(x @ found, axis=0) ** 2
    assert np.allclose(found.T @ found, np.eye(32)) and held[:5].sum() > 0.99 * best[:5].sum() and (held[:4] >= held[1:5] - 1e-9).all()


# --- 8 language ID


def test_language_id(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.held_out_predictions(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert got[0] >= 0.98 and 0 <= got[1] <= got[2] <= 1


def test_language_id_edges(spark, docs, data):
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language_id.held_out_predictions(extra(docs)).collect()}
    for i, t, *_ in data:
        assert (got[i][0] == "und") == (not any(map(str.isalpha, t or ""))) and got[i][2] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert language_id.held_out_predictions(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, "text", None), (None, "é", None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.held_out_predictions(none).collect()} == {("und", 0.0)}
    assert language_id.keep_known(docs).columns == docs.columns


def test_all_languages_are_learned(spark):
    """More than 200 languages, some of them with very long texts only, and one id for all rows."""
    rng = random.Random(12)
    rows = []
    for k in range(230):
        words = ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(4)) for _ in range(20)]
        rows += [(1 if k % 2 else k * 10 + i, " ".join(rng.choice(words) for _ in range(30 if k else 6000)), f"l{k:03}") for i in range(4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert len(model.langs) == 230
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, keep=("lang",)).where("lang <> lang_pred").count()
    assert got <= 20


def test_stages_take_clashing_names_null_and_repeated_ids(spark, sf):
    """Every stage of the pipeline over columns that are named like its own, ids that repeat or are null, and no rows."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 7 ELSE doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    odd = odd.selectExpr("*", "1 AS starts", "'e' AS ends", "0.5 AS score", "'xx' AS lang_pred", "2 AS number", "3 AS __id", "4 AS __text", "5 AS __copy", "6 AS __null", "text AS uid", "7 AS count", "8 AS print", "9 AS doc", "10 AS id", "11 AS name")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and stage(spark, odd.limit(0), sf).count() == 0
        texts = {r["text"] for r in out.collect()}
        assert texts and out.where("starts <> 1 OR ends <> 'e' OR score <> 0.5 OR lang_pred <> 'xx' OR number <> 2").count() == 0
    pieces = cp.STAGES[-1][1](spark, odd, sf)
    assert pieces.agg(F.sum("length")).first()[0] == sum(r["n"] for r in pieces.where("start = 0").selectExpr("doc_tokens AS n").collect())
    assert cp.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0


def test_keep_known_rejects_unfamiliar_text(spark, sf):
    """Unseen scripts, unseen languages of a known script and letters at random go; texts of the four languages and too short ones stay."""
    rng = random.Random(8)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)),
    ]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign)] + [(-100, "ok", None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert {i for i in kept if i < 0} == {-100}
    assert kept - {-100} == {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}


def test_kernel_equals_definition():
    texts = [b"abcab", b"xyz abc", "éé a".encode(), b"b"]
    model = language_id.Classifier(texts, ["a", "b", "a", "b"])
    grams = lambda t, n: {t.lower()[i : i + n] for i in range(len(t) - n + 1)}
    g = language_id.Grams()
    probe = b"ABxyq"
    sets = g.distinct(g.codes(np.frombuffer(probe, dtype=np.uint8)), 0, len(probe))
    assert [len(s) for s in sets] == [len(grams(probe, n)) for n in (1, 2, 3)]
    k = model.presence([sets]) @ model.landmarks
    order = sorted(range(4), key=lambda j: -len(texts[j]))
    want = {t: sum(len(grams(probe, n) & grams(t, n)) / math.sqrt(len(grams(probe, n)) * len(grams(t, n))) / 3 for n in (1, 2, 3) if grams(t, n)) for t in texts}
    assert sorted(k[0].tolist()) == pytest.approx(sorted(want.values()), abs=1e-6) and order


# --- 9 repeated passages


def brute_repeats(rows, size):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    first, gone = {}, {i: set() for i in words}
    for i in sorted(words):
        for s in range(len(words[i]) - size + 1):
            key = tuple(words[i][s : s + size])
            if key in first:
                gone[i].update(range(s, s + size))
            else:
                first[key] = (i, s)
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in words.items()}


@pytest.mark.parametrize("size", [20, 3])
def test_repeats(spark, docs, data, size):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removal_report(extra(docs), size).collect()}
    assert got == brute_repeats(data, size)


def test_repeats_over_blocks_and_unsorted_ids(spark, data, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 64)
    rows = [(10**12 - 7 * i, *r[1:]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removal_report(df).collect()}
    assert got == brute_repeats(rows, 20)


def test_repeats_with_colliding_hashes(spark, data, monkeypatch):
    """With 14 bits of window hash most windows collide; the other 24 bits still tell them apart."""
    plain = textblocks.windows

    def few_bits(h, first, size):
        out, row, start = plain(h, first, size)
        return out & np.uint64(0xFE0000000000007F), row, start

    monkeypatch.setattr(textblocks, "windows", few_bits)
    found = []
    for r in [r for r in data if r[1]]:
        raw = r[1].encode()
        offsets = np.array([0, len(raw)])
        b = np.frombuffer(raw, dtype=np.uint8)
        first, starts, ends = textblocks.words(offsets, b)
        words = textblocks.word_hashes(b, starts, ends, False)
        h, row, start = textblocks.windows(words, first, 20)
        found.append((h, textblocks.window_checks(words, first[row] + start, 20), np.full(len(h), r[0]), start))
    h, check, doc, start = map(np.concatenate, zip(*found, strict=True))
    assert len(np.unique(h)) < len(h) / 2
    buckets, gone = 64, {i: set() for i, *_ in data}
    met = []
    for rows in (slice(0, len(h) // 2), slice(len(h) // 2, None)):
        for batch in substring_dedup._block(h[rows], check[rows], doc[rows], start[rows], 8, buckets):
            met.append(pa.Table.from_batches([batch]))
    sent = pa.concat_tables(met)
    for s in set(sent.column("slice").to_pylist()):
        table = substring_dedup._meet(buckets)(sent.filter(pc.equal(sent.column("slice"), s)))
        for blob in table.column("body").to_pylist():
            for d, at in zip(*(x.tolist() for x in substring_dedup._from_bucket(blob)), strict=True):
                gone[d].update(range(at, at + 20))
    assert {i: len(g) for i, g in gone.items()} == {i: v[1] for i, v in brute_repeats(data, 20).items()}


def test_drop_repeats(spark, docs, data):
    assert substring_dedup.removal_report(empty(spark)).count() == 0
    out = {r["doc_id"]: r for r in substring_dedup.drop_repeats(docs).collect()}
    want = brute_repeats(data, 20)
    for i, t, *rest in data:
        assert list(out[i][2:]) == rest
        if want[i][1] == 0:
            assert out[i]["text"] == t
        else:
            assert hashlib.sha256(" ".join(WORD.findall(out[i]["text"])).encode()).hexdigest() == want[i][2]
    # rows of one id with different texts are different documents
    mixed = [(7, "p q r s t"), (7, "a b c d e"), (None, "x a b c"), (None, "p q r"), (9, "a b c d e")]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.removal_report(spark.createDataFrame(mixed, "doc_id long, text string").repartition(2), 3).collect()))
    assert got == [(0, 3, 0), (0, 4, 0), (7, 5, 3), (7, 5, 3), (9, 5, 5)]
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.removal_report(twice, 3).collect()) == [(0, 0), (1, 5), (1, 5)]


# --- 10 WARC


def test_warc(spark, monkeypatch):
    rng = random.Random(9)
    big = "".join(chr(rng.randrange(0x21, 0x2FF)) for _ in range(300_000))
    rows = [(3, "http://a", "x" * 200), (1, "http://b\r\nInjected: y", "x" * 200), (2, None, "x" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", big), (9, "u", big + "é"), (None, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "1 AS record", "2 AS size", "'k' AS key", "3 AS first")
    records = warc.write_archive(df)
    assert records.where("chunk > 0").count() > 4 and records.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK + 1024
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_archive(records).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        first = {2: 1, 3: 1}.get(i)
        kind = "revisit" if i in (2, 3, 11) else "response"
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), kind, first)
    import gzip

    parts = {}
    for r in records.orderBy("record", "chunk").collect():
        parts[r["record"]] = parts.get(r["record"], b"") + r["data"]
    text = gzip.decompress(b"".join(parts.values()))  # a multi-member .warc.gz
    assert text.startswith(b"WARC/1.1\r\n") and b"\r\nInjected" not in text and text.count(b"WARC-Record-ID: ") == len(rows)
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0


def test_warc_writer_and_reader_stream():
    """A payload of 56 MB leaves the writer in batches of BATCH bytes, and comes back whole from a reader that holds a chunk."""
    raw = np.random.default_rng(3).integers(0x21, 0x7F, 56 << 20, dtype=np.uint8).tobytes()
    digest = hashlib.sha256(raw).hexdigest()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), pa.array([raw], pa.binary()), pa.array([digest]), pa.array([len(raw)]), pa.array([1])], ["page", "url", "html", "digest", "size", "first"])
    batches = list(warc._write(iter([batch])))
    assert len(batches) > 8 and max(sum(map(len, b.column("data").to_pylist())) for b in batches) <= warc.BATCH
    (row,) = [r for b in warc._read(iter(batches)) for r in b.to_pylist()]
    assert (row["page_id"], row["payload_bytes"], row["payload_digest"]) == (1, len(raw), digest)
    easy = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), pa.array([b"a" * (20 << 20)], pa.binary()), pa.array([hashlib.sha256(b"a" * (20 << 20)).hexdigest()]), pa.array([20 << 20]), pa.array([1])], batch.schema.names)]
    (row,) = [r for b in warc._read(warc._write(iter(easy))) for r in b.to_pylist()]
    assert row["payload_bytes"] == 20 << 20


# --- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    one = cp.STAGES[0][1](spark, docs, sf)
    assert {r["doc_id"] for r in one.collect()} == {i for i, t in rows if t and any(map(str.isalpha, t))} and one.columns == docs.columns
    two = cp.STAGES[1][1](spark, docs, sf)
    want = brute_jaccard(rows, 5, 80)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(i for i, (_, c) in want.items() if c == i) and two.columns == docs.columns
    three = {r["doc_id"]: r for r in cp.STAGES[2][1](spark, docs, sf).collect()}
    want = brute_repeats(rows, 20)
    assert {i: hashlib.sha256(" ".join(WORD.findall(r["text"])).encode()).hexdigest() for i, r in three.items()} == {i: v[2] for i, v in want.items() if v[0] > v[1]}
    assert all(r["n_chars"] == len(r["text"]) for r in three.values())
    check_packing(cp.STAGES[3][1](spark, docs, sf).collect(), rows, packing.default_tokenizer())


def test_queries_match_sql(spark, sf):
    import duckdb

    from evalloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        names = ", ".join(f'"{c}"' for c in cols)
        assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(con.sql(f"SELECT {names} FROM ({sql})").fetchall(), key=repr), name
