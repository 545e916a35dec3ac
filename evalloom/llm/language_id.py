"""Language ID by string kernels.

The kernel of two texts blends, over n = 1..3, the shared distinct byte n-grams (lower-cased A-Z) divided by the geometric mean of both counts.
Landmarks give the Nystrom features, one-versus-rest kernel ridge regression the weights; texts are scored in batches, as products of presence
matrices over the landmarks' n-grams with the landmarks and then with the weights. Whole texts count; n-grams that no landmark has still count in a text's norm.

A winning score says only which language is nearest, so unfamiliar text is rejected by its known letters: the share of a text's distinct trigrams of letters,
blanks and non-ASCII bytes that a landmark has. It must reach REJECT times the share that all but UNSURE of the fit's rows of that language have (a
landmark's own trigrams count if another landmark has them). PRIOR trigrams count as known, so that a text of a few letters isn't judged by them.

The fit uses a bounded sample of labelled rows, drawn by a hash of id and text: PER_LANG of each language, fewer (two at least) where that would be more than SAMPLE_ROWS in
all; texts of more than LONG bytes only where a language has too few others. All languages are learned. Defined results: null text or text without a letter is `und` with score 0, and so is everything if there is nothing to learn from; ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm import textblocks as tb
from evalloom.runtime import ship

PER_LANG = 150
SAMPLE_ROWS = 30_000
LONG = 1 << 16
LANDMARKS = 128
RIDGE = 1e-3
BATCH = 128
REJECT, UNSURE, PRIOR = 0.7, 0.01, 4
ASCII_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])
WORDLIKE = ASCII_LETTER | (np.arange(256) == 0x20) | (np.arange(256) >= 0x80)


class Grams:
    """Distinct n-grams of byte strings, by a table of last positions that needs no clearing."""

    def __init__(self):
        self.last = [np.zeros(1 << (8 * n), dtype=np.int32) for n in (1, 2, 3)]

    def codes(self, data: np.ndarray) -> list[np.ndarray]:
        one = tb.LOWER[data].astype(np.int32)
        two = one[:-1] << 8 | one[1:]
        return [one, two, two[:-1] << 8 | one[2:]]

    def distinct(self, codes: list[np.ndarray], lo: int, hi: int) -> list[np.ndarray]:
        out = []
        for n, (c, last) in enumerate(zip(codes, self.last, strict=True)):
            c = c[lo : max(lo, hi - n)]
            at = np.arange(len(c), dtype=np.int32)
            last[c] = at
            out.append(c[last[c] == at])
        return out


class Classifier:
    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        grams = Grams()
        sets = [grams.distinct(grams.codes(np.frombuffer(t, dtype=np.uint8)), 0, len(t)) for t in texts]
        chosen, by = [], {x: [i for i, y in enumerate(langs) if y == x] for x in self.langs}
        for k in range(max(map(len, by.values()))):
            chosen += [v[k] for v in by.values() if k < len(v)]
        chosen = chosen[: max(LANDMARKS, len(self.langs))]
        self.grams = [np.unique(np.concatenate([sets[i][n] for i in chosen])) for n in range(3)]
        self.starts = np.cumsum([0, *map(len, self.grams)])
        self._tables = None
        self.landmarks = np.zeros((int(self.starts[-1]), len(chosen)), dtype=np.float32)
        for j, i in enumerate(chosen):
            self.landmarks[:, j] = self.presence([sets[i]])[0]
        k = np.concatenate([self.presence(sets[lo : lo + BATCH]) @ self.landmarks for lo in range(0, len(sets), BATCH)]).astype(np.float64)
        inner = k[chosen]
        y = np.array([[1.0 if a == b else -1.0 for b in self.langs] for a in langs])
        w = 1.0 / np.array([len(by[a]) for a in langs])
        left = (k * w[:, None]).T @ k + RIDGE * (inner + 1e-6 * np.eye(len(inner)))
        self.weights = np.linalg.lstsq(left, (k * w[:, None]).T @ y, rcond=None)[0]
        holders = np.count_nonzero(self.landmarks[self.starts[2] :], axis=1)
        own = set(chosen)
        shares = np.array([self.familiarity([x], holders > (i in own))[0] for i, x in enumerate(sets)])
        self.floors = REJECT * np.array([np.quantile(shares[by[x]], UNSURE) for x in self.langs])

    def tables(self) -> list[np.ndarray]:
        """The row of each n-gram among the landmarks' n-grams, -1 for others."""
        if self._tables is None:
            self._tables = []
            for n, g in enumerate(self.grams):
                t = np.full(1 << (8 * (n + 1)), -1, dtype=np.int32)
                t[g] = np.arange(len(g)) + self.starts[n]
                self._tables.append(t)
        return self._tables

    def presence(self, sets: list[list[np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(sets), int(self.starts[-1])), dtype=np.float32)
        for i, grams in enumerate(sets):
            for g, table in zip(grams, self.tables(), strict=True):
                if len(g):
                    at = table[g]
                    out[i, at[at >= 0]] = 1.0 / np.sqrt(3 * len(g)) if len(g) else 0.0
        return out

    def familiarity(self, sets: list[list[np.ndarray]], among: np.ndarray | None = None) -> np.ndarray:
        """The share of each text's word-like trigrams that landmarks have; among: which of the landmarks' trigrams count as known."""
        out = np.ones(len(sets))
        for i, (_, _, g) in enumerate(sets):
            g = g[WORDLIKE[g >> 16] & WORDLIKE[g >> 8 & 255] & WORDLIKE[g & 255]]
            at = self.tables()[2][g]
            at = at[at >= 0]
            known = len(at) if among is None else np.count_nonzero(among[at - self.starts[2]])
            out[i] = (known + PRIOR) / (len(g) + PRIOR)
        return out

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def decide(self, sets: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        f = (self.presence(sets) @ self.landmarks).astype(np.float64) @ self.weights
        return f.argmax(axis=1), np.clip((f.max(axis=1) + 1) / 2, 0.0, 1.0)


def _letters(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return out


def _predict(model: Classifier | None, reject: bool = False, names: tuple[str, str] = ("lang_pred", "score")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams() if model else None
        for batch in batches:
            offsets, data = tb.utf8(batch.columns[-1])
            pred = np.full(len(offsets) - 1, "und", dtype=object)
            score = np.zeros(len(offsets) - 1)
            for lo, hi in tb.parts(offsets) if model else ():
                off = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                rows = np.flatnonzero(_letters(off, part))
                codes = grams.codes(part)
                for a in range(0, len(rows), BATCH):
                    some = rows[a : a + BATCH]
                    sets = [grams.distinct(codes, off[i], off[i + 1]) for i in some]
                    best, value = model.decide(sets)
                    if reject:
                        sure = model.familiarity(sets) >= model.floors[best]
                        some, best, value = some[sure], best[sure], value[sure]
                    pred[lo + some] = [model.langs[b] for b in best]
                    score[lo + some] = value
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names[:-1], *names])

    return run


def fit(labelled: DataFrame) -> Classifier | None:
    """A classifier from (doc_id, text, lang) rows, by a bounded sample of them."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    most = max(2, min(PER_LANG, SAMPLE_ROWS // len(counts)))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 34)
    shares = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2.0 * most / r["count"] + 20 / r["count"]) * (1 << 30))) for r in counts], "lang string, share long")
    some = labelled.select("lang", "text", draw.alias("draw")).join(F.broadcast(shares), "lang").where("draw < share")  # as many rows as languages, which are collected as well
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.octet_length("text") > LONG, "draw", "text"))
    rows = some.withColumn("place", place).where(F.col("place") <= 2 * most).select("lang", "text", "draw").collect()
    rows.sort(key=lambda r: (r["draw"], r["text"]))
    texts, langs, n = [], [], {}
    for r in rows:
        if n.get(r["lang"], 0) < most and any(map(str.isalpha, r["text"])):
            n[r["lang"]] = n.get(r["lang"], 0) + 1
            texts.append(r["text"].encode())
            langs.append(r["lang"])
    return Classifier(texts, langs) if texts else None


def predict(docs: DataFrame, model: Classifier | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), reject: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns with two more, by default lang_pred and score (0 to 1: the winning regression value, from -1..1); reject: unfamiliar text is `und` with score 0."""
    ship(docs.sparkSession)
    text = tb.fresh([*keep, *names], "text")
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(text))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return source.mapInArrow(tb.tidy(_predict(model, reject, names)), schema)


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3, F.lit(-1))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Predictions of every row by a classifier that has learned from the rows whose remainder isn't 1."""
    model = fit(docs.where(remainder() != 1).select("doc_id", "text", "lang"))
    marked = docs.select(F.col("doc_id"), (remainder() == 1).alias("held_out"), "text")
    return predict(marked, model, keep=("doc_id", "held_out"))


def keep_known(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """docs without those that have no language: `und`, text unfamiliar to the classifier, or none that reaches the least score."""
    model = fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.limit(0)
    names = tb.fresh(docs.columns, "lang_pred"), tb.fresh(docs.columns, "score")
    out = predict(docs.withColumn("text", F.col("text").cast("string")), model, keep=tuple(docs.columns), reject=True, names=names)
    return out.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*docs.columns)
