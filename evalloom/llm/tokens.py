"""Batched byte-level BPE: texts are cut into the tokenizer's pre-tokens by array operations on code points, and each distinct pre-token is encoded once.

Distinct means by a 64-bit hash with the length. A table of recent pre-tokens (hash, place of their ids) answers the known ones by one gather; the others are
merged together, one merge in every word a round, by array operations on their bytes. Pre-tokens of more than LONGEST bytes, and models other than plain
byte-level BPE, go to the tokenizer itself.

The cut follows the usual byte-level pattern: contractions, runs of letters, of numbers or of other signs with one space before them, and runs of white space, of
which the last character stays with what follows. Ids equal those of the tokenizer on whole texts; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from evalloom.llm import textblocks as tb

MEMO_BITS = 19  # of the table of recent pre-tokens
MEMO_IDS = 1 << 21
LONGEST = 64
NONE = np.int32(np.iinfo(np.int32).max)
SPACE = 3
_STATE: dict[str, object] = {}
# White space of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    if "classes" not in _STATE:
        out = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                out[c] = 1
            elif kind == "N":
                out[c] = 2
        out[WHITE] = SPACE
        _STATE["classes"] = out
    return _STATE["classes"]


def pretokens(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie one after another; each ends where the next begins."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[cp]
    opens = np.zeros(n + 1, dtype=bool)
    opens[offsets] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = (cp[:-1] == 0x20) & ~opens[1:n]
    white = kind == SPACE
    start = run & (white | ~after_blank)
    last = white.copy()  # the last of a run of white space, when something follows in the text
    last[:-1] &= ~white[1:]
    last &= ~opens[1:]
    start |= last
    quote = np.flatnonzero((cp == 0x27) & run & start)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~opens[quote + 1] & (kind[quote + 1] == 1)]
    if len(quote):
        one = cp[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        more = quote + 2 < n
        two = np.where(more, cp[np.minimum(quote + 2, n - 1)], 0)
        long = more & ~opens[np.minimum(quote + 2, n)] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        for at in (quote[short] + 2, quote[long] + 3):
            start[at[at < n]] = True
    return np.flatnonzero(start)


def _powers(n: int) -> np.ndarray:
    p = _STATE.get("powers")
    if p is None or len(p) < n:
        p = np.full(max(n, 64), np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
        p[0] = 1
        p = _STATE["powers"] = np.multiply.accumulate(p)
    return p


class Pairs:
    """Ranks of mergeable pairs: hash levels without collisions, each for the pairs that collide in the one before."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.merged, self.levels = merged, []
        key, rank = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), np.arange(len(left), dtype=np.int32)
        bits = 19
        while len(key):
            at = self._slot(key, len(self.levels), bits)
            _, first = np.unique(at, return_index=True)
            keys, ranks = np.full(1 << bits, (1 << 64) - 1, dtype=np.uint64), np.full(1 << bits, NONE, dtype=np.int32)
            keys[at[first]], ranks[at[first]] = key[first], rank[first]
            self.levels.append((bits, keys, ranks))
            key, rank, bits = np.delete(key, first), np.delete(rank, first), max(bits - 3, 8)

    @staticmethod
    def _slot(key: np.ndarray, level: int, bits: int) -> np.ndarray:
        x = (key ^ key >> np.uint64(23)) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(key), NONE, dtype=np.int32)
        for level, (bits, keys, ranks) in enumerate(self.levels):
            at = self._slot(key, level, bits)
            same = keys[at] == key
            out[same] = ranks[at[same]]
        return out


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.bytes, self.pairs = self._tables(json.loads(self.tokenizer.to_str())["model"])
        self.keys = np.zeros(1 << MEMO_BITS, dtype=np.uint64)
        self.begin, self.count = np.zeros(1 << MEMO_BITS, dtype=np.int32), np.zeros(1 << MEMO_BITS, dtype=np.int32)
        self.ids, self.used = np.zeros(MEMO_IDS, dtype=self.dtype), 0

    @staticmethod
    def _tables(model: dict) -> tuple[np.ndarray | None, Pairs | None]:
        """(id of each byte, merges), or nothing for a model that isn't plain byte-level BPE."""
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        signs = byte_signs()
        vocab = model.get("vocab")
        if model.get("type") != "BPE" or any(model.get(k) for k in odd) or any(c not in vocab for c in signs):
            return None, None
        both = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in both], dtype=np.int64).reshape(-1, 3)
        return np.array([vocab[c] for c in signs], dtype=np.int32), Pairs(ids[:, 0], ids[:, 1], ids[:, 2].astype(np.int32))

    def merge(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each word) of words by their places in raw."""
        n = len(size)
        sym = self.bytes[raw[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]]
        word = np.repeat(np.arange(n), size)
        rank = np.full(len(sym), NONE, dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.pairs.rank(sym[inner], sym[inner + 1])
        counts, ready = np.zeros(n, dtype=np.int64), []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            span = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            done = best == NONE
            if done.any():
                counts[word[first[done]]] = span[done]
                out = np.repeat(done, span)
                ready.append((word[out], sym[out]))
                sym, word, rank = sym[~out], word[~out], rank[~out]
                best, span = best[~done], span[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, span))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # the leftmost of each word
            sym[at] = self.pairs.merged[best]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            at = at - np.arange(len(at))
            rank[at] = NONE
            last = len(sym) - 1
            right = at[at < last]
            right = right[word[right] == word[right + 1]]
            left = at[at > 0]
            left = left[word[left] == word[left - 1]] - 1
            some = np.concatenate([right, left])
            rank[some] = self.pairs.rank(sym[some], sym[some + 1])
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]) if n else 0, dtype=self.dtype)
        for w, s in ready:
            lead = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            k = counts[w[lead]]
            ids[np.repeat(ends[w[lead]] - k, k) + np.arange(len(w)) - np.repeat(lead, k)] = s
        return ids, counts

    def words(self, text: str, begin: np.ndarray, size: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of pre-tokens by their places in the text; width: bytes before each code point."""
        wide = width[begin + size] - width[begin]
        short = wide <= LONGEST if self.pairs else np.zeros(len(size), dtype=bool)
        counts, parts = np.zeros(len(size), dtype=np.int64), []
        if short.any():
            ids, counts[short] = self.merge(np.frombuffer(text.encode(), dtype=np.uint8), width[begin[short]], wide[short])
            parts.append((short, ids))
        if not short.all():
            strings = [text[a : a + b] for a, b in zip(begin[~short].tolist(), size[~short].tolist(), strict=True)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            counts[~short] = [len(g) for g in got]
            parts.append((~short, np.array([i for g in got for i in g], dtype=self.dtype)))
        if len(parts) == 1:
            return parts[0][1], counts
        out = np.zeros(int(counts.sum()), dtype=self.dtype)
        for some, ids in parts:
            out[np.repeat(some, counts)] = ids
        return out, counts

    def places(self, h: np.ndarray, text: str, cp: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin in self.ids, count) of every pre-token."""
        slot = (h >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        begin, count = self.begin[slot], self.count[slot]
        if not len(miss):
            return begin, count
        u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        width = np.zeros(len(cp) + 1, dtype=np.int64)
        np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=width[1:])
        at = miss[first]
        ids, counts = self.words(text, starts[at], size[at], width)
        if self.used + len(ids) > len(self.ids):  # start again with an empty table
            self.keys[:], self.used = 0, 0
            if len(miss) < len(h):
                return self.places(h, text, cp, starts, size)
            if len(ids) > len(self.ids):
                self.ids = np.zeros(len(ids), dtype=self.dtype)
        self.ids[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        begin[miss], count[miss] = places[back], counts[back]
        slot = slot[at]
        self.keys[slot], self.begin[slot], self.count[slot] = u, places, counts
        return begin, count


def byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes themselves, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def encoder(path: str) -> Encoder:
    if ("encoder", path) not in _STATE:
        _STATE["encoder", path] = Encoder(path)
    return _STATE["encoder", path]


def id_type(path: str) -> str:
    return encoder(path).dtype.str


def encode(text: str, lengths: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n + 1 offsets into them) of texts that lie one after another in `text`, by their lengths in characters."""
    coder = encoder(path)
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    starts = pretokens(cp, offsets)
    if len(starts) == 0:
        return np.zeros(0, dtype=coder.dtype), np.zeros(len(lengths) + 1, dtype=np.int64)
    size = np.diff(np.append(starts, len(cp)))
    at = np.arange(len(cp)) - np.repeat(starts, size)
    value = (cp.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[at]
    h = np.add.reduceat(value, starts) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
    h = tb.mix(h ^ h >> np.uint64(29)) | np.uint64(1)
    begin, count = coder.places(h, text, cp, starts, size)
    ends = np.cumsum(count, dtype=np.int64)
    ids = coder.ids[np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]))]
    return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
