"""SentencePiece encoding and decoding: sampled segmentations by Gumbel top-k without replacement.

A text becomes a lattice of the vocabulary's pieces over its code points (spaces as U+2581, one in front; code points without a piece are their UTF-8 byte
pieces). A piece's log probability follows Zipf's law by its rank in the vocabulary. Segmentations are drawn by a perturbed A-star search: an item of the agenda is a
partial segmentation with edges split off, it stands for all its completions by other edges, and its priority is the greatest Gumbel-perturbed log probability among
them. Expanding the best item draws the completion that has its priority and splits the others into one item for each edge of the completion, with priorities under that
of the whole. The first k completions are an exact sample of k distinct segmentations without replacement; the (k + 1)-th priority is the threshold of their inclusion
probabilities. No more than k items can still be wanted, so the agenda holds k of them and memory is bounded by k times the text.

Array operations do the work of many rows together: no piece holds a blank after another sign, so lattices fall into runs of blanks with what follows (chunks).
A place's completions depend on the rest of its chunk only, so each distinct rest gets its edges and masses once, for all chunks that end in it and, until the kept lattices
are full, for all parts of the rows that a worker takes. Each expansion walks all chunks of all rows of a part at the same time.

Draws are hashes of the row's key, the expansion and the place in the text, so a row gives the same samples wherever it is computed. Decoding restores the text exactly; a
U+2581 in a text is written as bytes.
Defined results: null text is empty; empty text has one segmentation, without pieces, of probability 1; a text with fewer than k segmentations gives all of them, with inclusion 1;
rows of equal key and text give equal samples.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import textblocks as tb
from evalloom.llm.tokens import NONE, Pairs
from evalloom.runtime import ship

SAMPLES = 3
BLANK = "▁"
MARK = ord(BLANK)
LITERAL = 0xD800  # marks a U+2581 of the text in lattices; a lone surrogate occurs in no text
PART_BYTES = 1 << 19
MOST_EDGES = 3 << 20  # of kept lattices, about 200 MB with their nodes
FIRST_RANKED = 259  # of the model's vocabulary: control and byte pieces come before
_STATE: dict[str, Vocabulary] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one span after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def starts_of(size: np.ndarray) -> np.ndarray:
    """n + 1 offsets of spans that lie one after another."""
    out = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=out[1:])
    return out


class Vocabulary:
    """Pieces with their log probabilities, and the tree of their prefixes: states numbered from 0, the piece that ends in each (or -1)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_pieces = {p for p in self.pieces if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if p in byte_pieces}
        weights = {i: 1.0 / (i - FIRST_RANKED + 3.7) for i in range(FIRST_RANKED, n)}
        byte = min(weights.values()) / 10
        total = sum(weights.values()) + 256 * byte
        self.raw = [bytes([int(p[3:5], 16)]) if p in byte_pieces else p.replace(BLANK, " ").encode() for p in self.pieces]
        self.raw_column = pa.array(self.raw, pa.large_binary())
        self.byte_log_p = math.log(byte / total)
        self.log_p = np.array([math.log(weights[i] / total) if i in weights else self.byte_log_p for i in range(n)])
        ids = {self.pieces[i]: i for i in weights}
        state = {"": 0}
        for p in ids:
            for k in range(1, len(p) + 1):
                state.setdefault(p[:k], len(state))
        inner = [p for p in state if p]
        self.next = Pairs(np.array([state[p[:-1]] for p in inner]), np.array([ord(p[-1]) for p in inner]), np.array([state[p] for p in inner]))
        self.opening = np.full(0x110000, -1, dtype=np.int32)  # the states of one code point
        for p in inner:
            if len(p) == 1:
                self.opening[ord(p)] = state[p]
        self.ends = np.array([ids.get(p, -1) for p in state])
        # pieces may only hold blanks before other signs, so blanks split texts into chunks
        self.lattices: Lattices | None = None  # of the chunks met so far
        self.splits = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in ids)

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        text = b"".join([self.raw[i] for i in ids]).decode()
        return text[1:] if text.startswith(" ") else text


def vocabulary(path: str) -> Vocabulary:
    if path not in _STATE:
        _STATE[path] = Vocabulary(path)
    return _STATE[path]


class Lattices:
    """The lattices of chunks, kept over the parts of a worker's texts. A node is a suffix of chunks, whatever chunks end in it (what follows decides its completions);
    node 0 is the end of all.

    By node: first (edge), mass (its logarithm), length (code points), rest (the node of the suffix without its first sign), place (of the suffix in `text`). By edge, a node's edges together: dest,
    size (code points), id (of a piece, or -1 - code point), share (of the mass of the node's completions that take it), upto (the shares of the node up to it; above 1 for
    the last) and the logarithms of share and of the shares of the node's other edges, summed without it.
    """

    NODE = {"mass": np.float64, "length": np.int32, "rest": np.int32, "place": np.int32}
    EDGE = {"dest": np.int32, "id": np.int32, "size": np.int32, "share": np.float64, "upto": np.float64, "log_share": np.float64, "log_others": np.float64}

    def __init__(self, v: Vocabulary):
        self.v, self.nodes, self.edges, self.signs = v, 1, 0, 0
        self.full: tuple[int, int, int] | None = None  # what is kept: once they are full, later nodes stay for a part only
        self.passed = 0  # edges of such nodes
        for name, kind in (self.NODE | self.EDGE | {"first": np.int64, "text": np.uint32}).items():
            room = MOST_EDGES * 5 // 4 if name in self.EDGE else MOST_EDGES // 2
            setattr(self, name, np.empty(max(room, 2), dtype=kind))  # memory is taken where written
        self.first[:2], self.mass[0], self.length[0], self.rest[0], self.place[0] = 0, 0.0, 0, 0, 0
        self.keys, self.at_key = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int32)

    def roots(self, cp: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """The node of each chunk (chunks lie one after another), adding those that aren't there; None, and nothing added, if two contents have one hash."""
        if not len(starts):
            return np.zeros(0, dtype=np.int32)
        ends = starts + size
        at = np.arange(len(cp))
        left = np.repeat(ends, size) - at  # code points from here to the end of the chunk
        upto = np.zeros(len(cp) + 1, dtype=np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * tb.powers(tb.BASE, int(size.max()) + 1)[left], out=upto[1:])
        root = self._find(tb.mix(upto[ends] - upto[starts]))
        known = root > 0
        if (self.length[root[known]] != size[known]).any():
            return None
        at += np.repeat(np.where(known, self.place[root], 0) - starts, size)
        if (np.repeat(known, size) & (self.text.take(at, mode="clip") != cp)).any():
            return None
        if known.all():
            return root
        size = size[~known]
        place = spans(starts[~known], size)
        cp, left = cp[place], left[place]
        h = tb.mix(upto[place + left] - upto[place])
        node = self._find(h)
        new = np.flatnonzero(node == 0)
        h = h[new]
        order = np.argsort(h)
        kinds = h[order]
        opens = np.append(True, kinds[1:] != kinds[:-1])
        kind = np.empty(len(new), dtype=np.int64)
        kind[order] = np.cumsum(opens) - 1
        kinds, first = kinds[opens], new[order[opens]]
        order = np.argsort(left[first], kind="stable")
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(self.nodes, self.nodes + len(order))
        node[new] = number[kind]
        # suffixes are one node if their first signs and the nodes of what follows are
        rest = np.where(left > 1, np.append(node[1:], 0), 0).astype(np.int32)
        old, like = np.flatnonzero(node < self.nodes), first.take(kind)
        was = node.take(old)
        if (cp.take(new) != cp.take(like)).any() or (rest.take(new) != rest.take(like)).any():
            return None
        if (rest.take(old) != self.rest.take(was)).any() or (cp.take(old) != self.text.take(self.place.take(was))).any():
            return None
        self._add(cp, left, node, rest, first[order])
        if self.full is None:
            self._insert(kinds, number)
        root[~known] = node[starts_of(size)[:-1]]
        return root

    def next_part(self) -> Lattices:
        """The lattices for another part: these without what was for the last part only; new ones after a part of uncommon size, or when such nodes were many (other texts may have come)."""
        if max(self.edges, self.signs) > 2 * MOST_EDGES:
            return Lattices(self.v)
        if self.full is None:
            if self.edges > MOST_EDGES:
                self.full = self.nodes, self.edges, self.signs
            return self
        self.passed += self.edges - self.full[1]
        if self.passed > 8 * MOST_EDGES:
            return Lattices(self.v)
        self.nodes, self.edges, self.signs = self.full
        return self

    def apart(self, cp: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The node of each chunk, with nodes of its own for each; for contents whose hashes collide."""
        left = np.repeat(starts + size, size) - np.arange(len(cp))
        order = np.argsort(left, kind="stable")
        node = np.empty(len(cp), dtype=np.int32)
        node[order] = np.arange(self.nodes, self.nodes + len(cp))
        self._add(cp, left, node, np.where(left > 1, np.append(node[1:], 0), 0), order)
        return node[starts]

    def _room(self, names: dict, size: int) -> None:
        for name in names:
            have = getattr(self, name)
            if len(have) < size:
                more = np.empty(max(size, 2 * len(have)), dtype=have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        """The first slots of hashes, in their order, so that sorted ones are written one after another."""
        return (h >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The nodes of hashes, or 0: a table of open slots, one probe after another."""
        last = len(self.keys) - 1
        at, who = self._slot(h), np.arange(len(h))
        out = np.zeros(len(h), dtype=np.int32)
        while len(who):
            node = self.at_key.take(at)
            same = self.keys.take(at) == h.take(who)
            out[who] = np.where(same, node, 0)
            go = np.flatnonzero(~same & (node > 0))
            who, at = who.take(go), (at.take(go) + 1) & last
        return out

    def _insert(self, h: np.ndarray, node: np.ndarray) -> None:
        """Distinct hashes that aren't in the table."""
        if 2 * self.nodes > len(self.keys):
            some = self.at_key > 0
            h, node = np.concatenate([self.keys[some], h]), np.concatenate([self.at_key[some], node])
            slots = 1 << (2 * self.nodes).bit_length()
            self.keys, self.at_key = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int32)
        last = len(self.keys) - 1
        at = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.at_key.take(at) == 0)
            self.at_key[at.take(free)] = node.take(free)
            there = self.at_key.take(at) == node
            done, go = np.flatnonzero(there), np.flatnonzero(~there)
            self.keys[at.take(done)] = h.take(done)
            h, node, at = h.take(go), node.take(go), (at.take(go) + 1) & last

    def _add(self, cp: np.ndarray, left: np.ndarray, node: np.ndarray, rest: np.ndarray, at: np.ndarray) -> None:
        """New nodes, in their order, of the suffixes from the places `at` of cp, those with fewest code points first; node, rest: by place."""
        n, m, a = self.nodes, len(at), self.edges
        found, degree = self._pieces(self.v, cp, left, at), np.zeros(m, dtype=np.int64)
        for who, _, _ in found:
            degree[who] += 1
        first = a + starts_of(degree)
        b = int(first[-1])
        self._room(self.NODE, n + m)
        self._room({"first": 0}, n + m + 1)
        self._room(self.EDGE, b)
        self._room({"text": 0}, self.signs + len(cp))
        self.text[self.signs : self.signs + len(cp)] = cp
        self.first[n : n + m + 1], self.length[n : n + m], self.rest[n : n + m], self.place[n : n + m] = first, left[at], rest[at], self.signs + at
        log_p, fill = np.empty(b - a), first[:-1].copy()
        for who, length, ids in reversed(found):  # longer ones first
            e = fill[who]
            fill[who] += 1
            place = at.take(who)
            self.dest[e] = np.where(left.take(place) > length, node.take(place + length, mode="clip"), 0)
            self.size[e], self.id[e] = length, ids
            log_p[e - a] = self.v.log_p[np.maximum(ids, 0)] if length == 1 else self.v.log_p[ids]
            if length == 1:
                signs = ids < 0
                log_p[e[signs] - a] = self.v.byte_log_p * utf8_bytes(-1 - ids[signs])
        self.nodes, self.edges, self.signs = n + m, b, self.signs + len(cp)
        self._shares(log_p, degree, n, a)

    @staticmethod
    def _pieces(v: Vocabulary, cp: np.ndarray, left: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(numbers of the places, length, ids) of the edges from places by length: one walk down the tree of prefixes from all places at once."""
        left, state = left.take(at), v.opening.take(cp.take(at))
        ids = np.where(state >= 0, v.ends.take(state, mode="clip"), -1)
        alone = np.flatnonzero(ids < 0)
        ids[alone] = -1 - cp.take(at.take(alone)).astype(np.int64)
        out, length = [(np.arange(len(at)), 1, ids)], 1
        go = np.flatnonzero((state >= 0) & (left > 1))
        who, at, left, state = go, at.take(go), left.take(go), state.take(go)
        while len(who):
            length += 1
            r = v.next.rank(state, cp.take(at + (length - 1)))
            known = np.flatnonzero(r != NONE)
            who, at, left, state = who.take(known), at.take(known), left.take(known), v.next.merged.take(r.take(known))
            ids = v.ends.take(state)
            some = np.flatnonzero(ids >= 0)
            if len(some):
                out.append((who.take(some), length, ids.take(some)))
            go = np.flatnonzero(left > length)
            who, at, left, state = who.take(go), at.take(go), left.take(go), state.take(go)
        return out

    def _shares(self, log_p: np.ndarray, degree: np.ndarray, n: int, a: int) -> None:
        """Of the edges from a on, the nodes' from n on; a level of nodes with as many code points needs those with fewer only."""
        if not len(degree):
            return
        m, first = len(degree), self.first[n : n + len(degree)].astype(np.int64) - a
        length, mass, dest, share = self.length[n : n + m], self.mass, self.dest[a : a + len(log_p)], self.share[a : a + len(log_p)]
        level = [0, *(np.flatnonzero(length[1:] != length[:-1]) + 1).tolist(), m]
        stop = np.append(first, len(log_p))[level].tolist()
        for lo, hi, x, y in zip(level[:-1], level[1:], stop[:-1], stop[1:], strict=True):
            begin, own = first[lo:hi] - x, degree[lo:hi]
            value = log_p[x:y] + mass[dest[x:y]]
            top = np.maximum.reduceat(value, begin)
            value = np.exp(value - np.repeat(top, own))
            total = np.add.reduceat(value, begin)
            mass[n + lo : n + hi] = top + np.log(total)
            share[x:y] = value / np.repeat(total, own)
        heavy = share > 0.75  # one of a node's at most; 1 - share would lose digits there
        rest = np.add.reduceat(np.where(heavy, 0.0, share), first)
        with np.errstate(divide="ignore"):
            self.log_share[a : a + len(log_p)] = np.log(share)
            self.log_others[a : a + len(log_p)] = np.log(np.where(heavy, np.repeat(rest, degree), 1.0 - share))
        upto = share.copy()
        for j in range(1, int(degree.max())):
            e = first[np.flatnonzero(degree > j)] + j
            upto[e] += upto[e - 1]
        upto[np.append(first[1:], len(log_p)) - 1] = 2.0
        self.upto[a : a + len(log_p)] = upto

    def walk(self, node: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, their count by walk) of completions from each node, drawn in proportion to mass; place: of the node in its text, for the draws."""
        who, steps = np.arange(len(node)), []
        draw = seed + place.astype(np.uint64) * tb.BASE
        count = np.zeros(len(node), dtype=np.int64)
        while len(who):
            e = self.first.take(node)
            r = _unit(draw)
            more = np.flatnonzero(r >= self.upto.take(e))
            at, r = e.take(more), r.take(more)
            while len(more):
                at += 1
                e[more] = at
                up = np.flatnonzero(r >= self.upto.take(at))
                more, at, r = more.take(up), at.take(up), r.take(up)
            steps.append((who, e))
            count[who] = len(steps)
            node = self.dest.take(e)
            go = np.flatnonzero(node)
            who, node, draw = who.take(go), node.take(go), draw.take(go) + self.size.take(e.take(go)).astype(np.uint64) * tb.BASE
        begin = starts_of(count)
        edges = np.empty(int(begin[-1]), dtype=np.int64)
        for k, (w, e) in enumerate(steps):
            edges[begin.take(w) + k] = e
        return edges, count


def utf8_bytes(cp: np.ndarray) -> np.ndarray:
    """Bytes of code points in UTF-8 (a marked U+2581 has three, as its mark would)."""
    return 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Draws between 0 and 1, by the hash of a seed and a place."""
    return _unit(seed + place.astype(np.uint64) * tb.BASE)


def _unit(draw: np.ndarray) -> np.ndarray:
    r = tb.mix(draw)
    r >>= np.uint64(11)
    r = r.astype(np.float64)
    r += 0.5
    r *= 2.0**-53
    return r


def streams(seed: np.ndarray, number: int) -> np.ndarray:
    """The seeds of a numbered stream of draws."""
    return tb.mix(seed + np.uint64(number * int(tb.OTHER) % (1 << 64)))


class Part:
    """Texts, one after another, as the chunks of their marked code points. Its lattices hold until the vocabulary's next part."""

    def __init__(self, v: Vocabulary, offsets: np.ndarray, data: np.ndarray):
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4").copy()
        at = starts_of((data & 0xC0) != 0x80)[offsets]
        cp[cp == MARK] = LITERAL
        cp[cp == 0x20] = MARK
        some = np.diff(at) > 0
        cp = np.insert(cp, at[:-1][some], MARK)
        self.rows = at + starts_of(some)  # offsets of the texts in code points
        opens = np.zeros(len(cp) + 1, dtype=bool)
        opens[self.rows] = True
        if v.splits:
            opens[1:-1] |= (cp[1:] == MARK) & (cp[:-1] != MARK)
        self.starts = np.flatnonzero(opens[:-1])
        self.size = np.diff(np.append(self.starts, len(cp)))
        self.chunks = np.searchsorted(self.starts, self.rows)  # offsets of the texts in chunks
        v.lattices = v.lattices.next_part() if v.lattices else Lattices(v)
        self.lattices, root = v.lattices, v.lattices.roots(cp, self.starts, self.size)
        if root is None:
            self.lattices = Lattices(v)
            root = self.lattices.apart(cp, self.starts, self.size)
        self.root = root


def sample(part: Part, seeds: np.ndarray, k: int) -> tuple[list[list[tuple[float, float, np.ndarray]]], list[float]]:
    """By text: [(perturbed, log probability, edges)] of up to k distinct segmentations, best first, and the (k + 1)-th priority (-inf if there is none).

    An item of the agenda is (priority, log probability of the edges before, sample that has them, their count, edges split off there).
    """
    lat, n, none = part.lattices, len(seeds), np.zeros(0, dtype=np.int64)
    roots = -np.log(-np.log(uniform(streams(seeds, 0), np.zeros(n, dtype=np.int64))))
    agendas: list[list[tuple]] = [[(g, 0.0, 0, 0, ())] for g in roots.tolist()]
    done: list[list[tuple[float, float, np.ndarray]]] = [[] for _ in range(n)]
    threshold = [-math.inf] * n
    for turn in range(k + 1):
        live = [i for i in range(n) if agendas[i]]
        items = [agendas[i].pop(0) for i in live]
        if turn == k:
            for i, item in zip(live, items, strict=True):
                threshold[i] = item[0]
            break
        draws, gumbels = streams(seeds, 2 * turn + 1), streams(seeds, 2 * turn + 2)
        rows = np.array(live, dtype=np.int64)
        paths = [done[i][item[2]][2][: item[3]] if item[4] else none for i, item in zip(live, items, strict=True)]  # edges before
        place = part.rows[rows] + np.array([int(lat.size[path].sum()) for path in paths], dtype=np.int64)
        r = uniform(draws[rows], place - part.rows[rows]).tolist()
        pairs = [_another(lat, item[4], x) if item[4] else (-1, 0.0) for item, x in zip(items, r, strict=True)]
        picks, rests = np.array([pick for pick, _ in pairs], dtype=np.int64), [rest for _, rest in pairs]  # rest: share left of those split off
        kept = [path if pick < 0 else np.append(path, pick) for path, (pick, _) in zip(paths, pairs, strict=True)]
        place += np.where(picks < 0, 0, lat.size[picks])
        places, nodes = place, np.where(picks < 0, 0, lat.dest[picks]).astype(np.int64)  # nodes: of the walks that begin in a chunk
        chunk = np.where(place < part.rows[rows + 1], np.searchsorted(part.starts, place), part.chunks[rows + 1])  # from here on walked whole
        inner, whole = (nodes > 0).astype(np.int64), part.chunks[rows + 1] - chunk
        walks = inner + whole
        begin = starts_of(walks)
        node, place = np.empty(int(begin[-1]), dtype=np.int64), np.empty(int(begin[-1]), dtype=np.int64)
        some = inner > 0
        node[begin[:-1][some]], place[begin[:-1][some]] = nodes[some], places[some]
        to, of = spans(begin[:-1] + inner, whole), spans(chunk, whole)
        node[to], place[to] = part.root[of], part.starts[of]
        owner = np.repeat(rows, walks)
        edges, count = lat.walk(node, place - part.rows[owner], draws[owner])
        cuts = starts_of(count)[begin]
        tops, log_share = np.array([item[0] for item in items]), lat.log_share.take(edges)
        start = np.array([item[1] + (math.log(lat.share[before[-1]]) if len(before) else 0.0) for item, before in zip(items, kept, strict=True)])
        total = np.zeros(len(edges) + 1)  # summed by row, so that a row's sums don't depend on other rows
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            np.add.accumulate(log_share[a:b], out=total[a + 1 : b + 1])
        sums = (start + np.where(np.diff(cuts) > 0, total[cuts[1:]], 0.0)).tolist()
        total[cuts[:-1]] = 0.0
        log_p = np.repeat(start, np.diff(cuts)) + total[:-1]  # of what is before each edge
        steps = np.diff(cuts)
        size = lat.size.take(edges)
        ends = starts_of(size)
        lead = part.rows[rows + 1] - part.rows[rows] - ends[cuts[1:]]  # an edge's place in its text is this and `ends`
        g = priorities(np.repeat(tops, steps), log_p, lat.log_others.take(edges), np.repeat(gumbels[rows] + lead.astype(np.uint64) * tb.BASE, steps), ends[:-1])
        own = _own_steps(part, lat, items, kept, rests, places, rows, gumbels)
        room = k - turn  # the samples still wanted after these, and the threshold
        for x, (i, item, before) in enumerate(zip(live, items, kept, strict=True)):
            a, b = int(cuts[x]), int(cuts[x + 1])
            done[i].append((item[0], sums[x], np.concatenate([before, edges[a:b]])))
            agenda, at = agendas[i], len(before)
            if at:  # what is left of the item's own step
                agenda.append((own[x], item[1], turn, at - 1, (*item[4], int(before[-1]))))
            best = np.argpartition(g[a:b], b - a - room)[-room:] if b - a > room else np.arange(b - a)
            agenda += [(float(g[a + j]), float(log_p[a + j]), turn, at + j, (int(edges[a + j]),)) for j in best.tolist()]
            agenda[:] = sorted((item for item in agenda if item[0] > -math.inf), key=lambda item: -item[0])[:room]
    return done, threshold


def _another(lat: Lattices, without: tuple[int, ...], r: float) -> tuple[int, float]:
    """(an edge of the node of the edges `without` that isn't one of them, in proportion to mass; the shares of the node's other edges that aren't)."""
    node = int(lat.first[: lat.nodes + 1].searchsorted(without[0], side="right")) - 1
    left = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in without]
    shares = lat.share[left].tolist()
    r *= sum(shares)
    pick = len(left) - 1
    for j, share in enumerate(shares):
        r -= share
        if r < 0:
            pick = j
            break
    return left[pick], sum(s for j, s in enumerate(shares) if j != pick)


def _own_steps(part: Part, lat: Lattices, items: list[tuple], kept: list[np.ndarray], rests: list[float], places: np.ndarray, rows: np.ndarray, gumbels: np.ndarray) -> list[float]:
    """The priorities of what is left at the steps where expanded items leave their parents (unused for items without a parent)."""
    last = np.array([before[-1] if len(before) else -1 for before in kept], dtype=np.int64)
    if not len(last) or last.max() < 0:
        return [-math.inf] * len(last)
    here = places - part.rows[rows] - np.where(last < 0, 0, lat.size[last])
    with np.errstate(divide="ignore"):
        log_rest = np.log(np.array(rests))
    return priorities(np.array([item[0] for item in items]), np.array([item[1] for item in items]), log_rest, gumbels[rows], here).tolist()


def priorities(top: np.ndarray, log_p: np.ndarray, log_rest: np.ndarray, seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Gumbel variables of the masses exp(log_p + log_rest), truncated at top; -inf where nothing is left."""
    mass = log_p + log_rest
    # exp(-priority) is exp(-top) and an exponential variable of rate exp(mass)
    x = mass - top
    np.minimum(x, 700.0, out=x)
    np.exp(x, out=x)
    x -= np.log(uniform(seed, place))
    np.log(x, out=x)
    return np.subtract(mass, x, out=x)


def inclusion(log_p: float, threshold: float) -> float:
    """The probability that a segmentation's perturbed log probability lies above the threshold."""
    return 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, log_p - threshold)))


def piece_ids(v: Vocabulary, lat: Lattices, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count of each edge): one piece, or the bytes of a code point."""
    ids = lat.id.take(edges)
    signs = np.flatnonzero(ids < 0)
    count = np.ones(len(ids), dtype=np.int64)
    if not len(signs):
        return ids, count
    kinds, back = np.unique(ids[signs], return_inverse=True)
    raw = [(BLANK if s == -1 - LITERAL else chr(-1 - s)).encode() for s in kinds.tolist()]
    width = np.array([len(r) for r in raw], dtype=np.int64)
    own = width[back]
    count[signs] = own
    out = np.repeat(ids, count)
    of_byte = np.array([v.bytes[b] for b in range(256)], dtype=np.int32)
    out[spans(signs + starts_of(own - 1)[:-1], own)] = of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)][spans(starts_of(width)[back], own)]
    return out, count


ROWS = "sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>, ids_sha256 string, decoded boolean"


def segmentations(v: Vocabulary, keys: list[str], offsets: np.ndarray, data: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(row of each sample, the columns of ROWS) of texts that lie one after another; ids_sha256: of the ids as little-endian unsigned 32-bit numbers."""
    seeds = np.array([int.from_bytes(hashlib.sha256(f"{seed}|{key}".encode()).digest()[:8], "little") for key in keys], dtype=np.uint64)
    part = Part(v, offsets, data)
    done, threshold = sample(part, seeds, k)
    row = np.repeat(np.arange(len(keys)), [len(found) for found in done])
    flat = [s for found in done for s in found]
    lengths = np.array([len(path) for _, _, path in flat], dtype=np.int64)
    ids, count = piece_ids(v, part.lattices, np.concatenate([path for _, _, path in flat]) if flat else np.zeros(0, dtype=np.int64))
    cuts = starts_of(count)[starts_of(lengths)]
    back = v.raw_column.take(pa.array(ids))
    ends = np.frombuffer(back.buffers()[1], dtype=np.int64)[cuts].tolist() if len(ids) else cuts.tolist()
    back = back.buffers()[2].to_pybytes() if len(ids) else b""
    wide, bounds = memoryview(ids.astype("<u4").tobytes()), (4 * cuts).tolist()
    digests = [hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    raw, at = data.tobytes(), offsets.tolist()
    decoded = [back[ends[x] : ends[x + 1]] == (b" " + raw[at[i] : at[i + 1]] if at[i + 1] > at[i] else b"") for x, i in enumerate(row.tolist())]
    return row, [
        pa.array([n for found in done for n in range(1, len(found) + 1)], pa.int32()),
        pa.array(np.diff(cuts), pa.int64()),
        pa.array([p for _, p, _ in flat], pa.float64()),
        pa.array([g for g, _, _ in flat], pa.float64()),
        pa.array([inclusion(p, threshold[i]) for i, (_, p, _) in zip(row.tolist(), flat, strict=True)], pa.float64()),
        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
        pa.array(digests, pa.string()),
        pa.array(decoded, pa.bool_()),
    ]


def _encode(path: str, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("__key", "__text")]
            offsets, data = tb.utf8(batch.column("__text"))
            for lo, hi in tb.parts(offsets, PART_BYTES):
                some = batch.slice(lo, hi - lo)
                row, columns = segmentations(v, some.column("__key").to_pylist(), offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], k, seed)
                yield pa.RecordBatch.from_arrays([*(some.column(n).take(pa.array(row)) for n in names), *columns], [*names, *(c.split()[0] for c in ROWS.split(", "))])

    return tb.tidy(run)


def sampled(rows: DataFrame, key: list[str], text_col: str = "text", k: int = SAMPLES, seed: int = 0, model: str | None = None) -> DataFrame:
    """The key columns with up to k sampled segmentations each: columns of ROWS. A key column of such a name gets a trailing underscore."""
    ship(rows.sparkSession)
    named = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    names: list[str] = []
    for c in key:
        names.append(tb.fresh([*(r.split()[0] for r in ROWS.split(", ")), "__key", "__text", *names], c))
    source = rows.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), named.alias("__key"), F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c not in ("__key", "__text"))
    return source.mapInArrow(_encode(model or default_model(), k, seed), f"{schema}, {ROWS}")


def decode(samples: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """samples with the column `text` that their ids stand for."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    ship(samples.sparkSession)
    plain = samples.drop("text")
    return plain.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", text string")
