"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a template marks turns and a loss mask.

A record's layout is the set of its nested field paths; its fingerprint is the SHA-256 of the sorted paths. LAYOUTS declares, by paths, where each
layout keeps its turns; optional fields give a fingerprint for each subset. Records of no known layout give no turns but an error row.

Turns of a conversation are ordered by turn number (null first), then role, then text. The output is a row for each formatted turn, with the span
of its loss mask in code points of the whole conversation; formatting and reading stream over sorted partitions and never hold a conversation.
In texts a backslash doubles and the `<` of a control string becomes `\\l`; roles escape `>` and line feeds, too. Defined results: null text and null role are
empty; rows of a null conversation id form one conversation; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.runtime import ship

# Layouts: required paths, optional paths, and the turns: either one list ("each") with its role and text fields, or fixed (role, field or fields joined by a blank line).
# Role names are translated by ROLES.
LAYOUTS = {
    "turn row": {"paths": ["conv_id", "turn", "role", "text"], "row": ("role", "text")},
    "messages": {"paths": ["messages[].role", "messages[].content"], "optional": ["id"], "each": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "optional": ["id", "system"], "first": ("system", "system"), "each": ("conversations", "from", "value")},
    "prompt": {"paths": ["prompt"], "optional": ["completion", "system", "id"], "fixed": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "response": {"paths": ["prompt", "response"], "optional": ["system", "id"], "fixed": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction": {"paths": ["instruction", "output"], "optional": ["input", "system", "id"], "fixed": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question": {"paths": ["question", "answer"], "optional": ["context", "id"], "fixed": [("user", ["context", "question"]), ("assistant", ["answer"])]},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; list steps are []."""
    if isinstance(value, dict):
        return set(chain.from_iterable(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) or {at}
    if isinstance(value, list):
        return set(chain.from_iterable(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(of: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode()).hexdigest()


def registry(layouts: dict = LAYOUTS) -> dict[str, tuple[str, dict]]:
    """Fingerprint to (name, layout), for each subset of the optional paths."""
    out: dict[str, tuple[str, dict]] = {}
    for name, layout in layouts.items():
        more = layout.get("optional", [])
        for some in chain.from_iterable(combinations(more, n) for n in range(len(more) + 1)):
            out.setdefault(fingerprint([*layout["paths"], *some]), (name, layout))
    return out


def turns_of(record: dict, layout: dict) -> list[tuple[str, str]]:
    """(role, text) of a record of a known layout; absent optional turns are left out, null texts are empty."""
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    role = lambda v: ROLES.get(text(v), text(v))
    if "row" in layout:
        return [(text(record.get(layout["row"][0])), text(record.get(layout["row"][1])))]
    out = []
    if "first" in layout and layout["first"][1] in record:
        out.append((layout["first"][0], text(record[layout["first"][1]])))
    if "each" in layout:
        where, who, what = layout["each"]
        return out + [(role(m.get(who)), text(m.get(what))) for m in record[where]]
    for who, fields in layout["fixed"]:
        if any(f in record for f in fields):
            out.append((who, "\n\n".join(text(record[f]) for f in fields if text(record.get(f)))))
    return out


TURNS = "conv_id long, turn long, part int, role string, text string, layout string, fingerprint string"


def _canonical(layouts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = registry(layouts), {}
        for batch in batches:
            rows = []
            for conv, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
                try:
                    record = json.loads(raw)
                    found = frozenset(paths(record))
                except (TypeError, ValueError):
                    record, found = None, frozenset()
                if found not in seen:
                    seen[found] = fingerprint(found)
                print_ = seen[found]
                name, layout = known.get(print_, (None, None))
                turns = turns_of(record, layout) if layout else [(None, None)]
                rows += [(conv, turn, i, role, text, name, print_) for i, (role, text) in enumerate(turns)]
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in TURNS.split(", ")])

    return run


def canonical_turns(records: DataFrame, layouts: dict = LAYOUTS) -> DataFrame:
    """Columns of TURNS from (conv_id, turn, record as JSON); a record of no known layout gives one row without a layout."""
    ship(records.sparkSession)
    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("record").cast("string").alias("record")).mapInArrow(_canonical(layouts), TURNS)


def escape(text: str) -> str:
    return re.sub(r"\\|<(?=/?turn)", lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">", "n": "\n"}.get(m[1], m[1]), text)


SEGMENTS = "conv_id long, segment long, formatted string, loss_from long, loss_to long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, number, at = object(), 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                now, number, at = conv, 0, 0
            head, body = f"<turn {escape_role(role or '')}>\n", escape(text or "")
            loss = (at + len(head), at + len(head) + len(body)) if role == "assistant" else (None, None)
            segment = f"{head}{body}</turn>\n"
            rows.append((conv, number, segment, *loss))
            number, at = number + 1, at + len(segment)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in SEGMENTS.split(", ")])


def format_turns(turns: DataFrame) -> DataFrame:
    """Columns of SEGMENTS, partitions sorted by conversation; the segments of a conversation in order are its formatted text."""
    known = turns.where("layout IS NOT NULL").select("conv_id", "turn", "part", "role", "text")
    return known.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text").mapInArrow(_format, SEGMENTS)


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
SEGMENT = re.compile(r"<turn ([^>\n]*)>\n(.*)</turn>\n", re.DOTALL)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_, state = False, []
    done: list[tuple] = []

    def close() -> None:
        conv, n, turns, chars, loss, at = state
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), at))

    def out() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], [c.split()[0] for c in RESULT.split(", ")])

    for batch in batches:
        for conv, number, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "formatted", "loss_from", "loss_to")), strict=True):
            if number == 0:
                if open_:
                    close()
                open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            m = SEGMENT.fullmatch(text)
            state[1] += 1
            state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if lo is not None:
                under = unescape(text[lo - state[5] : hi - state[5]])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(text)
        yield out()
        done.clear()
    if open_:
        close()
        yield out()


def read_back(segments: DataFrame) -> DataFrame:
    """Columns of RESULT for each conversation, parsed from sorted segments."""
    return segments.mapInArrow(_read, RESULT)
