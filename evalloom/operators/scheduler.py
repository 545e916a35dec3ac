"""Replay of a resource scheduler over ordered request logs: first in, first out, with head-of-line blocking."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "worker long, seq long, request long, decision string, running int, waiting int"


def replay(log: DataFrame, slots: int, most_waiting: int) -> DataFrame:
    """The decision on each request and release of a worker's log, in order of seq.

    log: worker, seq, request, event (request or release). A worker's log streams through one group in sorted order; state is the queue alone.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        running: set[int] = set()
        waiting: deque[int] = deque()
        out = []
        for seq, request, event in zip(*(frame.sort_values("seq")[c] for c in ("seq", "request", "event")), strict=True):
            if event == "request":
                if len(running) < slots and not waiting:
                    running.add(request)
                    decision = "admitted"
                elif len(waiting) < most_waiting:
                    waiting.append(request)
                    decision = "queued"
                else:
                    decision = "rejected"
            elif request in running:
                running.remove(request)
                decision = "released"
                while waiting and len(running) < slots:
                    running.add(waiting.popleft())
            else:
                decision = "unknown_release"
            out.append((key[0], seq, request, decision, len(running), len(waiting)))
        return pd.DataFrame(out, columns=["worker", "seq", "request", "decision", "running", "waiting"])

    return log.groupBy("worker").applyInPandas(run, SCHEMA)


def opcodes(code: str) -> list[str]:
    """The distinct opcodes of byte code in hex, immediates of PUSH skipped, sorted."""
    raw, at, seen = bytes.fromhex(code.removeprefix("0x")), 0, set()
    while at < len(raw):
        seen.add(raw[at])
        at += 1 + (raw[at] - 0x5F if 0x60 <= raw[at] <= 0x7F else 0)
    return [f"{c:02x}" for c in sorted(seen)]
