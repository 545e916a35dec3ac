"""Bounded search of the two-chain transition system, and transitive closures, by growing frontiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.columns_util import array_without
from evalloom.runtime import materialize


@dataclass(frozen=True)
class Bounds:
    transactions: int = 6
    channel: int = 12
    pending: int = 2


@dataclass(frozen=True)
class Profile:
    reordering: bool = True
    duplicates: bool = False
    reorg: bool = False
    finality_depth: int = 0


STATE = "rank bigint, pending array<bigint>, committed array<bigint>, delivered array<bigint>, actions array<string>, transactions int, channel int"


def start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, [], [], [], [], 0, 0)], STATE)


def successors(states: DataFrame, messages: list[int], bounds: Bounds, profile: Profile) -> DataFrame:
    """The next states in order: enqueues by message, deliveries by index, then a reorg of the latest message.

    A state's log is part of its identity, so different schedules never meet and levels need no de-duplication.
    """
    pending, committed, delivered = F.col("pending"), F.col("committed"), F.col("delivered")
    room = (F.col("transactions") < bounds.transactions) & (F.col("channel") < bounds.channel)
    moves: list[Column] = []

    def state(ok: Column, action: Column, p: Column, c: Column, d: Column, channel: int) -> Column:
        return F.when(ok, F.struct(p.alias("pending"), c.alias("committed"), d.alias("delivered"), F.array_append("actions", action).alias("actions"), (F.col("transactions") + 1).alias("transactions"), (F.col("channel") + channel).alias("channel")))

    for m in messages:
        one = F.lit(m).cast("bigint")
        ok = room & (F.size(pending) < bounds.pending)
        if not profile.duplicates:
            ok = ok & ~F.array_contains(committed, one)
        moves.append(state(ok, F.lit(f"enqueue {m}"), F.array_append(pending, one), F.array_append(committed, one), delivered, 1))
    for i in range(bounds.pending if profile.reordering else 1):
        got = F.try_element_at(pending, F.lit(i + 1))
        moves.append(state(room & (F.size(pending) > i), F.concat(F.lit("deliver "), got.cast("string")), array_without(pending, i), committed, F.array_append(delivered, got), 1))
    if profile.reorg:
        last = F.try_element_at(committed, F.lit(-1))
        ok = (F.col("transactions") < bounds.transactions) & (F.size(committed) > 0) & (F.lit(0) < profile.finality_depth) & F.array_contains(pending, last)
        at = F.size(pending) - F.array_position(F.reverse(pending), last).cast("int")
        kept = F.filter(F.transform(pending, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] != at)
        moves.append(state(ok, F.concat(F.lit("reorg "), last.cast("string")), F.transform(kept, lambda s: s["x"]), F.slice(committed, F.lit(1), F.greatest(F.size(committed) - 1, F.lit(0))), delivered, 0))
    wide = states.select(F.col("rank").alias("_p"), F.posexplode(F.array(*moves)).alias("_i", "_s")).where("_s IS NOT NULL")
    # ranks keep the order of breadth-first search: parent, then move
    return wide.select((F.col("_p") * len(moves) + F.col("_i")).alias("rank"), "_s.*")


def levels(spark: SparkSession, messages: list[int], bounds: Bounds, profile: Profile, violation: Column) -> DataFrame:
    """(depth, states, violations, witness) for each level of the whole bounded space; the witness is the first violating log in search order."""
    frontier, out = start(spark), None
    for depth in range(bounds.transactions + 1):
        bad = F.coalesce(violation, F.lit(False))
        row = frontier.agg(F.count("*").alias("states"), F.count_if(bad).alias("violations"), F.min_by(F.array_join("actions", ", "), F.when(bad, F.col("rank"))).alias("witness")).select(F.lit(depth).alias("depth"), "*")
        out = row if out is None else out.unionByName(row)
        if depth < bounds.transactions:
            frontier = materialize(successors(frontier, messages, bounds, profile), "frontier")
    return out.where("states > 0")


def search(spark: SparkSession, messages: list[int], bounds: Bounds, profile: Profile, violation: Column, max_states: int = 10_000) -> dict:
    """SAT with the first violating schedule, BOUNDED_UNSAT when the space is exhausted, UNKNOWN at the cap of states."""
    frontier, explored = start(spark), 0
    for _ in range(bounds.transactions + 1):
        bad = F.coalesce(violation, F.lit(False))
        row = frontier.agg(F.count("*").alias("n"), F.min(F.when(bad, F.col("rank"))).alias("rank"), F.min_by("actions", F.when(bad, F.col("rank"))).alias("actions")).first()
        before = frontier.where(F.col("rank") < row["rank"]).count() if row["rank"] is not None else row["n"]
        if explored + before >= max_states:
            return {"status": "UNKNOWN", "reason": "state_limit_exhausted", "explored_states": max_states, "witness": None}
        if row["rank"] is not None:
            return {"status": "SAT", "reason": None, "explored_states": explored + before + 1, "witness": row["actions"]}
        explored += row["n"]
        if not row["n"]:
            break
        frontier = materialize(successors(frontier, messages, bounds, profile), "frontier")
    return {"status": "BOUNDED_UNSAT", "reason": "finite_schedule_space_exhausted", "explored_states": explored, "witness": None}


def replay(witness: list[str], messages: list[int], bounds: Bounds, profile: Profile, spark: SparkSession) -> bool:
    """Whether each action of a witness is a legal move from the state before it."""
    state = start(spark)
    for n in range(len(witness)):
        state = successors(state, messages, bounds, profile).where(F.array_join("actions", ", ") == ", ".join(witness[: n + 1])).limit(1)
    return state.count() == 1


def closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst, hops) for all reachable pairs, with the least hops; each round joins only the new pairs, until there are none.

    Raises if pairs of more than max_rounds hops exist.
    """
    step = materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "closure_edges")
    new = step.withColumn("hops", F.lit(1))
    seen, n = new, 2
    while True:
        more = new.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = materialize(more.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(n)), "closure_new")
        if new.isEmpty():
            return seen
        if max_rounds is not None and n > max_rounds:
            raise ValueError(f"pairs are more than {max_rounds} hops apart")
        seen = seen.unionByName(new)
        if n % 16 == 0:  # else plans grow with the rounds
            seen = materialize(seen, "closure_seen")
        n += 1
