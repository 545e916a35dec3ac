"""Batch validation and folding of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.columns import poisoned_sum, r9

# The moves of an attempt: (state, event) to state.
MOVES = {("planned", "start"): "running", ("running", "uncertain"): "uncertain", ("uncertain", "start"): "running", ("running", "terminal"): "terminal", ("uncertain", "terminal"): "terminal"}


def validate_log(log: DataFrame) -> DataFrame:
    """The log with a flag for each rule that a row breaks; the last known time moves even after a regression."""
    w = Window.partitionBy("attempt_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("monotonic_seconds", ignorenulls=True).over(before)
    ended = F.coalesce(F.max(F.col("terminal").cast("int")).over(before), F.lit(0)) > 0
    # duplicates are looked for by count, so no id gathers its rows in order
    twice = F.count("*").over(Window.partitionBy("seq")) > 1
    return log.select(
        "attempt_id", "seq", twice.alias("duplicate_id"), F.coalesce(F.col("monotonic_seconds") < last, F.lit(False)).alias("time_regression"), (F.coalesce(F.col("value"), F.lit(0.0)) < 0).alias("negative_duration"),
        (ended & ~F.col("terminal")).alias("event_after_terminal"), (ended & F.col("terminal")).alias("duplicate_terminal"),
    )


def fold_attempts(log: DataFrame) -> DataFrame:
    """The state of each attempt after its events in order, illegal moves counted and skipped; open attempts need recovery."""
    start = F.struct(F.lit("planned").alias("state"), F.lit(0).alias("moves"), F.lit(0).alias("illegal"))

    def step(s, e):
        to = F.lit(None).cast("string")
        for (state, event), target in MOVES.items():
            to = F.when((s["state"] == state) & (e["event"] == event), target).otherwise(to)
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["moves"] + to.isNotNull().cast("int")).alias("moves"), (s["illegal"] + to.isNull().cast("int")).alias("illegal"))

    folded = log.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("e"), F.count("*").alias("events")).withColumn("s", F.aggregate("e", start, step))
    return folded.select("attempt_id", "events", F.col("s.state").alias("state"), F.col("s.moves").alias("moves"), F.col("s.illegal").alias("illegal"), F.when(F.col("s.state") == "running", "recover_uncertain").when(F.col("s.state") == "terminal", "none").otherwise("resume").alias("recovery"))


def method_events(slots: DataFrame) -> DataFrame:
    """start, a response and a slot event for each slot, completed, in one ordered stream for each run."""
    runs = slots.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    ends = runs.select("l_orderkey", F.inline(F.array(F.struct(F.lit(0).alias("seq"), F.lit("start").alias("event")), F.struct((2 * F.col("n") + 1).cast("int").alias("seq"), F.lit("completed").alias("event")))))
    inner = slots.select("l_orderkey", F.inline(F.array(F.struct((2 * F.col("slot_index") + 1).cast("int").alias("seq"), F.lit("response").alias("event")), F.struct((2 * F.col("slot_index") + 2).cast("int").alias("seq"), F.lit("slot").alias("event")))))
    return ends.unionByName(inner)


def telemetry(log: DataFrame, by: str) -> DataFrame:
    """Sums, peaks and optional sums by phase; an optional sum is NULL if any input is missing or none exists."""
    t = log.groupBy(by).agg(F.count("*").alias("n"), r9(F.sum("cpu")).alias("cpu"), r9(F.max("memory")).alias("memory_peak"), r9(poisoned_sum(F.col("tokens"), empty_is_zero=False)).alias("tokens"))
    return t


def foreign_keys(children: dict[str, tuple[DataFrame, str]], parents: dict[str, tuple[DataFrame, str]], links: dict[str, str]) -> DataFrame:
    """Orphans (child, id): references that no parent has; NULL references are fine."""
    out = None
    for child, parent in links.items():
        (c, ck), (p, pk) = children[child], parents[parent]
        bad = c.select(F.col(ck).cast("string").alias("id")).where("id IS NOT NULL").join(p.select(F.col(pk).cast("string").alias("id")), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), "id", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


def within(log: DataFrame, predicate, horizon: int):
    """once(horizon): whether the predicate held now or in the last `horizon` positions; globally: whether it holds all along."""
    w = Window.partitionBy("attempt_id").orderBy("seq")
    once = F.max(predicate.cast("int")).over(w.rowsBetween(-horizon, 0)) > 0
    always = F.min(predicate.cast("int")).over(Window.partitionBy("attempt_id")) > 0
    return log.select("attempt_id", "seq", once.alias("once"), always.alias("globally"))
