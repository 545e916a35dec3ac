"""Campaign archives: slot projections, reason ladders, strict matches, run reports and stage ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.columns import STAGE_ORDER


def candidate_inputs(archives: DataFrame) -> DataFrame:
    """A row for each slot with its position; slot ids default to attempt:slot:i, payloads of other statuses are nulled.

    archives: attempt_id, slots array<struct<slot_id, status, payload>>.
    """
    long = archives.select("attempt_id", F.posexplode("slots").alias("slot_index", "s"))
    return long.select("attempt_id", "slot_index", F.coalesce("s.slot_id", F.concat(F.col("attempt_id").cast("string"), F.lit(":slot:"), F.col("slot_index"))).alias("slot_id"), F.col("s.status").alias("status"), F.when(F.col("s.status") == "candidate", F.col("s.payload")).alias("payload"))


def first_reason(ladder: dict[str, Column]) -> Column:
    """The first reason whose condition holds, in the given order."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in ladder.items()))


def unknown_outcomes(queue: DataFrame, key: str, order: str) -> DataFrame:
    """Each queued campaign once, its first row, with endpoints that nothing has measured."""
    rest = [c for c in queue.columns if c != key]
    first = queue.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    none = {c: F.lit(None).cast("boolean") for c in ("detected", "useful_proposal", "claim_emitted", "correct_claim", "native_witness", "independent_replay")}
    return first.withColumns(none | {"availability": F.lit("unknown")})


def strict_match(rows: DataFrame, pair: list[str], arm: str, left: str, right: str) -> DataFrame:
    """Pairs with how many campaigns each arm has, and whether both have exactly one; one aggregation stands for the full outer join."""
    t = rows.where(F.col(arm).isin(left, right)).groupBy(*pair).agg(F.count_if(F.col(arm) == left).alias("n_left"), F.count_if(F.col(arm) == right).alias("n_right"))
    return t.select(*pair, "n_left", "n_right", ((F.col("n_left") == 1) & (F.col("n_right") == 1)).alias("matched"))


def run_report(runs: DataFrame, terminals: DataFrame, key: str) -> DataFrame:
    """Runs beside their terminal events: matched, status_differs or terminal_missing."""
    t = terminals.select(F.col(key).alias("_k"), F.col("status").alias("_s"))
    j = runs.join(t, F.col(key) == F.col("_k"), "left")
    return j.select(key, "status", F.when(F.col("_k").isNull(), "terminal_missing").when(F.col("_s") != F.col("status"), "status_differs").otherwise("matched").alias("check"))


def stage_ladder(raw: list[Column]) -> list[Column]:
    """Statuses of the stages in order: after the first that isn't passed, the others are not_applicable."""
    out, open_ = [], F.lit(True)
    for name, c in zip(STAGE_ORDER, raw, strict=True):
        out.append(F.when(open_, c).otherwise("not_applicable").alias(name))
        open_ = open_ & (c == "passed")
    return out


def verified(violation: Column, holds: Column, relevant: Column, passed: Column) -> Column:
    """violation, not holding and relevant; NULL unless all stages passed."""
    return F.when(passed, violation & ~holds & relevant)


def design_balance(rows: DataFrame, field: str, expected: dict[str, int]) -> DataFrame:
    """(value, expected, found) where a field's counts differ from the design."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), "value string, expected long")
    found = rows.groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("found"))
    j = want.join(found, "value", "full_outer").fillna(0, ["expected", "found"])
    return j.where("expected <> found")


def registry_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) where two registries lack a key or differ in a field."""
    r = right.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = left.join(r, F.col(key) == F.col("_k"), "full_outer")
    problems = [F.when(F.col("_k").isNull(), "only_in_left"), F.when(F.col(key).isNull(), "only_in_right")]
    both = F.col("_k").isNotNull() & F.col(key).isNotNull()
    problems += [F.when(both & ~F.col(f).eqNullSafe(F.col(f"_{f}")), f"differs:{f}") for f in fields]
    return j.select(F.coalesce(key, "_k").alias(key), F.explode(F.array_compact(F.array(*problems))).alias("problem"))
