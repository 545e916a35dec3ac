"""Gates before a launch: preflight panels, blockers, guards, resume and version policies, timing summaries and power tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.columns import measured, poisoned_sum, r9

# What interrupted an attempt, and what follows.
RESUME = {"worker_restart": "resume_same_attempt", "lost_response": "resume_same_attempt", "provider_outage": "resume_same_attempt", "version_drift": "block"}


def preflight(results: DataFrame, families: list[str], key: str, checks: list[str]) -> DataFrame:
    """A row for each expected family: passed when all checks hold in all its rows, failed when one doesn't or the family is missing."""
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    found = results.groupBy(F.col(key).alias("_k")).agg(F.bool_and(ok).alias("_ok"), F.count("*").alias("rows"))
    want = results.sparkSession.createDataFrame([(f,) for f in families], "family string")
    j = want.join(found, F.col("family") == F.col("_k").cast("string"), "left")
    return j.select("family", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok"), "passed").otherwise("failed").alias("status"))


def blockers(rows: DataFrame, key: str, evidence: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, blocker) for each kind of evidence that a row lacks: one left join of flags for each kind."""
    out = rows.select(key)
    for name, (df, k) in evidence.items():
        out = out.join(df.select(F.col(k).alias(key)).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    missing = F.array_compact(F.array(*(F.when(F.col(f"_{n}").isNull(), F.lit(f"{n}_missing")) for n in evidence)))
    return out.select(key, F.explode(missing).alias("blocker"))


def launch_guard(requested: DataFrame, plan: DataFrame, key: str, gates: dict[str, bool | None]) -> DataFrame:
    """One row: how many requested campaigns aren't planned, the gates that don't pass, and whether a launch is allowed."""
    stray = requested.join(plan, key, "left_anti").agg(F.count("*").alias("unplanned"))
    bad = sorted(k for k, v in gates.items() if v is not True)
    return stray.select("unplanned", F.lit(",".join(bad)).alias("closed_gates"), ((F.col("unplanned") == 0) & F.lit(not bad)).alias("allowed"))


def resume_policy(interrupted: DataFrame, kind: Column, version: Column, current: str) -> DataFrame:
    """What follows an interruption; another version than the current one is version drift, whatever the kind, and an unknown kind fails the query."""
    policy = F.create_map(*(F.lit(x) for kv in RESUME.items() for x in kv))
    seen = F.when(version.eqNullSafe(F.lit(current)), kind).otherwise("version_drift")
    unknown = F.raise_error(F.concat(F.lit("unknown interruption: "), F.coalesce(seen, F.lit("none")))).cast("string")
    return interrupted.withColumn("action", F.coalesce(F.try_element_at(policy, seen), unknown))


def timing_summary(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """value, known, total and missing by field; negative or non-finite values count as missing, and poison the sum."""
    long = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), measured(F.col(f)).alias("v")) for f in fields))))
    t = long.groupBy(*by, "field").agg(F.round(poisoned_sum(F.col("v")), 6).alias("value"), F.count("v").alias("known"), F.count("*").alias("total"))
    return t.select("*", (F.col("total") - F.col("known")).alias("missing"))


def benchmark_rows(spark: SparkSession, lineages: list[str], mutations: list[str]) -> DataFrame:
    """lineages x mutations x {mutant, control}, with hashed ids and each row's pair."""
    ident = lambda kind: F.substring(F.sha2(F.concat_ws("|", "lineage_id", "mutation", kind), 256), 1, 16)
    base = spark.createDataFrame([(x,) for x in lineages], "lineage_id string").select("lineage_id", F.explode(F.array(*map(F.lit, mutations))).alias("mutation")).select("*", F.explode(F.array(F.lit("mutant"), F.lit("control"))).alias("kind"))
    other = F.when(F.col("kind") == "mutant", "control").otherwise("mutant")
    return base.select(ident(F.col("kind")).alias("instance_id"), "lineage_id", "mutation", "kind", ident(other).alias("paired_instance_id"))


def binomial_power(n: int, p: float, least: int) -> float:
    """The probability of at least `least` successes in n."""
    return math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def power_table(spark: SparkSession, sizes: list[int], rates: list[float], share: float) -> DataFrame:
    """(n, rate, least, power): the chance that at least a share of n succeeds; natively, by a running product of terms."""
    grid = spark.createDataFrame([(n, r, math.ceil(share * n)) for n in sizes for r in rates], "n int, rate double, least int")
    # log C(n, k) is a sum of logs; the terms of a cell fold in one array
    log_choose = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("k"), F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(j <= F.col("k"), F.log((F.col("n") - j + 1) / j)).otherwise(0.0))
    terms = grid.select("*", F.explode(F.sequence("least", "n")).alias("k")).withColumn("t", F.exp(log_choose + F.col("k") * F.log("rate") + (F.col("n") - F.col("k")) * F.log(1 - F.col("rate"))))
    return terms.groupBy("n", "rate", "least").agg(r9(F.least(F.lit(1.0), F.sum("t"))).alias("power"))
