"""Missing-aware endpoint aggregates: hierarchical means, false discovery, times, survival, prefix recall and stage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.columns import r9


def hierarchical_mean(rows: DataFrame, field: str | Column, by: list[str], inner: str = "instance_id", outer: str = "lineage_id") -> DataFrame:
    """Mean over rows in an instance, over instances in a lineage, over lineages; value with its denominators."""
    value = (F.col(field) if isinstance(field, str) else field).cast("double")
    rows = rows.select(*by, inner, outer, value.alias("_v"))
    # one shuffle level feeds the next: counts travel with the instance sums
    level = rows.groupBy(*by, outer, inner).agg(F.avg("_v").alias("_v"), F.count("*").alias("total"), F.count("_v").alias("known"))
    level = level.groupBy(*by, outer).agg(F.avg("_v").alias("_v"), F.sum("total").alias("total"), F.sum("known").alias("known"))
    out = level.groupBy(*by).agg(r9(F.avg("_v")).alias("value"), F.sum("known").alias("known"), F.sum("total").alias("total"))
    return out.select(*by, "value", "known", "total", (F.col("total") - F.col("known")).alias("missing"), F.when(F.col("value").isNull(), "no_known_measurements").alias("note"))


def false_discovery(rows: DataFrame, by: list[str]) -> DataFrame:
    """False claims among negatives' claims of known correctness."""
    claims = rows.where("ground_truth = 'negative'").withColumn("c", F.coalesce("claim_emitted", F.lit(False)))
    out = claims.groupBy(*by).agg(F.count_if("c").alias("total"), F.count_if(F.col("c") & F.col("correct_claim").isNotNull()).alias("known"), F.count_if(F.col("c") & ~F.col("correct_claim")).alias("wrong"))
    return out.select(*by, r9(F.try_divide("wrong", "known")).alias("value"), "known", "total", (F.col("total") - F.col("known")).alias("missing"), F.when(F.col("total") == 0, "precision_NA_no_claims").alias("note"))


def restricted_time(rows: DataFrame, field: str, by: list[str]) -> DataFrame:
    """Restricted mean times over positives: of all, of the available, and the available share."""
    pos = rows.where("ground_truth = 'positive'")
    score = F.least(F.coalesce(F.col(field), F.col("horizon_seconds")), F.col("horizon_seconds"))
    whole = hierarchical_mean(pos, score, by).select(*by, F.col("value").alias("restricted"))
    able = hierarchical_mean(pos.where("availability = 'available'"), score, by).select(*by, F.col("value").alias("conditioned"))
    share = pos.groupBy(*by).agg(r9(F.count_if(F.col("availability") == "available") / F.count("*")).alias("intention_to_run"), F.count("*").alias("total"), F.count_if(F.col(field).isNull()).alias("missing"))
    return share.join(whole, by).join(able, by, "left").select(*by, "restricted", "conditioned", "intention_to_run", "total", "missing")


def kaplan_meier(rows: DataFrame, field: str, by: list[str]) -> DataFrame:
    """Every distinct observed time with its risk set, events and survival; events need a time within the horizon of an available run."""
    pos = rows.where("ground_truth = 'positive'")
    h, t = F.col("horizon_seconds"), F.col(field)
    table = pos.groupBy(*by, F.least(F.coalesce(t, h), h).alias("time")).agg(F.count("*").alias("n"), F.count_if(t.isNotNull() & (F.col("availability") == "available") & (t <= h)).alias("events"))
    table = table.withColumn("at_risk", F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("time"))))
    alive = F.product(1 - F.col("events") / F.col("at_risk")).over(Window.partitionBy(*by).orderBy("time"))
    return table.select(*by, "time", "at_risk", "events", r9(alive).alias("survival"))


def denominators(rows: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """total, known, missing and positive by field, and the counts of availability under `availability:...`."""
    long = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields))))
    out = long.groupBy(*by, "field").agg(F.count("*").alias("total"), F.count("v").alias("known"), F.count_if(F.col("v")).alias("positive"))
    hist = rows.groupBy(*by, F.concat(F.lit("availability:"), F.col("availability")).alias("field")).agg(F.count("*").alias("total")).select("*", F.col("total").alias("known"), F.col("total").alias("positive"))
    return out.unionByName(hist).select(*by, "field", "total", "known", (F.col("total") - F.col("known")).alias("missing"), "positive")


def prefix_recall(hits: DataFrame, by: list[str], truth: str = "positive") -> DataFrame:
    """Hits over available campaigns of one truth, by prefix."""
    t = hits.where(F.col("ground_truth") == truth).groupBy(*by, "prefix").agg(
        F.count_if((F.col("availability") == "available") & F.col("hit")).alias("hits"), F.count_if(F.col("availability") == "available").alias("known"), F.count("*").alias("total")
    )
    return t.select(*by, "prefix", r9(F.try_divide("hits", "known")).alias("value"), "hits", "known", "total", (F.col("total") - F.col("known")).alias("missing"), F.when(F.col("known") == 0, "no_known_measurements").alias("note"))


def verification_fdp(hits: DataFrame, by: list[str], prefix: int) -> DataFrame:
    """False alerts over alerts of available decided campaigns; known counts alerts, total campaigns."""
    able = F.col("availability") == "available"
    alert = able & F.col("hit") & F.col("ground_truth").isin("positive", "negative")
    t = hits.where(F.col("prefix") == prefix).groupBy(*by).agg(
        F.count_if(alert & (F.col("ground_truth") == "negative")).alias("wrong"), F.count_if(alert).alias("known"), F.count("*").alias("total"), F.count_if(~able | (F.col("ground_truth") == "unresolved")).alias("missing")
    )
    return t.select(*by, r9(F.try_divide("wrong", "known")).alias("value"), "known", "total", "missing", F.when(F.col("known") == 0, "precision_NA_no_claims").alias("note"))


def stage_counts(stages: DataFrame, campaigns: DataFrame, by: list[str]) -> DataFrame:
    """Counts by stage and status, with the pseudo-stage `campaign`."""
    a = stages.groupBy(*by, "stage", "status").agg(F.count("*").alias("n"))
    b = campaigns.groupBy(*by, F.lit("campaign").alias("stage"), F.col("availability").alias("status")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


def scoped_counts(stages: DataFrame, dims: list[str], prefixes: tuple[int, ...]) -> DataFrame:
    """Stage counts within each prefix, for each dimension on its own."""
    # counted once by all dimensions before rows are repeated for scopes and prefixes
    base = stages.groupBy(*dims, "slot_index", "stage", "status").agg(F.count("*").alias("n"))
    wide = base.select("*", F.explode(F.filter(F.array(*map(F.lit, prefixes)), lambda p: p > F.col("slot_index"))).alias("prefix"))
    long = wide.select("prefix", "stage", "status", "n", F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("scope")) for d in dims))))
    return long.groupBy("dimension", "scope", "prefix", "stage", "status").agg(F.sum("n").alias("n"))


def proposal_recall(batches: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """Batches whose first N proposals meet the gold set; missing ones stay in the total."""
    b = batches.select("*", F.explode(F.array(*map(F.lit, prefixes))).alias("prefix"))
    hit = F.arrays_overlap(F.slice("ordered", F.lit(1), F.col("prefix")), F.col("gold"))
    t = b.groupBy("prefix").agg(F.count_if((F.col("availability") == "available") & hit).alias("hits"), F.count_if(F.col("availability") == "available").alias("known"), F.count("*").alias("total"))
    return t.select("prefix", r9(F.try_divide("hits", "known")).alias("value"), "hits", "known", "total", (F.col("total") - F.col("known")).alias("missing"))


def budget_recall(rows: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """Detection by scheduled budget; a row of another budget fails the query."""
    wrong = ~F.col("budget_n").isin(list(budgets))
    rows = rows.withColumn("budget_n", F.when(wrong, F.raise_error(F.lit("a row has an unplanned budget")).cast("int")).otherwise(F.col("budget_n")))
    able = (F.col("availability") == "available") & F.col("detected").isNotNull()
    t = rows.groupBy("budget_n").agg(F.count("*").alias("total"), F.count_if(able).alias("known"), F.count_if(able & F.col("detected")).alias("hits"))
    want = rows.sparkSession.createDataFrame([(b,) for b in budgets], "budget_n int")
    j = want.join(t, "budget_n", "left").fillna(0, ["total", "known", "hits"])
    note = F.when(F.col("total") == 0, "no_scheduled_observations").when(F.col("known") == 0, "no_known_measurements")
    return j.select("budget_n", r9(F.try_divide("hits", "known")).alias("value"), "hits", "known", "total", (F.col("total") - F.col("known")).alias("missing"), note.alias("note"))


def bridge(facts: DataFrame, slots: DataFrame, stages: DataFrame, prefix: int, horizon: float) -> DataFrame:
    """Verification campaigns as flat analysis rows at a prefix."""
    within = slots.where(F.col("slot_index") < prefix)
    seen = within.groupBy("l_orderkey").agg(
        F.bool_or("verified_finding").alias("hit"), F.bool_or(F.col("grounding") == "passed").alias("useful"), F.bool_or(F.col("witness_check") == "passed").alias("witness"), F.bool_or(F.col("independent_replay") == "passed").alias("replay"),
        F.min_by(F.struct(F.col("elapsed").alias("t")), F.when(F.col("verified_finding"), F.col("slot_index")))["t"].alias("claim_time"),
    )
    why = stages.where((F.col("slot_index") < prefix) & ~F.col("status").isin("passed", "not_applicable")).groupBy("l_orderkey").agg(F.min_by(F.concat_ws(":", "stage", "status"), F.struct("slot_index", "stage_index")).alias("first_failure"))
    rows = facts.join(seen, F.col("key") == F.col("l_orderkey"), "left").drop("l_orderkey").join(why, F.col("key") == F.col("l_orderkey"), "left")
    able = F.col("availability") == "available"
    flag = lambda c: F.when(able, F.coalesce(F.col(c), F.lit(False)))
    hit = flag("hit")
    return rows.select(
        "campaign_id", "arm", "ground_truth", "availability", hit.alias("detected"), flag("useful").alias("useful_proposal"), flag("witness").alias("native_witness"), flag("replay").alias("independent_replay"),
        F.when(hit, F.col("ground_truth") == "positive").alias("correct_claim"), r9(F.when(hit, F.col("claim_time"))).alias("claim_time_seconds"), F.lit(horizon).alias("horizon_seconds"), "first_failure",
    )
