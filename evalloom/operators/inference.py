"""Exact tests, step-down correction, resampling with portable draws, and leave-one-out means."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.columns import draw_index, draw_uniform, r9


UNITS = 1e9  # of effects in exact sums


def sign_test(effects: DataFrame, by: list[str], effect: str = "effect") -> DataFrame:
    """wins, losses, ties, n and the exact two-sided p by group: twice the smaller binomial tail, summed by running ratios of its terms."""
    t = effects.groupBy(*by).agg(F.count_if(F.col(effect) > 0).alias("wins"), F.count_if(F.col(effect) < 0).alias("losses"), F.count_if(F.col(effect) == 0).alias("ties"))
    n, low = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    # logarithms, as 2^-n is no double for large n; the state holds log C(n, k) and the sum so far
    first = F.struct(F.lit(0.0).alias("c"), F.exp(-n * math.log(2)).alias("s"))
    step = lambda a, k: F.struct((a["c"] + F.log((n - k + 1) / k)).alias("c"), (a["s"] + F.exp(a["c"] + F.log((n - k + 1) / k) - n * math.log(2))).alias("s"))
    terms = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, first, step, lambda a: a["s"])
    return t.select(*by, "wins", "losses", "ties", n.alias("n"), r9(F.when(n > 0, F.least(F.lit(1.0), 2 * tail))).alias("p"))


def holm(tests: DataFrame, key: str, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Holm's step-down adjustment; tests without p stay out of the family, a p outside [0, 1] fails the query. A family is ranked in one task: it is a list of contrasts."""
    by = by or []
    outside = F.raise_error(F.lit("a p-value lies outside [0, 1]")).cast("double")
    tests = tests.withColumn(p, F.when(F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1), outside).otherwise(F.col(p)))
    known = tests.where(F.col(p).isNotNull())
    order = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    ranked = known.withColumn("_s", step)
    adjusted = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    done = ranked.select(*by, key, r9(adjusted).alias("adjusted"))
    return tests.join(done, [*by, key], "left")


def bootstrap(effects: DataFrame, by: list[str], seed: int, draws: int, confidence: float, effect: str = "effect", order: str = "lineage_id") -> DataFrame:
    """Percentile intervals of the mean under resampling with replacement, by md5 draws.

    A group's effects are one array (effects are of lineages, so it is small); each draw folds it in its own row, and draws are spread over the tasks. Sums are of
    whole billionths, so they don't depend on their order.
    """
    units = F.round(F.col(effect) * UNITS).cast("long")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), units.alias("v")))), lambda x: x["v"])
    arrays = effects.groupBy(*by).agg(ordered.alias("a"), F.count("*").alias("n"))
    drawn = arrays.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(*by, "draw")
    total = F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(0).cast("long"), lambda s, k: s + F.element_at("a", (draw_index(seed, F.col("draw"), k, F.col("n")) + 1).cast("int")))
    means = drawn.select(*by, (total.cast("double") / F.col("n") / UNITS).alias("mean"))
    low = (1 - confidence) / 2
    point = effects.groupBy(*by).agg((F.sum(units).cast("double") / F.count("*") / UNITS).alias("point"))
    ci = means.groupBy(*by).agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(1 - low)).alias("high"))
    return point.join(ci, by).select(*by, r9("point").alias("point"), r9("low").alias("low"), r9("high").alias("high"))


def cluster_bootstrap(items: DataFrame, cluster: str, value: str, seed: int, draws: int, confidence: float) -> DataFrame:
    """Percentile interval of a mean when whole clusters are resampled; clusters enter as their sums and counts, one array that each draw folds in its own row."""
    sums = items.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").cast("double").alias("c"))
    arr = sums.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster), "s", "c"))).alias("a"))
    drawn = arr.withColumn("n", F.size("a")).where("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition("draw")
    pick = lambda k: F.element_at("a", (draw_index(seed, F.col("draw"), k, F.col("n")) + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), lambda t, k: F.struct((t["s"] + pick(k)["s"]).alias("s"), (t["c"] + pick(k)["c"]).alias("c")), lambda t: t["s"] / t["c"])
    low = (1 - confidence) / 2
    return drawn.select(total.alias("m")).agg(F.count("*").alias("draws"), r9(F.percentile("m", F.lit(low))).alias("low"), r9(F.percentile("m", F.lit(1 - low))).alias("high"))


def leave_one_out(effects: DataFrame, by: list[str], key: str, effect: str = "effect") -> DataFrame:
    """The mean of the others for each key; NULL for a single key. Effects count to nine digits, as whole numbers, so that sums don't depend on their order."""
    units = F.round(F.col(effect) * UNITS).cast("long")
    totals = effects.groupBy(*by).agg(F.sum(units).alias("_s"), F.count("*").alias("_n"))
    joined = effects.join(totals, by) if by else effects.crossJoin(totals)  # totals: a single row
    others = F.try_divide((F.col("_s") - units).cast("double"), (F.col("_n") - 1).cast("double")) / UNITS
    return joined.select(*by, key, others.alias("mean_of_others"))


def zero_event_bound(rows: DataFrame, by: list[str], confidence: float) -> DataFrame:
    """The upper confidence bound of a rate when no event was seen in n runs."""
    t = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return t.select(*by, "n", r9(1 - F.pow(F.lit(1 - confidence), 1.0 / F.col("n"))).alias("bound"))


def precision_simulation(lineages: DataFrame, seed: int, draws: int, per_lineage: int, per_instance: int) -> DataFrame:
    """Simulated paired effects by lineage probabilities (both, left, right, neither): mean, spread and Monte Carlo error.

    lineages: lineage_id and p_left, p_right (only one side detects); a lineage's draws need no shuffle before its mean.
    """
    cells = lineages.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(per_lineage - 1)))).withColumn("campaign", F.explode(F.sequence(F.lit(0), F.lit(per_instance - 1))))
    u = draw_uniform(F.lit(seed), F.col("draw"), F.col("lineage_id"), F.col("instance"), F.col("campaign"))
    effect = F.when(u < F.col("p_left"), 1.0).when(u < F.col("p_left") + F.col("p_right"), -1.0).otherwise(0.0)
    by_lineage = cells.groupBy("draw", "lineage_id").agg(F.avg(effect).alias("e"))
    by_draw = by_lineage.groupBy("draw").agg(F.avg("e").alias("e"))
    sim = by_draw.agg(F.count("*").alias("draws"), r9(F.avg("e")).alias("mean"), r9(F.stddev_samp("e")).alias("sd"), r9(F.stddev_samp("e") / F.sqrt(F.count("*"))).alias("mcse"))
    k = per_lineage * per_instance
    mu = F.col("p_left") - F.col("p_right")
    analytic = lineages.agg(r9(F.sqrt(F.sum((F.col("p_left") + F.col("p_right") - mu * mu) / k)) / F.count("*")).alias("analytic_sd"), r9(F.stddev_pop(mu)).alias("between_sd"))
    return sim.crossJoin(analytic)  # one row each
