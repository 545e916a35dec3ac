"""Paired self-joins of two methods, and the agreement of two label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.columns import r9


def paired_effects(rows: DataFrame, contrasts: list[tuple[str, str]], unit: list[str], value: str, arm: str, levels: list[list[str]], keep: list[str] | None = None) -> DataFrame:
    """left minus right of units where both are known, averaged level by level.

    Each contrast's two arms meet in one aggregation by unit, so no join is needed: unmatched units drop out.
    """
    keep = keep or []
    rows = rows.where(F.col(value).isNotNull())
    pairs = F.filter(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.when(F.col(arm) == a, 1).when(F.col(arm) == b, -1)).alias("sign")) for a, b in contrasts)), lambda p: p["sign"].isNotNull())
    long = rows.select(*unit, *keep, F.col(value).cast("double").alias("v"), F.inline(pairs))
    side = lambda s: F.max(F.when(F.col("sign") == s, F.col("v")))
    out = long.groupBy("contrast", *unit, *keep).agg((side(1) - side(-1)).alias("v")).where("v IS NOT NULL")
    for level in levels:
        out = out.groupBy("contrast", *level, *keep).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return out.select("contrast", *levels[-1], *keep, r9("v").alias("effect"), "n")


def agreement(pairs: DataFrame) -> DataFrame:
    """Matched and missing counts, observed agreement and Cohen's kappa of (left, right) labels; NULL means that a side lacks the item."""
    both = pairs.where("left IS NOT NULL AND right IS NOT NULL")
    cells = both.groupBy("left", "right").agg(F.count("*").alias("n"))
    left, right = cells.groupBy(F.col("left").alias("label")).agg(F.sum("n").alias("a")), cells.groupBy(F.col("right").alias("label")).agg(F.sum("n").alias("b"))
    chance = left.join(right, "label").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    counts = pairs.agg(F.count_if(F.col("left").isNotNull() & F.col("right").isNotNull()).alias("matched"), F.count_if(F.col("left").isNull()).alias("missing_left"), F.count_if(F.col("right").isNull()).alias("missing_right"), F.count_if(F.col("left") == F.col("right")).alias("same"))
    # both sides are single rows
    one = counts.crossJoin(chance)
    po, pe = F.try_divide(F.col("same"), F.col("matched")), F.coalesce(F.try_divide(F.col("ab"), F.col("matched").cast("double") * F.col("matched")), F.lit(0.0))
    kappa = F.when(F.col("matched") == 0, None).when((pe == 1) & (po == 1), 1.0).when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe))
    return one.select("matched", "missing_left", "missing_right", r9(po).alias("agreement"), r9(kappa).alias("kappa"))


def confusion(pairs: DataFrame) -> DataFrame:
    """The dense matrix over the labels of matched pairs, zeros included."""
    both = pairs.where("left IS NOT NULL AND right IS NOT NULL")
    cells = both.groupBy("left", "right").agg(F.count("*").alias("n"))
    labels = cells.select(F.col("left").alias("label")).union(cells.select("right")).distinct()
    # the label set is that of a rating scale; the matrix is the result's own size
    grid = labels.select(F.col("label").alias("left")).crossJoin(labels.select(F.col("label").alias("right")))
    return grid.join(cells, ["left", "right"], "left").select("left", "right", F.coalesce("n", F.lit(0)).alias("n"))
