"""Rule lists as error rows, inventories, coverage, reconciliation and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_errors(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; a rule that is NULL isn't broken."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return rows.select(F.col(key), F.explode(found).alias("rule"))


def duplicate_content(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Hashes that several rows share, with the smallest key and the count."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def inventory(rows: DataFrame, histograms: list[str]) -> DataFrame:
    """Counts by each field on its own, in one pass of grouping sets."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(h).alias("field"), F.col(h).cast("string").alias("value")) for h in histograms))))
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def coverage(support: DataFrame, record: str, method: str, methods: list[str]) -> DataFrame:
    """eligible, unsupported and fraction by method over a fixed denominator, with the records that all methods support."""
    each = support.where(F.col(method).isin(methods)).groupBy(record).agg(F.collect_set(method).alias("have"))
    total = each.agg(F.count("*").alias("total"), F.count_if(F.size("have") == len(methods)).alias("by_all"), *(F.count_if(F.array_contains("have", m)).alias(m) for m in methods))
    long = total.select("total", "by_all", F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("eligible")) for m in methods))))
    return long.select("method", "eligible", (F.col("total") - F.col("eligible")).alias("unsupported"), F.round(F.try_divide("eligible", "total"), 9).alias("fraction"), "by_all")


def rewrite(rows: DataFrame, mapping: DataFrame, scope: str, kind: str, field: str, out: str) -> DataFrame:
    """A field by exact match of (kind, scope, original), then of the shared scope, else unchanged.

    mapping: kind, scope, original, public. Both lookups are one aggregation of the mapping by original and one join.
    """
    own = mapping.where(F.col("kind") == kind)
    by = own.groupBy(F.col("original").alias(field)).agg(F.map_from_entries(F.collect_list(F.struct("scope", "public"))).alias("_m"))
    j = rows.join(by, field, "left")
    return j.withColumn(out, F.coalesce(F.try_element_at("_m", F.col(scope)), F.try_element_at("_m", F.lit("shared")), F.col(field))).drop("_m")


def reconcile(labels: DataFrame) -> DataFrame:
    """Two ratings of an item agree, or stay unresolved with a required reason."""
    agree = F.col("left").eqNullSafe(F.col("right"))
    return labels.select("id", F.when(agree, F.col("left").cast("string")).otherwise("unresolved").alias("status"), F.when(~agree, F.lit("raters_disagree")).alias("reason"))


def reciprocal_pairs(rows: DataFrame, key: str, other: str, lineage: str) -> DataFrame:
    """Pair references that are absent, of another lineage or not returned."""
    p = rows.select(F.col(key).alias("_k"), F.col(lineage).alias("_l"), F.col(other).alias("_o"))
    j = rows.where(F.col(other).isNotNull()).join(p, F.col(other) == F.col("_k"), "left")
    error = F.when(F.col("_k").isNull(), "pair_absent").when(F.col("_l") != F.col(lineage), "pair_lineage_differs").when(~F.col("_o").eqNullSafe(F.col(key)), "pair_not_reciprocal")
    return j.select(F.col(key), error.alias("error")).where("error IS NOT NULL")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of only one side, with the side."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
