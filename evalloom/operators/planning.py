"""Campaign plans, sensitivity grids and closed-form budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions.columns import r9
from evalloom.runtime import global_index


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """RFC 4122 version 5, natively: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def campaign_plan(instances: DataFrame, methods: list[str], backbones: list[str], replicates: int, seed: int) -> DataFrame:
    """instances x methods x backbones x replicates; campaigns are in seeded random order inside each instance, instances in order.

    The product is an explode of literals, so it needs no join; the global index is a block's first index plus the rank within it.
    """
    plan = instances.select("instance_id", "lineage_id", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    plan = plan.select("*", F.explode(F.array(*map(F.lit, backbones))).alias("backbone")).select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    plan = plan.withColumn("campaign_id", uuid5(F.concat_ws("|", "instance_id", "method", "backbone", F.col("replicate").cast("string"))))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.concat_ws("|", "instance_id", "method", "backbone", F.col("replicate").cast("string"))))
    rank = F.row_number().over(Window.partitionBy("instance_id").orderBy(order, "campaign_id")) - 1
    block = global_index(instances.select("instance_id").distinct(), ["instance_id"], "block")
    size = len(methods) * len(backbones) * replicates
    return plan.withColumn("_r", rank).join(block, "instance_id").select("campaign_id", "instance_id", "lineage_id", "method", "backbone", "replicate", (F.col("block") * size + F.col("_r")).cast("long").alias("order_index"))


def sensitivity_matrix(spark: SparkSession, axes: dict[str, list], eligible: Column) -> DataFrame:
    """The ordered product of named axes with an eligibility column and a hashed cell id."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    key = F.concat_ws("|", *(F.col(a).cast("string") for a in axes))
    return out.select(F.substring(F.sha2(key, 256), 1, 16).alias("cell_id"), *axes, F.when(eligible, "eligible").otherwise("excluded").alias("status"))


def budget(rows: DataFrame, instances: Column, methods: int, replicates: int, calls: int, tokens_in: Column, tokens_out: int, hours: float, price_in: Column, price_out: Column) -> DataFrame:
    """Closed-form campaigns, calls, tokens, hours and cost; the cost is NULL unless both rates are known."""
    c = instances * methods * replicates
    n = c * calls
    cost = (F.ceil(n * tokens_in) * price_in + F.ceil(n * F.lit(tokens_out)) * price_out) / 1e6
    return rows.select("*", c.cast("long").alias("campaigns"), n.cast("long").alias("calls"), F.ceil(n * tokens_in).alias("input_tokens"), F.ceil(n * F.lit(tokens_out)).alias("output_tokens"), r9(c * hours).alias("hours"), r9(cost).alias("cost"))


def template_slots(symbols: DataFrame, slots: int) -> DataFrame:
    """Slot i proposes the i-th symbol in order; slots beyond the symbols abstain."""
    ranked = symbols.orderBy("symbol_id").limit(slots).withColumn("slot", F.row_number().over(Window.orderBy("symbol_id")) - 1)
    want = symbols.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return want.join(ranked, "slot", "left").select("slot", "symbol_id", F.when(F.col("symbol_id").isNull(), "abstain").otherwise("candidate").alias("status"))


def calibration_menu(spark: SparkSession, levels: list[str], temperature: float, step: float, costs: dict[str, float]) -> DataFrame:
    """Two levels by two temperatures, with costs that default to 0."""
    menu = spark.createDataFrame([(v, round(temperature + s, 12)) for v in levels for s in (-step, step)], "level string, temperature double")
    cost = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in costs.items()), F.lit(0.0))
    return menu.select(F.concat_ws("-", "level", F.col("temperature").cast("string")).alias("setting_id"), "level", "temperature", cost.alias("cost"))
