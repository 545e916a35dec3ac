"""Binding of symbols to storage and of actions to functions: left joins with a ladder of reasons, the first failing one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of the scalar types in a storage slot.
WIDTHS = {"bool": 1, "uint256": 32, "int256": 32, "address": 20, "bytes32": 32}


def bind_symbols(symbols: DataFrame, layout: DataFrame) -> DataFrame:
    """symbols (symbol_id, name, type) by storage entries (label, slot, offset): status and place."""
    width = F.try_element_at(F.create_map(*(F.lit(x) for kv in WIDTHS.items() for x in kv)), F.col("type"))
    place = layout.groupBy(F.col("label").alias("_label")).agg(F.min(F.struct("slot", "offset")).alias("_p"))
    j = symbols.withColumn("_w", width).join(place, F.col("name") == F.col("_label"), "left")
    slot, offset = F.col("_p.slot"), F.coalesce("_p.offset", F.lit(0))
    status = (
        F.when(F.col("_w").isNull(), "unsupported_type").when(F.col("_label").isNull(), "layout_missing").when(slot.isNull(), "slot_missing")
        .when(offset < 0, "bad_offset").when(offset + F.col("_w") > 32, "packing_exceeds_slot").otherwise("bound")
    )
    return j.select("symbol_id", status.alias("status"), F.when(status == "bound", slot).alias("slot"), F.when(status == "bound", offset).alias("offset"))


def _tail(text: str, length: str) -> Column:
    return F.expr(f"substring({text}, octet_length({text}) - {length} + 1, {length})")


def bind_actions(actions: DataFrame, functions: DataFrame) -> DataFrame:
    """actions (action, name, target) by functions (name, contract): by name, narrowed by suffix match of the target when any function has it.

    Functions are counted by name and contract before they meet anything, and each distinct name and target is answered once, so rows don't
    grow with the functions of a name. A suffix match is an equality of the longer text's last bytes, for the lengths that the other side has under the name.
    """
    binary = lambda c: F.col(c).cast("binary")
    f = functions.where("name IS NOT NULL").groupBy(F.col("name").alias("_n"), F.col("contract").alias("_c")).agg(F.count("*").alias("_k")).withColumn("_cb", binary("_c"))
    every = f.groupBy("_n").agg(F.sum("_k").alias("_all"), F.min("_c").alias("_first"))
    asked = actions.where("name IS NOT NULL").select(F.col("name").alias("_n"), F.col("target").alias("_t")).distinct().withColumn("_tb", binary("_t"))
    f_known, a_known = f.where("_c IS NOT NULL"), asked.where("_t IS NOT NULL").select("_n", "_tb")
    f_lengths, a_lengths = f_known.select("_n", F.expr("octet_length(_cb) AS _l")).distinct(), a_known.select("_n", F.expr("octet_length(_tb) AS _l")).distinct()
    ends = f_known.join(a_lengths, "_n").where("octet_length(_cb) >= _l").groupBy("_n", _tail("_cb", "_l").alias("_tb")).agg(F.sum("_k").alias("_k"), F.min("_c").alias("_c"))
    longer = a_known.join(f_lengths, "_n").where("octet_length(_tb) > _l").select("_n", "_tb", _tail("_tb", "_l").alias("_cb")).join(f_known, ["_n", "_cb"])
    hits = a_known.join(ends, ["_n", "_tb"]).unionByName(longer.select("_n", "_tb", "_k", "_c")).groupBy("_n", "_tb").agg(F.sum("_k").alias("_hits"), F.min("_c").alias("_hit"))
    answers = asked.join(every, "_n").join(hits, ["_n", "_tb"], "left").select("_n", "_t", "_all", "_first", "_hits", "_hit")
    j = actions.join(answers, (F.col("name") == F.col("_n")) & F.col("target").eqNullSafe(F.col("_t")), "left")
    sums = j.groupBy("action").agg(F.coalesce(F.sum("_hits"), F.lit(0)).alias("_hits"), F.min("_hit").alias("_hit"), F.coalesce(F.sum("_all"), F.lit(0)).alias("_all"), F.min("_first").alias("_first"))
    t = sums.select("action", F.when(F.col("_hits") > 0, F.col("_hits")).otherwise(F.col("_all")).alias("n"), F.when(F.col("_hits") > 0, F.col("_hit")).otherwise(F.col("_first")).alias("contract"))
    return t.select("action", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("bound").alias("status"), F.when(F.col("n") == 1, F.col("contract")).alias("contract"))


def legitimacy(candidates: DataFrame, reasons: dict[str, Column], hard: set[str]) -> DataFrame:
    """eligible without a reason, unwarranted for a hard one, else unknown; with the ordered reasons."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in reasons.items())))
    status = F.when(F.size(found) == 0, "eligible").when(F.arrays_overlap(found, F.array(*map(F.lit, sorted(hard)))), "unwarranted").otherwise("unknown")
    return candidates.select("*", status.alias("legitimacy"), found.alias("reasons"))
