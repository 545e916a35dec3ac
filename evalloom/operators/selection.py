"""Stratified, balanced and greedy selection; first-wins de-duplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.columns import r9


def stratified_sample(rows: DataFrame, key: str, stratum: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Seeded sampling without replacement by stratum, with weights; strata without a size are left out. The query fails for a size beyond the
    stratum, and for null or repeated keys.

    Ranks up to the greatest size only are asked for, so each partition sends no more than that many rows of a stratum.
    """
    wanted = rows.where(F.col(stratum).isin(list(sizes)))
    counts = wanted.groupBy(stratum).agg(F.count("*").alias("_n"), F.count_distinct(key).alias("_d"))
    hashed = wanted.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string"))))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where(F.col("_r") <= max(sizes.values(), default=0))
    want = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))))
    both = ranked.join(F.broadcast(counts), stratum).withColumn("_k", want[F.col(stratum)])  # counts: at most one row a size
    problem = F.when(F.col("_d") < F.col("_n"), F.raise_error(F.lit("keys are null or repeat"))).when(F.col("_k") > F.col("_n"), F.raise_error(F.lit("a stratum is smaller than its sample"))).cast("double")
    return both.withColumn("_w", F.coalesce(problem, F.col("_n") / F.col("_k"))).where("_r <= _k AND _w IS NOT NULL").select(key, stratum, r9("_w").alias("weight"))


def balanced_subset(rows: DataFrame, key: str, balance: list[str], cover: list[str], size: int, seed: int) -> DataFrame:
    """Greedy: first a row for each value of the cover fields, then rows whose balance values were picked least, by seeded rank.

    Every pick changes the counts, so the greedy part is sequential; it runs over at most `size` rows of each cell of balance values.
    """
    ranked = rows.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string"))))
    cell = Window.partitionBy(*balance).orderBy("_h", key)
    # of rows equal in all balance fields only the first `size` can be picked
    few = ranked.withColumn("_c", F.row_number().over(cell)).where(F.col("_c") <= size).drop("_c")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_h", key]).reset_index(drop=True)
        taken: list[int] = []
        counts: dict[tuple, int] = {}

        def take(i: int) -> None:
            taken.append(i)
            for f in balance:
                counts[f, frame.at[i, f]] = counts.get((f, frame.at[i, f]), 0) + 1

        for f in cover:
            for i in range(len(frame)):
                if len(taken) < size and (f, frame.at[i, f]) not in counts:
                    take(i)
        chosen = set(taken)
        columns = [frame[f].tolist() for f in balance]
        while len(taken) < min(size, len(frame)):
            best = min((i for i in range(len(frame)) if i not in chosen), key=lambda i: ([counts.get((f, c[i]), 0) for f, c in zip(balance, columns, strict=True)], i))
            take(best)
            chosen.add(best)
        return frame.loc[taken, [key, *balance]].assign(pick=range(len(taken)))

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [key, *balance]) + ", pick long"
    return few.select(key, *balance, "_h", F.lit(1).alias("_g")).groupBy("_g").applyInPandas(pick, schema)


def cheapest_eligible(rows: DataFrame, ok: Column, order: list[Column]) -> DataFrame:
    """The first eligible row in the given order, or none."""
    return rows.where(ok).orderBy(*order).limit(1)


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, by aggregation: nothing is sorted."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def duplicate_slots(slots: DataFrame, campaign: str, identity: str, slot: str, accepted: Column) -> DataFrame:
    """Slots that repeat an identity accepted earlier in their campaign; a slot that failed its budget never blocks later ones."""
    first = F.min(F.when(accepted, F.col(slot))).over(Window.partitionBy(campaign, identity))
    return slots.withColumn("duplicate", F.coalesce(F.col(slot) > first, F.lit(False)))


def smallest_passing(rows: DataFrame, r: str, ok: Column) -> DataFrame:
    return rows.agg(F.min(F.when(ok, F.col(r))).alias(r)).select(r, F.when(F.col(r).isNull(), "no_candidate_meets_targets").alias("note"))


def latest_status(history: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Each change with the status before it."""
    w = Window.partitionBy(key).orderBy(order)
    return history.select(key, order, status, F.lag(status).over(w).alias("previous"), (F.lead(F.lit(1)).over(w).isNull()).alias("effective"))


def pending(rows: DataFrame, done: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows in order that aren't done yet: a resumable batch."""
    return rows.join(done.select(key), key, "left_anti").orderBy(order).limit(n)


