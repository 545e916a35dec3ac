"""Connected components by alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.runtime import materialize


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b): the smallest id that links reach. Loops and repeated edges are allowed."""
    e = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x"), F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        rest = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        e = materialize(low.select("v", F.col("m").alias("u")).unionByName(rest).distinct(), "stars")
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)
