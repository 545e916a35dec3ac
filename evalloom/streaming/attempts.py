"""Attempt logs as streams: schema-bound sources, the lifecycle as keyed state, live telemetry and exactly-once keyed sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalloom.operators.events import MOVES

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, directory: str, kind: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """A file stream of the event log; the order within an attempt is that of event_id."""
    return spark.readStream.schema(EVENT).format(kind).option("maxFilesPerTrigger", per_trigger).load(directory)


STATE = "state string, moves int, illegal int, last_seq long"
CHANGE = "attempt_id long, seq long, state string, moves int, illegal int"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, moves, illegal, last = state.get if state.exists else ("planned", 0, 0, -1)
    rows = pd.concat(list(frames)).sort_values("seq")
    for seq, event in zip(rows["seq"], rows["event"], strict=True):
        if seq <= last:  # a repeated delivery
            continue
        to = MOVES.get((now, event))
        now, moves, illegal, last = to or now, moves + (to is not None), illegal + (to is None), int(seq)
    state.update((now, moves, illegal, last))
    yield pd.DataFrame({"attempt_id": [key[0]], "seq": [last], "state": [now], "moves": [moves], "illegal": [illegal]})


def live_lifecycle(events: DataFrame) -> DataFrame:
    """The state of each attempt after every micro-batch; events must arrive in order of micro-batches, repeats are ignored.

    events: attempt_id, seq, event (start, uncertain, terminal).
    """
    return events.groupBy("attempt_id").applyInPandasWithState(_advance, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_telemetry(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type and time window, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def keyed_writer(path: str, key: str):
    """A foreachBatch function that appends rows whose key isn't in the table yet; replayed batches add nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.dropDuplicates([key])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            first = first.join(spark.read.parquet(path).select(key), key, "left_anti")
        first.write.mode("append").parquet(path)

    return write
