"""Structured Streaming: change feed, stateful counters, windows.  Time columns without a zone are read as UTC."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def stream_counts(key: tuple, parts, state: GroupState):
    """applyInPandasWithState function: events seen and the last event id of a user."""
    n, last = state.get if state.exists else (0, 0)
    for pdf in parts:
        n += len(pdf)
        last = max(last, int(pdf["event_id"].max()))
    state.update((n, last))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_event_id": [last]})


def counted(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").applyInPandasWithState(stream_counts, "user_id long, n long, last_event_id long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """All there is now, batch by batch; a checkpoint and an idempotent ``sink`` make a rerun harmless."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
