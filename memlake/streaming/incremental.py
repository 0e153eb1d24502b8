"""Counters kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.work import topics


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def topic_transitions(texts: DataFrame, index) -> DataFrame:
    """(from_topic, to_topic, count) over all texts so far; each text's neighbouring topics count once a pair."""
    found = texts.select(topics(F.col("text"), index).alias("t"))
    pairs = F.filter(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b")), lambda p: p["a"] != p["b"])
    moved = found.where(F.size("t") > 1).select(F.explode(pairs).alias("p"))
    return moved.groupBy(F.col("p.a").alias("from_topic"), F.col("p.b").alias("to_topic")).agg(F.count("*").alias("count"))


def heartbeats(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Last sign of each device in each window; events later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"))


def trigger_counters(events: DataFrame, least_ratio: float = 0.10, least_fires: int = 50) -> DataFrame:
    """(trigger_id, fires, refs, active) after each batch; once off, a trigger stays off."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fires, refs, active = state.get if state.exists else (0, 0, True)
        rows = pd.concat(list(frames)).sort_values("seq")
        for hit in rows["was_referenced"]:
            fires, refs = fires + 1, refs + int(hit)
            active = active and not (fires >= least_fires and refs / fires < least_ratio)
        state.update((fires, refs, active))
        yield pd.DataFrame({"trigger_id": [key[0]], "fires": [fires], "refs": [refs], "active": [active]})

    out = "trigger_id long, fires long, refs long, active boolean"
    return events.groupBy("trigger_id").applyInPandasWithState(update, out, "fires long, refs long, active boolean", "update", GroupStateTimeout.NoTimeout)


def append_versions(path: str, checkpoint: str, updates: DataFrame):
    """Each batch's updates as new versions of an append-only table, which `operators.ingest.current` reads."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
