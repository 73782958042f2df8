"""Structured Streaming forms of the event operators.  The batch forms are in ``operators.events``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
RING, DECAY = 20, 0.7


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events as Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their sum by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", idle: str = "4 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def accounts(events: DataFrame) -> DataFrame:
    """The state of each account after each trigger: successes, failures, cooldowns, mean latency, recent rate."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, fail, cool, avg, ring = state.get if state.exists else (0, 0, 0, 0.0, [])
        ring = list(ring)
        for f in frames:
            for v in f.sort_values(["ts", "event_id"])["value"]:
                if v < 10:
                    cool += 1
                else:  # an outcome, good or bad, moves the latency
                    ok, fail = ok + (v >= 30), fail + (v < 30)
                    avg = v if avg == 0 else DECAY * avg + (1 - DECAY) * v
                ring = [*ring, int(v >= 30)][-RING:]
        state.update((ok, fail, cool, avg, ring))
        yield pd.DataFrame([(key[0], ok, fail, cool, avg, sum(ring) / max(1, len(ring)))], columns=["user_id", "success", "fail", "cooldowns", "avg_latency", "recent"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, success long, fail long, cooldowns long, avg_latency double, recent double", "ok long, fail long, cool long, avg double, ring array<int>", "update", GroupStateTimeout.NoTimeout)


def breakers(events: DataFrame, run: int = 3) -> DataFrame:
    """Users whose circuit opens: the event that is the ``run``-th failure in a row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        opened = []
        for f in frames:
            for i, v in f.sort_values(["ts", "event_id"])[["event_id", "value"]].itertuples(index=False):
                n = n + 1 if v < 20 else 0
                if n == run:
                    opened.append((key[0], i))
        state.update((n,))
        yield pd.DataFrame(opened, columns=["user_id", "event_id"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "n long", "append", GroupStateTimeout.NoTimeout)


def publish(events: DataFrame, path: str, checkpoint: str):
    """Appends each trigger's events to a table, once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
