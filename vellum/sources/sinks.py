"""Where results go: event logs, raw answers, metric files, run records and a cache with a time to live."""

from __future__ import annotations

import platform

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators import runs


def log(events: DataFrame, path: str) -> None:
    """Appends events (run_id, job_id, ts, phase, event_type, data) as JSON lines; long texts are cut, in nested data too.

    Numbers go on for a whole run: by time from where the run's events in the log end.
    One writer at a time.
    """
    spark, run = events.sparkSession, ["job_id", "run_id"]
    try:
        before = spark.read.schema("seq long, run_id string, job_id string").json(path).groupBy(*run).agg(F.max("seq").alias("__last"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        before = spark.createDataFrame([], "job_id string, run_id string, __last long")
    place = F.row_number().over(Window.partitionBy(*run).orderBy("ts", "event_type"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in run]
    rows = events.withColumn("__place", place).alias("e").join(before.alias("b"), same[0] & same[1], "left")
    data = runs.sanitised(F.col("e.data"), events.schema["data"].dataType)
    rows.select(runs.iso(F.col("e.ts")).alias("ts"), (F.col("__place") + F.coalesce("__last", F.lit(0))).alias("seq"), "e.run_id", "e.job_id", "e.phase", "e.event_type", data.alias("data")).write.mode("append").json(path)


def raw_responses(responses: DataFrame, path: str) -> None:
    """Appends one row (chunk_idx, attempt, kind, text) for each answer, in folders by job; a chunk's answers lie together."""
    rows = responses.select("job_id", "chunk_idx", "attempt", "kind", "text").repartitionByRange("job_id", "chunk_idx").sortWithinPartitions("job_id", "chunk_idx", "attempt")
    rows.write.mode("append").partitionBy("job_id").parquet(path)


def metrics(results: DataFrame, path: str, digits: int = 4) -> None:
    """The same rows as JSON and as CSV with a header; fractions rounded, missing values empty."""
    rounded = results.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in results.dtypes))
    rounded.write.mode("overwrite").json(f"{path}/json")
    rounded.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{path}/csv")


def run_record(spark: SparkSession, job_id: str, path: str, extra: dict[str, str] | None = None) -> None:
    """One row of what a run ran with."""
    row = spark.range(1).select(
        F.lit(job_id).alias("job_id"), runs.iso(F.current_timestamp()).alias("at"), F.lit(spark.version).alias("spark"), F.lit(platform.python_version()).alias("python"),
        F.lit(spark.sparkContext.master).alias("master"), F.to_json(F.create_map(*(F.lit(x) for kv in (extra or {"": ""}).items() for x in kv))).alias("extra"),
    )
    row.coalesce(1).write.mode("append").json(path)


def put(cache: str, rows: DataFrame, seconds: int) -> None:
    """Appends (key, value) to a cache, to last for so many seconds."""
    rows.select("key", "value", F.current_timestamp().alias("put_at"), (F.current_timestamp() + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at")).write.mode("append").parquet(cache)


def live(spark: SparkSession, cache: str, now=None) -> DataFrame:
    """(key, value) of what hasn't expired, the latest of each key."""
    rows = spark.read.parquet(cache).where(F.col("expires_at") > (F.current_timestamp() if now is None else now))
    return rows.groupBy("key").agg(F.max_by("value", "put_at").alias("value"))
