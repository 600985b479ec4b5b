"""Incremental forms on Structured Streaming: windowed counts with late data, first lines only, running metrics, appends.

The batch queries need none of these; they are what a pipeline that runs all the time would use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.registry import CORE
from docketry.session import shared_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_counts(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums per sliding window and type; rows later than ``late`` are out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def first_lines(lines: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Lines of a resumed log, each once."""
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, to its end, into a table of the shared folder; a checkpoint makes it resumable."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")  # noqa: E731 (each batch replaces the whole)
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@CORE.add("stream_hourly_counts", "STR-01", "STR-02", sql="select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and type, by a stream run to its end."""
    out = drain(windowed_counts(read_events(spark, sf_dir), "1 hour", "1 hour", "1 hour"), mode="complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@CORE.add("stream_sessions", "STR-01", sql="""
with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end fresh from events where ts is not null and user_id is not null),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from o)
select user_id, min(ts) session_start, max(ts) + interval 6 hour session_end, count(*) n from s group by user_id, k""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that end after six hours without an event."""
    out = drain(sessions(read_events(spark, sf_dir).filter("user_id is not null"), "6 hours", "1 hour"), mode="complete")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@CORE.add("stream_first_lines", "STR-05", sql="select distinct user_id, event_type from events where ts is not null")
def stream_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumed log, each line once: the keys of what passes."""
    rows = read_events(spark, sf_dir).filter("ts is not null").select("user_id", "event_type", "ts")
    return drain(first_lines(rows, ["user_id", "event_type"], "ts", "36500 days")).select("user_id", "event_type")


@CORE.add("stream_running_metrics", "STR-01", "STR-03", sql="select event_type, count(*) n, round(avg(value), 6) mean_value from events group by 1")
def stream_running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over all rows so far, replaced batch by batch."""
    rows = read_events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return drain(rows, mode="complete").select("event_type", "n", F.round("mean_value", 6).alias("mean_value"))
