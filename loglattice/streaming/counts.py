"""Structured Streaming: template counts per time window over an unbounded source of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import text as X
from loglattice.operators.matcher import matched
from loglattice.sources.lines import event_lines
from loglattice.sources.scratch import scratch_path


def counted(lines: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and signature of a stream with columns ts, line; state is dropped once the watermark has passed a window."""
    sig = F.array_join(X.masked_digits(X.match_tokens(F.col("line"))), "")
    return lines.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), sig.alias("sig")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "sig", "n")


def matched_stream(lines: DataFrame, templates: DataFrame, head_length: int = 0) -> DataFrame:
    """Lines of a stream joined with a static broadcast template table."""
    return matched(lines, templates, head_length)


def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream, read until none is left; every change of a window's count goes to a table and the last one stands."""
    place = scratch_path(spark, "stream")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    lines = event_lines(stamped.withColumn("event_id", F.struct("event_id", "ts"))).select("rec_no.ts", "line")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/out/part={number}")

    counted(lines).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.parquet(f"{place}/out")
    return out.groupBy("hour", "sig").agg(F.max_by("n", "batch").alias("n")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "sig", "n")
