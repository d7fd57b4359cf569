"""Structured Streaming: windowed counts of events with a watermark, and incremental scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions import gaussian

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def state_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def windowed(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than the delay are left out in a stream."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", delay)
    return timed.groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events read as a stream, once through. Each trigger's windows replace the table in the shared folder; none stays with the driver."""
    folder = state_folder(spark)

    def store(windows: DataFrame, _: int) -> None:
        windows.write.mode("overwrite").parquet(f"{folder}/windows")

    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run = windowed(stream).writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    day = F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(f"{folder}/windows").select("event_type", day.alias("day"), "n", F.round("total", 4).alias("total"))


def score_stream(pairs: DataFrame) -> DataFrame:
    """A stream of expression pairs (e1, d1, e2, d2) with their similarity, row by row."""
    return pairs.withColumn("score", gaussian.expression_similarity(F.col("e1"), F.col("d1"), F.col("e2"), F.col("d2"), lenient=True))
