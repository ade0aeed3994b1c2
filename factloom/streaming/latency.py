"""Structured Streaming: windowed latency, and incremental updates of the fact store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latency_windows(records: DataFrame, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, command, n, mean_ms, max_ms) of records, batch or stream; a stream drops what is later than `late`."""
    if records.isStreaming:
        records = records.withWatermark("recorded_at", late)
    g = records.groupBy(F.window("recorded_at", width).alias("w"), "command").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
    return g.select(F.col("w.start").alias("window_start"), "command", "n", "mean_ms", "max_ms")


def record_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Everything that is there now, through the stream, appended to a table; windows are out once they are closed."""
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def watch(files: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, idle_seconds: float | None = None) -> StreamingQuery:
    """Each batch of changed files goes to `update`; the checkpoint makes this the only writer. Stops after the time, if any."""
    q = files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    if idle_seconds is not None and not q.awaitTermination(int(idle_seconds)):
        q.stop()
    return q
