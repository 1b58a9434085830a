"""Streams enriched row by row: any of the engine's DataFrame operators inside foreachBatch, and live visibility counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def enrich_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch goes through step and is appended as Parquet under its batch id, so a rerun batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and keys; rows later than the watermark are dropped by definition of the window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"))
