"""Scoring of new cohorts as they arrive, with Structured Streaming.

Labels are mapped and rows cleaned as in batch; a watermark bounds the state of windowed family counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean, with_family


def clean_stream(spark: SparkSession, folder: str, schema, numeric: list[str], label: str = "label") -> DataFrame:
    """Files of a folder as a stream of cleaned rows with families."""
    return with_family(clean(spark.readStream.schema(schema).parquet(folder), numeric, label), label)


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch scored and written under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of event-time windows; rows later than the watermark are dropped by it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
