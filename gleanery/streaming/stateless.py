"""Text operators on streams: the row-wise ones need no state, counts take a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.text import clean_text
from gleanery.operators.aspects import detect
from gleanery.operators.sentiment import score_overall


def read_documents(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def enrich(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with ``clean``, ``sentence``, ``aspect`` and ``sentiment``: expressions only, so it holds for batches and streams alike."""
    return detect(stream, text).withColumn("clean", clean_text(F.col(text))).withColumn("sentiment", score_overall(F.col(text))["label"])


def windowed_aspects(stream: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of aspects by event-time window; rows later than ``late`` are let go."""
    rows = stream.withWatermark(ts, late).select(ts, F.explode("aspect").alias("aspect_term"))
    return rows.groupBy(F.window(ts, window), "aspect_term").agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the stream through a sink per batch until its source is used up."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
