"""The line operators on streams: records are parsed as they arrive, and counted in windows with late ones allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.tables import json_records


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def matching_lines(lines: DataFrame, regex: str, text: str = "line_text") -> DataFrame:
    """Stateless search; works on streams and tables alike."""
    return lines.where(F.col(text).rlike(regex))


def parsed(lines: DataFrame, column: str) -> DataFrame:
    """Lines of JSON as VARIANT records, bad lines dropped."""
    return json_records(lines, column)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and window of event time; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
