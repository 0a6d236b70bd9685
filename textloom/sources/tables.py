"""Readers: tables, lines, JSON records and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, line_number (from 1) and line_text; a trailing carriage return is dropped, an empty last line stays."""
    out = df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_number", "line_text"))
    line = F.col("line_text")
    return out.select(*keys, (F.col("line_number") + 1).alias("line_number"), F.when(line.contains("\r"), F.regexp_replace(line, "\r$", "")).otherwise(line).alias("line_text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, line_text of text files; lines have no order of their own across splits."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line_text"))


def json_records(lines: DataFrame, column: str) -> DataFrame:
    """lines with ``record``: the line as a VARIANT; blank lines and lines that are no JSON are dropped."""
    return lines.withColumn("record", F.try_parse_json(F.col(column))).where(F.col("record").isNotNull())


def json_document(value: Column) -> Column:
    """A whole document as a VARIANT; text that is no JSON raises, an empty one is null."""
    return F.when(F.trim(value) != "", F.parse_json(value))


def delimited(lines: DataFrame, column: str, schema: StructType | str, sep: str = ",", header_pattern: str | None = None) -> DataFrame:
    """The fields of delimited lines (quotes as in CSV); lines that match ``header_pattern`` are left out."""
    rows = lines if header_pattern is None else lines.where(~F.col(column).rlike(header_pattern))
    text = schema if isinstance(schema, str) else schema.simpleString()
    return rows.withColumn("fields", F.from_csv(column, text, {"sep": sep})).select(*[c for c in lines.columns if c != column], "fields.*")
