"""Totals, shares, conditional counts and statistics over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.tabular import distributions


def sum_or_null(x: Column) -> Column:
    """A sum that is null if any value is null, and 0 of no values."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0)))


def share_of_total(x: Column) -> Column:
    """Percent of the sum over all groups, to one decimal, halves up; 0 of nothing."""
    total = F.sum(x).over(Window.partitionBy())
    return F.when(total == 0, F.lit(0.0)).otherwise(F.floor(x * 1000.0 / total + 0.5) / 10)


def line_kinds(lines: DataFrame, *keys: str) -> DataFrame:
    """Per key: files, lines, code, comments, blanks. A line of white space is blank, one that begins with a mark of
    comments is a comment."""
    t = F.trim("line_text")
    blank, comment = t == "", t.rlike(r"^(#|//|--|\*)")
    return lines.groupBy(*keys).agg(
        F.countDistinct("doc_id").alias("files"),
        F.count("*").alias("lines"),
        F.count_if(~blank & ~comment).alias("code"),
        F.count_if(comment & ~blank).alias("comments"),
        F.count_if(blank).alias("blanks"),
    )


def top_per_group(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group with their rank; Spark drops the others before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def effort(kloc: Column) -> tuple[Column, Column, Column]:
    """Person-months, months and people of the basic constructive cost model, organic mode."""
    # Fixed values of the model.
    months = 2.4 * F.pow(kloc, F.lit(1.05))
    schedule = 2.5 * F.pow(months, F.lit(0.38))
    return months, schedule, F.when(schedule > 0, months / schedule).otherwise(0.0)


def run_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean, stddev (sample), median, min, max and n of each key's runs."""
    return distributions(df.select(key, F.col(value).cast("double").alias("x")), key).select(key, "mean", "stddev", "median", "min", "max", "n")


def counts_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
