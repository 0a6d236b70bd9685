"""The operations on delimited tables: counts, statistics, frequencies, schemas, slices, columns of lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.scratch import written


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def headers(df: DataFrame) -> DataFrame:
    """One row per column: its place from 1, name, and how many rows have a value."""
    sums = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).alias("n_values")) for i, c in enumerate(df.columns, 1)])
    return sums.select(F.inline(rows))


#: The last row of a slice up to which tasks keep their first rows, instead of a sort of the whole table.
SLICE_ROWS = 100_000


def ranked(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in an order without ties. Sorted by ranges: a row's number in its range, which
    Spark's sort gives, after the rows of the ranges before it. No task gets all rows. The sorted rows are written once, as
    numbers given in one evaluation must not meet those of another."""
    rows = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sums = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + own + 1).drop("_id", "_part", "_before")


def slice_rows(df: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` - 1, from 0, in an order without ties: the first ``end`` rows of each task as long as they
    are few, else by places, see ranked. Both are exact."""
    if end <= SLICE_ROWS:
        return df.orderBy(*order).limit(max(0, end)).offset(min(max(0, start), max(0, end)))
    return ranked(df, order, "_place").where((F.col("_place") > start) & (F.col("_place") <= end)).drop("_place")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """value, count and percent of all rows to one decimal, halves up."""
    rows = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return rows.withColumn("percent", F.floor(F.col("count") * 1000.0 / F.sum("count").over(Window.partitionBy()) + 0.5) / 10)


#: Parts of a column's range whose counts tell in which of them its median lies.
PARTS = 4096


def distributions(values: DataFrame, *keys: str) -> DataFrame:
    """One row per key: n, nulls, min, max, mean, stddev (sample), median and distinct of the values (keys, x: double).

    Exact, and no task holds a key's values: equal values are counted first, summed before the shuffle; a histogram of
    PARTS parts of each key's range gives the part with the middle, and only that part's values are sorted.
    """
    moments = values.groupBy(*keys).agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"))
    same = lambda a, b: reduce(lambda c, k: c & a[k].eqNullSafe(b[k]), keys, F.lit(True))
    ends = moments.select(*keys, F.col("min").alias("_low"), F.col("max").alias("_high"), F.col("n").alias("_total"))
    kinds = values.where("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("c"))
    kinds = kinds.join(ends, same(kinds, ends)).select(*[kinds[k] for k in keys], "x", "c", "_low", "_high", "_total")
    share = (F.col("x") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    kinds = kinds.withColumn("_part", F.least(F.coalesce(F.floor(share * PARTS), F.lit(0)), F.lit(PARTS - 1)).cast("int"))
    parts = kinds.groupBy(*keys, "_part").agg(F.sum("c").alias("_c"), F.count("*").alias("_d"), F.first("_total").alias("_total"))
    by_key = Window.partitionBy(*keys)
    parts = parts.withColumns({"_upto": F.sum("_c").over(by_key.orderBy("_part")), "distinct": F.sum("_d").over(by_key)}).withColumn("_before", F.col("_upto") - F.col("_c"))
    # The middle values are the ones at places floor((n + 1) / 2) and floor(n / 2) + 1.
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = parts.where(((F.col("_before") < low) & (F.col("_upto") >= low)) | ((F.col("_before") < high) & (F.col("_upto") >= high)))
    middle = middle.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_before", "distinct")
    at = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("_part") == F.col("_p"))
    inside = kinds.join(middle, at).withColumn("_to", F.col("_before") + F.sum("c").over(Window.partitionBy(*keys, "_part").orderBy("x")))
    pick = lambda place: F.min(F.when(F.col("_to") >= place, F.col("x")))
    medians = inside.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias("median"), F.first("distinct").alias("distinct"))
    out = moments.join(medians, same(moments, medians), "left")
    return out.select(*[moments[k] for k in keys], "n", "nulls", "min", "max", "mean", "stddev", "median", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, nulls, min, max, mean, stddev (sample), median, distinct values. All columns at once."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])
    return distributions(df.select(F.inline(rows)), "field")


INTEGER, FLOAT, DATE = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d:\d\d(\.\d+)?)?$"


def schema(df: DataFrame) -> DataFrame:
    """The narrowest type that all values of each column, read as text, have: integer, number, date, string, or null."""

    def kind(c: str) -> Column:
        x = F.col(c).cast("string")
        n = F.count(x)
        return (
            F.when(n == 0, "null")
            .when(F.count_if(x.rlike(INTEGER)) == n, "integer")
            .when(F.count_if(x.rlike(FLOAT)) == n, "number")
            .when(F.count_if(x.rlike(DATE)) == n, "date")
            .otherwise("string")
        )

    row = df.agg(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), kind(c).alias("type"), (F.count(F.col(c)) < F.count(F.lit(1))).alias("nullable")).alias(f"c{i}") for i, c in enumerate(df.columns, 1)])
    return row.select(F.inline(F.array(*row.columns)))


def dedup(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def columns_of(lines: DataFrame, text: str, wanted: list[int], delimiter: str, is_regex: bool = False) -> Column:
    """The wanted fields of a line, from 1; null where there is none."""
    parts = F.split(F.col(text), delimiter if is_regex else re.escape(delimiter), -1)
    return F.array(*[F.get(parts, F.lit(i - 1)) for i in wanted])
