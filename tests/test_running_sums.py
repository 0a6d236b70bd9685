"""Running sums inside a row, and many replacements in one line."""

import time

from pyspark.sql import functions as F

from textloom.functions.text import STRETCH, sums_before
from textloom.operators import replace as R


def test_sums_before(spark):
    rows = [list(range(1, n + 1)) for n in (0, 1, 2, STRETCH - 1, STRETCH, STRETCH + 1, 3 * STRETCH, 1000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, x array<int>").select("id", "x", sums_before(F.col("x")).alias("s"))
    for r in df.collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


def test_a_line_of_many_matches_is_replaced_soon(spark):
    n = 10_000
    df = spark.createDataFrame([(1, "é-ab " * n)], "id int, text string")
    began = time.time()
    got = R.replacements(df, "a(b)", "<$1>").orderBy("column_start").collect()
    assert time.time() - began < 20
    assert [(r.column_start, r.column_end) for r in got] == [(6 * i + 3, 6 * i + 5) for i in range(n)]
    assert {(r.original_text, r.replaced_text) for r in got} == {("ab", "<b>")}
