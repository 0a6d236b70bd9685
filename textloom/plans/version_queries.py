"""Queries on two versions of a text: the new one is made from the tables, so that SQL knows what has changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import diff as D
from textloom.operators import versions as V
from textloom.plans.params import Param
from textloom.plans.registry import query
from textloom.sources.tables import table, text_lines

NEW_WORDS = """CASE WHEN doc_id % 10 = 0 THEN NULL ELSE flatten(list_transform(string_split(replace(text, ' ', chr(10)), chr(10)), lambda x, i: CASE
WHEN i % 7 = 3 THEN [] WHEN i % 5 = 1 THEN [x || ' changed'] WHEN i % 11 = 4 THEN [x, 'more ' || i] ELSE [x] END)) END"""


def _documents(spark, sf_dir):
    """Documents with a word a line, and a second version: some words gone, changed or followed by others; every tenth
    document is gone as a whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("old"))
    place = lambda i: (i + 1).cast("string")
    edit = lambda x, i: (
        F.when((i + 1) % 7 == 3, F.expr("cast(array() as array<string>)"))
        .when((i + 1) % 5 == 1, F.array(F.concat(x, F.lit(" changed"))))
        .when((i + 1) % 11 == 4, F.array(x, F.concat(F.lit("more "), place(i))))
        .otherwise(F.array(x))
    )
    docs = docs.withColumn("lines", F.split("old", "\n", -1)).withColumn("lines", F.flatten(F.transform("lines", edit)))
    return docs.select("doc_id", "old", F.when(F.col("doc_id") % 10 != 0, F.array_join("lines", "\n")).alias("new"))


@query("version_patched", f"SELECT doc_id, array_to_string({NEW_WORDS}, chr(10)) AS patched FROM documents", "diff")
def version_patched(spark, sf_dir):
    """The second version of each document, made of the first one and the changes between them."""
    return V.apply_changes(V.compare(_documents(spark, sf_dir), "old", "new"), "old").select("doc_id", "patched")


# Orders with a line for each item; in the second version, by the item's number, lines are gone (0 of 4), changed (1), followed by
# another (2) or as they were (3).
VERSIONS = """WITH i AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey, n, n || ' ' || p AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS num FROM i),
w AS (SELECT l_orderkey, n, 0 AS k, CASE WHEN n % 4 = 1 THEN n || ' ' || p || ' changed' ELSE n || ' ' || p END AS line FROM i WHERE n % 4 <> 0 UNION ALL SELECT l_orderkey, n, 1, 'more ' || n FROM i WHERE n % 4 = 2),
v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, k) AS num FROM w) """


def _orders(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    rows = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "p"))).alias("x"))
    line = lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["p"].cast("string"))
    rule = lambda x: F.pmod(x["n"], F.lit(4))
    edit = lambda x: (
        F.when(rule(x) == 0, F.expr("cast(array() as array<string>)"))
        .when(rule(x) == 1, F.array(F.concat(line(x), F.lit(" changed"))))
        .when(rule(x) == 2, F.array(line(x), F.concat(F.lit("more "), x["n"].cast("string"))))
        .otherwise(F.array(line(x)))
    )
    new = F.flatten(F.transform("x", edit))
    return rows.select("l_orderkey", F.array_join(F.transform("x", line), "\n").alias("old"), F.when(F.size(new) > 0, F.array_join(new, "\n")).alias("new"))


@query(
    "version_change_counts",
    VERSIONS
    + """, s AS (SELECT l_orderkey, n, 0 AS k, n % 4 IN (0, 1) AS c FROM i UNION ALL SELECT l_orderkey, n, 1, true FROM i WHERE n % 4 = 2),
r AS (SELECT *, lag(c, 1, false) OVER (PARTITION BY l_orderkey ORDER BY n, k) AS was FROM s)
SELECT l_orderkey, count(*) FILTER (WHERE c AND NOT was) AS ranges, count(*) FILTER (WHERE k = 1 OR n % 4 = 1) AS insertions, count(*) FILTER (WHERE k = 0 AND n % 4 IN (0, 1)) AS deletions FROM r GROUP BY 1""",
    "diff",
)
def version_change_counts(spark, sf_dir):
    """Ranges, insertions and deletions between two versions of each order."""
    return V.counts(V.compare(_orders(spark, sf_dir), "old", "new"), "l_orderkey")


@query(
    "version_diff_lines",
    VERSIONS
    + """SELECT l_orderkey, 'f' || l_orderkey AS file, 'deletion' AS type, line AS content, CAST(num AS INT) AS old_line_number, CAST(NULL AS INT) AS new_line_number FROM o WHERE n % 4 IN (0, 1)
UNION ALL SELECT l_orderkey, 'f' || l_orderkey, 'addition', line, NULL, CAST(num AS INT) FROM v WHERE k = 1 OR n % 4 = 1""",
    "diff",
    (Param("context", "integer", 1, minimum=0),),
)
def version_diff_lines(spark, sf_dir, context=1):
    """Unified diffs of two versions of each order, read back: the lines that have changed, with their numbers."""
    found = V.compare(_orders(spark, sf_dir), "old", "new")
    diffs = V.unified(found, "old", F.concat(F.lit("f"), F.col("l_orderkey").cast("string")), "l_orderkey", context=context)
    lines = text_lines(diffs, "diff", "l_orderkey").withColumnRenamed("line_number", "pos")
    rows = D.numbered_lines(lines, "l_orderkey").where("type <> 'context'")
    return rows.select("l_orderkey", "file", "type", "content", F.col("old_line_number").cast("int").alias("old_line_number"), F.col("new_line_number").cast("int").alias("new_line_number"))
