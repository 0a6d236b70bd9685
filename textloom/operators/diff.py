"""Unified diffs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.search import cap_in_groups

HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def numbered_lines(lines: DataFrame, source: str) -> DataFrame:
    """Lines (source, pos, line_text) of unified diffs: source, file, old_file, change_type, hunk, header, pos, type,
    content, old_line_number, new_line_number. Context counts on both sides, a deletion on the old and an addition on the
    new one; the other number is null. Headers are only taken for headers before a file's first hunk."""
    x = F.col("line_text")
    # All in one order of a source's lines, with what has run up to a line: one sort, and no file or hunk is held.
    w = Window.partitionBy(source).orderBy("pos")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    running = lambda c: F.sum(c.cast("int")).over(w)
    on_old, on_new = x.startswith(" ") | x.startswith("-"), x.startswith(" ") | x.startswith("+")
    starts, opens = x.startswith("diff --git "), x.startswith("@@ ") & x.rlike(HUNK)
    rows = lines.withColumns({"_starts": starts, "_opens": opens, "_on_old": on_old, "_on_new": on_new})
    rows = rows.withColumns({"_files": running(F.col("_starts")), "_hunks": running(F.col("_opens")), "_olds": running(F.col("_on_old")), "_news": running(F.col("_on_new"))})
    shape = r"^diff --git a/(.+) b/(.+)$"
    name = lambda i: F.nullif(F.regexp_extract(x, shape, i), F.lit(""))
    head = F.struct(name(2).alias("file"), name(1).alias("old_file"), F.col("_hunks").alias("hunks"))
    rows = rows.withColumns({"_head": last(F.when(F.col("_starts"), head)), "_hunk": last(F.when(F.col("_opens"), F.struct(x.alias("line"), F.col("_olds").alias("olds"), F.col("_news").alias("news"))))})
    rows = rows.withColumn("hunk", (F.col("_hunks") - F.col("_head.hunks")).cast("long"))
    seen = lambda words: last(F.when((F.col("hunk") == 0) & x.startswith(words), F.col("_files"))) == F.col("_files")
    kind = F.when(seen("new file"), "added").when(seen("deleted file"), "deleted").when(seen("rename from "), "renamed").otherwise("modified")
    rows = rows.withColumn("change_type", kind).where("hunk > 0")
    rows = rows.withColumn("type", F.when(x.startswith("+"), "addition").when(x.startswith("-"), "deletion").when(x.startswith(" "), "context")).where("type is not null")
    at = lambda i, n: F.regexp_extract("_hunk.line", HUNK, i).cast("int") + F.col(f"_{n}") - F.col(f"_hunk.{n}") - 1
    return rows.select(
        source, F.col("_head.file").alias("file"), F.col("_head.old_file").alias("old_file"), "change_type", "hunk", F.col("_hunk.line").alias("header"), "pos", "type", F.expr("substring(line_text, 2)").alias("content"),
        F.when(F.col("_on_old"), at(1, "olds")).alias("old_line_number"), F.when(F.col("_on_new"), at(2, "news")).alias("new_line_number"),
    )


def first_files(lines: DataFrame, source: str, most: int) -> DataFrame:
    """(source, file, truncated): the first ``most`` files of each source's diff lines (source, pos, line_text), in their
    order, each once, and whether there are more. A line of a hunk begins with another character than a file's header."""
    x = F.col("line_text")
    name = F.regexp_extract(x, r"^diff --git a/.+ b/(.+)$", 1)
    files = lines.where(x.startswith("diff --git ")).select(source, "pos", name.alias("file")).where("file <> ''")
    return cap_in_groups(files.groupBy(source, "file").agg(F.min("pos").alias("pos")), source, ["pos"], most).select(source, "file", "truncated")


def totals(numbered: DataFrame, *keys: str) -> DataFrame:
    return numbered.groupBy(*keys).agg(
        F.countDistinct("file").alias("files"),
        F.countDistinct("file", "hunk").alias("hunks"),
        F.count_if(F.col("type") == "addition").alias("additions"),
        F.count_if(F.col("type") == "deletion").alias("deletions"),
    )


def first_lines(numbered: DataFrame, source: str, most: int) -> DataFrame:
    """The first ``most`` lines of each file, over all its hunks."""
    n = F.row_number().over(Window.partitionBy(source, "file").orderBy("pos"))
    return numbered.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def line_budget(numbered: DataFrame, source: str, most: int) -> DataFrame:
    """One row per hunk, emptied ones too: header, how many of its lines are within the first ``most`` of its file, and
    whether it has more."""
    hunks = numbered.groupBy(source, "file", "hunk").agg(F.first("header").alias("header"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(source, "file").orderBy("hunk")) - F.col("_n")
    left = F.greatest(F.lit(most) - before, F.lit(0))
    return hunks.withColumn("_left", left).select(source, "hunk", "header", F.least("_n", "_left").alias("lines"), (F.col("_n") > F.col("_left")).alias("truncated"))


def change_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """Insertions and deletions of raw diff lines: + but not +++, - but not ---."""
    x = F.col("line_text")
    return lines.groupBy(*keys).agg(F.count_if(x.startswith("+") & ~x.startswith("+++")).alias("insertions"), F.count_if(x.startswith("-") & ~x.startswith("---")).alias("deletions"))
