"""Find and replace as a pure transformation: manifests, previews, totals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let, sums_before
from textloom.operators.search import cap, matching_lines, may_match, numbered, with_context


def manifest(files: DataFrame, file: str, text: str, regex: str, replacement: str) -> DataFrame:
    """One row per file: replacements_count, modified and the new text. The replacement may name groups as $1."""
    out = files.select(file, F.col(text).alias("old"))
    out = out.withColumns({"replacements_count": F.regexp_count("old", F.lit(regex)).cast("long"), "new_text": F.regexp_replace("old", regex, replacement)})
    return out.withColumn("modified", F.col("replacements_count") > 0).drop("old")


def totals(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count("*").alias("files_processed"),
        F.coalesce(F.sum("replacements_count"), F.lit(0)).alias("total_replacements"),
        F.count_if("modified").alias("files_modified"),
    )


def preview(files: DataFrame, regex: str, replacement: str, text: str = "text") -> DataFrame:
    """files' other columns with line_number, context_before, original_line, replaced_line and context_after of the lines
    that would change: what a dry run shows. Contexts are one line, null where the file ends. Works inside the row."""
    found = with_context(files, regex, 1, 1, text)
    own = [c for c in files.columns if c != text]
    return found.select(
        *own, "line_number", F.get("context_before", F.lit(0)).alias("context_before"), F.col("line_text").alias("original_line"),
        F.regexp_replace("line_text", regex, replacement).alias("replaced_line"), F.get("context_after", F.lit(0)).alias("context_after"),
    )


def line_replacements(line: Column, regex: str, replacement: str) -> Column:
    """All replacements of a line as an array of (column_start, column_end, original_text, replaced_text), byte offsets in
    the old line. Matches are found, and replaced, in the whole line, so that lookaround sees what stands around them."""
    between = F.split(line, regex, -1)
    own = F.regexp_extract_all(line, F.lit(regex), F.lit(0))
    # The new line with each match between two marks: what stands between them is what replaced it. A mark is a run of one
    # character that is longer than any that the line's and the replacement's own could make.
    copies = len(re.findall(r"(?<!\\)\$", replacement)) + 1
    run = (F.length(line) - F.length(F.translate(line, "\ufffe", ""))) * copies + replacement.count("\ufffe") + 1
    mark = F.concat(F.lit("\uffff"), F.repeat(F.lit("\ufffe"), run), F.lit("\uffff"))
    marked = F.split(F.regexp_replace(line, F.lit(regex), F.concat(mark, F.lit(replacement), mark)), mark, -1)
    # Each match begins behind the texts before it and the matches before it.
    def placed(parts: Column) -> Column:
        begin = sums_before(F.transform(parts, lambda x: x["gap"] + F.octet_length(x["old"])))

        def row(x: Column, before: Column) -> Column:
            start = (before + x["gap"]).cast("int")
            return F.struct(start.alias("column_start"), (start + F.octet_length(x["old"])).alias("column_end"), x["old"].alias("original_text"), x["new"].alias("replaced_text"))

        return let(begin, lambda sums: F.transform(parts, lambda x, i: row(x, F.get(sums, i))))

    pairs = let(between, lambda gaps: let(marked, lambda news: F.transform(own, lambda x, i: F.struct(F.octet_length(F.get(gaps, i)).alias("gap"), x.alias("old"), F.get(news, 2 * i + 1).alias("new")))))
    return let(pairs, placed)


def replacements(files: DataFrame, regex: str, replacement: str, text: str = "text", most: int | None = None) -> DataFrame:
    """files' other columns with line_number, column_start, column_end, original_text and replaced_text of every replacement
    in every line, the first ``most`` of each file in line order. Works inside the row. Empty matches are left out."""
    own = [c for c in files.columns if c != text]
    if most is None:
        lines = matching_lines(files, regex, text)
        return lines.select(*own, "line_number", F.inline(line_replacements(F.col("line_text"), regex, replacement))).where("column_end > column_start")
    found = F.filter(numbered(F.col(text)), lambda x: x["line_text"].rlike(regex))
    each = F.transform(found, lambda x: F.transform(line_replacements(x["line_text"], regex, replacement), lambda r: F.struct(x["line_number"].alias("line_number"), *[r[c].alias(c) for c in ("column_start", "column_end", "original_text", "replaced_text")])))
    every = F.filter(F.flatten(each), lambda r: r["column_end"] > r["column_start"])
    return files.where(may_match(F.col(text), regex)).select(*own, F.inline(F.slice(every, 1, most)))


def change_manifest(files: DataFrame, file: str, regex: str, replacement: str, text: str = "text", most_files: int = 1000, dry_run: bool = True) -> DataFrame:
    """One row per file: replacements_count, modified, replacements (null without any) and preview (null unless dry_run or
    without any), of the first ``most_files`` files by ``file``; truncated: whether there are more files."""
    found = F.filter(numbered(F.col(text)), lambda x: x["line_text"].rlike(regex))
    each = F.transform(found, lambda x: F.transform(line_replacements(x["line_text"], regex, replacement), lambda r: F.struct(x["line_number"].alias("line_number"), *[r[c].alias(c) for c in ("column_start", "column_end", "original_text", "replaced_text")])))
    every = F.filter(F.flatten(each), lambda r: r["column_end"] > r["column_start"])
    shown = F.transform(found, lambda x: F.struct(x["line_number"].alias("line_number"), x["line_text"].alias("original_line"), F.regexp_replace(x["line_text"], regex, replacement).alias("replaced_line")))
    rows = files.select(file, every.alias("replacements"), shown.alias("preview"))
    rows = cap(rows, [file], most_files)
    n = F.size("replacements").cast("long")
    return rows.select(file, n.alias("replacements_count"), (n > 0).alias("modified"), F.when(n > 0, F.col("replacements")).alias("replacements"), F.when((n > 0) & F.lit(dry_run), F.col("preview")).alias("preview"), "truncated")
