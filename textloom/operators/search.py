"""Search in lines and documents: predicates, offsets, context, caps and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import byte_start, first_match, required_word
from textloom.operators.tabular import ranked


def search(lines: DataFrame, regex: str, text: str = "line_text") -> DataFrame:
    """The lines that match, with the first match and its zero-based byte offsets, end exclusive."""
    found = lines.where(F.col(text).rlike(regex))
    found = found.withColumns({"column_start": byte_start(F.col(text), regex), "match_text": first_match(F.col(text), regex)})
    return found.withColumn("column_end", F.col("column_start") + F.octet_length("match_text"))


def search_files(files: DataFrame, regex: str, text: str = "text") -> DataFrame:
    """search over the lines of files: files' other columns, line_number, line_text and the first match of each line."""
    return search(matching_lines(files, regex, text), regex)


def cap_in_groups(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with ``truncated``: whether the group has more. Spark drops rows beyond
    ``most`` + 1 before the shuffle."""
    w = Window.partitionBy(group)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= most + 1)
    return rows.withColumn("truncated", F.max("_n").over(w) > most).where(F.col("_n") <= most).drop("_n")


def numbered(text: Column) -> Column:
    """A text's lines as an array of (line_number from 1, line_text), trailing carriage returns dropped."""
    lines = F.split(text, "\n", -1)
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_number"), F.regexp_replace(x, "\r$", "").alias("line_text")))


def matching_lines(files: DataFrame, regex: str, text: str = "text", most: int | None = None) -> DataFrame:
    """files' other columns with line_number and line_text of the lines that match, the first ``most`` of each file.

    Works inside the row: files that can't have a match are not split, and no line is shuffled."""
    found = F.filter(numbered(F.col(text)), lambda x: x["line_text"].rlike(regex))
    own = files.where(may_match(F.col(text), regex))
    return own.select(*[c for c in files.columns if c != text], F.inline(found if most is None else F.slice(found, 1, most)))


def may_match(text: Column, regex: str) -> Column:
    """False only for texts without a match in any line: those that lack a word that each match holds. The pattern itself
    can't tell, as it may look at line ends, which lines don't have."""
    word = required_word(regex)
    return text.contains(word) if word else text.isNotNull()


def cap(found: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows, with ``truncated``: whether there were more."""
    rows = found.orderBy(*order).limit(most + 1)
    n = Window.orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(n)).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > most)
    return rows.where(F.col("_n") <= most).drop("_n")


SORTS = ("none", "path", "modified", "created")


def sorted_matches(found: DataFrame, by: str, file: str = "path", name: str = "place") -> DataFrame:
    """Matches (``file``, line_number and the column ``by``) with their places from 1, by path or by a time, then by ``file``
    and line; null with ``none``. Missing times come first, as the least ones. Sorted by ranges: no task gets all matches."""
    if by not in SORTS:
        raise ValueError(f"unknown sort: {by}; one of {', '.join(SORTS)}")
    if by == "none":
        return found.withColumn(name, F.lit(None).cast("long"))
    keys = [file, "line_number"] if by == "path" else [by, file, "line_number"]
    return ranked(found, [F.asc_nulls_first(k) for k in keys], name)


def summary(files: DataFrame, regex: str, text: str = "text") -> DataFrame:
    """One row: matching lines, files with some, files searched. One pass, a number for each file."""
    n = F.size(F.filter(numbered(F.col(text)), lambda x: x["line_text"].rlike(regex)))
    own = files.select(F.when(may_match(F.col(text), regex), n).otherwise(0).cast("long").alias("n"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.count_if(F.col("n") > 0).alias("files_with_matches"), F.count("*").alias("files_searched"))


def with_context(files: DataFrame, regex: str, before: int, after: int, text: str = "text") -> DataFrame:
    """files' other columns with line_number, line_text, context_before and context_after of the lines that match: the lines
    around them, oldest first, fewer where the file ends. Works inside the row."""
    rows = files.where(may_match(F.col(text), regex)).withColumn("_lines", F.split(F.col(text), "\n", -1))
    rows = rows.withColumn("_lines", F.transform("_lines", lambda x: F.regexp_replace(x, "\r$", "")))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(regex), i)), lambda i: i.isNotNull())
    around = lambda i: F.struct(
        (i + 1).alias("line_number"),
        F.get("_lines", i).alias("line_text"),
        F.slice("_lines", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))).alias("context_before"),
        F.slice("_lines", i + 2, F.lit(after)).alias("context_after"),
    )
    return rows.select(*[c for c in files.columns if c != text], F.inline(F.transform(places, around)))


def nearest_in_file(files: DataFrame, regex: str, text: str = "text") -> DataFrame:
    """files' other columns with line_number of each line that doesn't match, in files with a match; match_line: the nearest
    match, the earlier one of two; side: whether the line stands before or after it. Works inside the row: each match takes
    the lines up to the middle between it and its neighbours, so the work grows with the lines alone."""
    rows = files.where(may_match(F.col(text), regex)).withColumn("_hits", F.transform(numbered(F.col(text)), lambda x: x["line_text"].rlike(regex)))
    rows = rows.withColumn("_places", F.filter(F.transform("_hits", lambda h, i: F.when(h, i + 1)), lambda i: i.isNotNull())).where(F.size("_places") > 0)

    def around(p: Column, i: Column) -> Column:
        first = F.when(i == 0, 1).otherwise(F.floor((F.get("_places", i - 1) + p) / 2).cast("int") + 1)
        last = F.when(i + 1 == F.size("_places"), F.size("_hits")).otherwise(F.floor((F.get("_places", i + 1) + p) / 2).cast("int"))
        own = F.filter(F.sequence(first, last), lambda n: n != p)
        return F.transform(own, lambda n: F.struct(n.alias("line_number"), p.alias("match_line"), F.when(n < p, "before").otherwise("after").alias("side")))

    return rows.select(*[c for c in files.columns if c != text], F.inline(F.flatten(F.transform("_places", around))))


def nearest_match(context: DataFrame, matches: DataFrame, file: str) -> DataFrame:
    """context (file, line_number) with match_line: the nearest match of the same file, the earlier one of two, and side:
    whether the line stands before or after it. By the last match before and the first one behind, in one sort."""
    both = context.select(file, "line_number", F.lit(None).cast("int").alias("match_line")).unionByName(matches.select(file, "line_number", F.col("line_number").alias("match_line")))
    w = Window.partitionBy(file).orderBy("line_number")
    last = F.last("match_line", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    following = F.first("match_line", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"last": last, "following": following}).where(F.col("match_line").isNull())
    near = F.when(F.col("last").isNull() | (F.col("following") - F.col("line_number") < F.col("line_number") - F.col("last")), F.col("following")).otherwise(F.col("last"))
    out = both.withColumn("match_line", near).where(F.col("match_line").isNotNull())
    return out.select(file, "line_number", "match_line", F.when(F.col("line_number") < F.col("match_line"), "before").otherwise("after").alias("side"))
