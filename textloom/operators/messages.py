"""Typed JSON records of tools: search messages, diagnostics, tests, benchmarks, processes, syntax matches, languages."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from textloom.functions.text import clean_path


def at(record: Column, path: str, kind: str = "string") -> Column:
    """A dotted path (``data.submatches[0].start``) of a VARIANT as a type; null where it is missing or doesn't fit."""
    return F.try_variant_get(record, f"$.{path}", kind)


def first_of(record: Column, paths: tuple[str, ...], kind: str, default) -> Column:
    """The first path that has a value, else the default."""
    return F.coalesce(*[at(record, p, kind) for p in paths], F.lit(default).cast(kind))


def of_types(records: DataFrame, kinds: tuple[str, ...], record: str = "record") -> DataFrame:
    """Records whose ``type`` is one of some."""
    return records.where(at(F.col(record), "type").isin(*kinds))


def extract(records: DataFrame, kind: str, mapping: dict[str, tuple[str, str]], record: str = "record") -> DataFrame:
    """The other columns and, for records of a type, one column for each (path, type) of the mapping."""
    others = [c for c in records.columns if c != record]
    return of_types(records, (kind,), record).select(*others, *[at(F.col(record), p, t).alias(n) for n, (p, t) in mapping.items()])


#: Where search messages have what.
MATCH = {"file": ("data.path.text", "string"), "line_number": ("data.line_number", "int"), "line_text": ("data.lines.text", "string")}
SUMMARY = {"files_searched": ("data.stats.searches", "long"), "files_with_matches": ("data.stats.searches_with_match", "long"), "total_matches": ("data.stats.matches", "long")}


def search_matches(records: DataFrame) -> DataFrame:
    """One row per matching line: its first match, and its text without the line end."""
    first = {"column_start": ("data.submatches[0].start", "int"), "column_end": ("data.submatches[0].end", "int"), "match_text": ("data.submatches[0].match.text", "string")}
    return extract(records, "match", MATCH | first).withColumn("line_text", F.regexp_replace("line_text", r"\r?\n$", ""))


def search_submatches(records: DataFrame) -> DataFrame:
    """One row per match, all of each line."""
    kind = "array<struct<start:int,end:int,match:struct<text:string>>>"
    rows = extract(records, "match", MATCH | {"_all": ("data.submatches", kind)})
    others = [c for c in rows.columns if c != "_all"]
    rows = rows.select(*others, F.explode("_all").alias("_m"))
    return rows.select(*others, F.col("_m.start").alias("column_start"), F.col("_m.end").alias("column_end"), F.col("_m.match.text").alias("match_text"))


def elapsed_ms(record: Column, path: str = "data.elapsed_total") -> Column:
    """Seconds and nanoseconds as milliseconds; missing ones count as 0."""
    part = lambda name: F.coalesce(at(record, f"{path}.{name}", "double"), F.lit(0.0))
    return part("secs") * 1000 + part("nanos") / 1_000_000


def search_totals(records: DataFrame) -> DataFrame:
    """The totals of summary messages, with execution_ms."""
    rows = of_types(records, ("summary",)).withColumn("execution_ms", elapsed_ms(F.col("record")))
    return extract(rows, "summary", SUMMARY)


def rows_of(records: DataFrame, record: str = "record") -> DataFrame:
    """A top-level array as its elements, anything else as itself: (others, pos from 1, record)."""
    others = [c for c in records.columns if c != record]
    kind = F.schema_of_variant(F.col(record))
    items = F.when(kind.startswith("ARRAY"), F.col(record).cast("array<variant>")).otherwise(F.array(F.col(record)))
    out = records.where(F.col(record).isNotNull()).select(*others, F.posexplode(items).alias("pos", record))
    return out.withColumn("pos", F.col("pos") + 1)


def values_or_lines(df: DataFrame, text: str) -> DataFrame:
    """(others, pos from 1, value): a text that is JSON is one value, an array too; of any other, each line that isn't blank."""
    others = [c for c in df.columns if c != text]
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: F.trim(x) != "")
    whole = F.try_parse_json(F.when(F.trim(text) != "", F.col(text)))
    return df.select(*others, F.posexplode(F.when(whole.isNotNull(), F.array(F.to_json(whole))).otherwise(lines)).alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def _named(record: str, fields: dict[str, tuple[tuple[str, ...], str, object]]) -> list[Column]:
    return [first_of(F.col(record), paths, kind, default).alias(n) for n, (paths, kind, default) in fields.items()]


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("record", "pos")]


# Names of fields in the tools' records, the ones that serve in their place, and what stands for a missing one.
DIAGNOSTIC = {
    "file": (("filename", "file"), "string", ""), "line": (("location.row", "line"), "int", 0), "column": (("location.column", "column"), "int", 0),
    "code": (("code",), "string", ""), "message": (("message",), "string", ""), "severity": (("severity", "type"), "string", ""),
}
TEST = {
    "name": (("name",), "string", ""), "status": (("status", "event"), "string", "unknown"), "duration": (("duration", "exec_time"), "double", 0.0),
    "stdout": (("stdout",), "string", ""), "stderr": (("stderr",), "string", ""),
}
PROCESS = {
    "pid": (("pid",), "int", 0), "name": (("name",), "string", ""), "cpu": (("cpu",), "double", 0.0), "memory": (("memory",), "double", 0.0),
    "user": (("user",), "string", ""), "time": (("time",), "string", ""), "command": (("command",), "string", ""),
}
SYNTAX = {
    "file": (("file", "path"), "string", ""), "line": (("line", "range.start.line"), "int", 0), "column": (("column", "range.start.column"), "int", 0),
    "text": (("text", "match", "line_text"), "string", ""), "replacement": (("replacement",), "string", ""),
}
BENCHMARK = {n: ((n,), "double", 0.0) for n in ("mean", "stddev", "median", "min", "max")}


def diagnostics(records: DataFrame) -> DataFrame:
    """Diagnostics of JSON reports: an array of them, or an object that has them as ``diagnostics`` or ``messages``."""
    own = F.coalesce(F.try_variant_get("record", "$.diagnostics", "variant"), F.try_variant_get("record", "$.messages", "variant"), F.col("record"))
    rows = rows_of(records.withColumn("record", own))
    return rows.select(*_others(rows), *_named("record", DIAGNOSTIC))


def severity_counts(found: DataFrame, *keys: str) -> DataFrame:
    kind = F.col("severity")
    return found.groupBy(*keys).agg(F.count_if(kind == "error").alias("errors"), F.count_if(kind == "warning").alias("warnings"), F.count("*").alias("total"))


def tests(records: DataFrame) -> DataFrame:
    """Test events: records of type ``test`` or with a name."""
    own = records.where((at(F.col("record"), "type") == "test") | at(F.col("record"), "name").isNotNull())
    return own.select(*_others(own), *_named("record", TEST))


def test_totals(found: DataFrame, *keys: str) -> DataFrame:
    s = F.col("status")
    return found.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s.isin("passed", "ok")).alias("passed"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s.isin("skipped", "ignored")).alias("skipped"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("duration_ms"),
    )


def benchmarks(records: DataFrame) -> DataFrame:
    """The ``results`` of benchmark reports, with the times of each run."""
    rows = rows_of(records.withColumn("record", F.try_variant_get("record", "$.results", "variant")))
    times = F.coalesce(at(F.col("record"), "times", "array<double>"), F.expr("cast(array() as array<double>)"))
    return rows.select(*_others(rows), *_named("record", BENCHMARK), times.alias("times"))


def processes(records: DataFrame) -> DataFrame:
    rows = rows_of(records)
    return rows.select(*_others(rows), *_named("record", PROCESS))


def syntax_matches(records: DataFrame) -> DataFrame:
    rows = rows_of(records)
    return rows.select(*_others(rows), *_named("record", SYNTAX))


def api_rows(records: DataFrame, action: str) -> DataFrame:
    """Answers of a forge's interface by action: lists as one row per element, single answers as their first element."""
    rows = rows_of(records)
    lists = ("pr_list", "issue_list", "workflow_run")
    rows = rows if action in lists else rows.where("pos = 1")
    return rows.withColumn("action", F.lit(action))


LANGUAGE = {"name": ("Name", "string"), "files": ("Count", "long"), "code": ("Code", "long"), "comments": ("Comment", "long"), "blanks": ("Blank", "long"), "complexity": ("Complexity", "long")}
FILES = "array<struct<Location:string,Code:bigint,Comment:bigint,Blank:bigint,Complexity:bigint>>"


def languages(records: DataFrame, per_file: bool = False) -> DataFrame:
    """Statistics of each language: lines are code, comments and blanks, a missing one counting as 0. per_file: also
    files_detail, the same of each file with its cleaned path."""
    rows = rows_of(records)
    r = F.col("record")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    total = lambda *c: reduce(lambda a, b: a + b, map(zero, c))
    out = rows.select(*_others(rows), "record", *[at(r, p, t).alias(n) for n, (p, t) in LANGUAGE.items()]).withColumn("lines", total(F.col("code"), F.col("comments"), F.col("blanks")))
    if per_file:
        one = lambda f: F.struct(
            clean_path(f["Location"]).alias("path"), total(f["Code"], f["Comment"], f["Blank"]).alias("lines"), zero(f["Code"]).alias("code"),
            zero(f["Comment"]).alias("comments"), zero(f["Blank"]).alias("blanks"), f["Complexity"].alias("complexity"),
        )
        out = out.withColumn("files_detail", F.transform(at(r, "Files", FILES), one))
    return out.drop("record")


@pandas_udf(StringType())
def toml_as_json(texts: pd.Series) -> pd.Series:
    """TOML documents as JSON, by the standard library's parser; null for null, and for what is no TOML."""
    import json
    import tomllib

    def one(text):
        try:
            return None if text is None else json.dumps(tomllib.loads(text), default=str, sort_keys=True)
        except tomllib.TOMLDecodeError:
            return None

    return texts.map(one)
