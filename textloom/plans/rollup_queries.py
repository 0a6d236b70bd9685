"""Roll-ups, statistics, and discovery over paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import half_up, pattern
from textloom.operators import discovery as D
from textloom.operators import rollup as U
from textloom.operators import search as S
from textloom.operators import tabular as T
from textloom.operators.code import line_counts
from textloom.plans.params import Param
from textloom.plans.registry import query
from textloom.plans.search_queries import LINES, doc_lines
from textloom.sources.tables import table

KINDS = "count(DISTINCT doc_id) AS files, count(*) AS lines, count(*) FILTER (WHERE trim(line_text) <> '' AND NOT regexp_matches(trim(line_text), '^(#|//|--|[*])')) AS code, count(*) FILTER (WHERE trim(line_text) <> '' AND regexp_matches(trim(line_text), '^(#|//|--|[*])')) AS comments, count(*) FILTER (WHERE trim(line_text) = '') AS blanks"


@query("lang_totals", LINES + f"SELECT lang, {KINDS} FROM l GROUP BY lang", "rollup")
def lang_totals(spark, sf_dir):
    """Files and kinds of lines of each language."""
    return U.line_kinds(doc_lines(spark, sf_dir), "lang")


@query("lang_percentages", LINES + ", g AS (SELECT lang, count(*) AS lines FROM l GROUP BY lang) SELECT lang, lines, floor(lines * 1000.0 / sum(lines) OVER () + 0.5) / 10 AS percent FROM g", "rollup")
def lang_percentages(spark, sf_dir):
    """Each language's share of the lines."""
    g = doc_lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("lines"))
    return g.withColumn("percent", U.share_of_total(F.col("lines")))


@query("lang_grouping_sets", "SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, source))", "rollup")
def lang_grouping_sets(spark, sf_dir):
    """Summary, per language, and per language and source, in one pass."""
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([[], [F.col("lang")], [F.col("lang"), F.col("source")]], "lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


@query("files_topn_per_lang", "SELECT lang, doc_id, n_chars, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5", "rollup", (Param("most", "integer", 5, minimum=1),))
def files_topn_per_lang(spark, sf_dir, most=5):
    """The largest files of each language."""
    return U.top_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", [F.desc("n_chars"), F.col("doc_id")], most)


@query("sum_null_if_any_null", "SELECT source, CASE WHEN count(*) = count(quality) THEN CAST(coalesce(sum(quality), 0) AS BIGINT) END AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source", "rollup")
def sum_null_if_any_null(spark, sf_dir):
    """A sum that is null if any value is missing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(U.sum_or_null(F.col("quality")).alias("total"))


COCOMO = "WITH g AS (SELECT lang, sum(n_chars) / 40000.0 AS kloc FROM documents GROUP BY lang), m AS (SELECT lang, 2.4 * pow(kloc, 1.05) AS effort FROM g), s AS (SELECT lang, effort, 2.5 * pow(effort, 0.38) AS schedule FROM m) SELECT round(sum(effort), 4) AS effort, round(max(schedule), 4) AS schedule, round(max(effort / schedule), 4) AS people, floor(sum(effort * 8000) + 0.5) AS cost FROM s"


@query("cocomo_rollup", COCOMO, "rollup")
def cocomo_rollup(spark, sf_dir):
    """Cost model of each language, rolled up: sum of efforts, longest schedule, most people."""
    g = table(spark, sf_dir, "documents").groupBy("lang").agg((F.sum("n_chars") / 40000.0).alias("kloc"))
    effort, schedule, people = U.effort(F.col("kloc"))
    out = g.select(effort.alias("effort"), schedule.alias("schedule"), people.alias("people"))
    return out.agg(F.round(F.sum("effort"), 4).alias("effort"), F.round(F.max("schedule"), 4).alias("schedule"), F.round(F.max("people"), 4).alias("people"), half_up(F.sum(F.col("effort") * 8000)).cast("double").alias("cost"))


@query("benchmark_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, median(value) AS median, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY event_type", "rollup")
def benchmark_stats(spark, sf_dir):
    """Statistics of each key's runs."""
    return U.run_stats(table(spark, sf_dir, "events"), "event_type", "value").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("diag_severity_counts", "SELECT source, count(*) FILTER (WHERE toxic = 1) AS errors, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS warnings, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY source", "rollup")
def diag_severity_counts(spark, sf_dir):
    """Errors and warnings of each source."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("errors"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 0)).alias("warnings"), F.count("*").alias("total"))


@query("test_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS skipped, round(sum(value), 3) AS duration FROM events", "rollup")
def test_summary(spark, sf_dir):
    """Passed, failed and skipped events with their total duration."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    return e.agg(
        F.count("*").alias("total"), F.count_if(kind.isin("purchase", "signup")).alias("passed"), F.count_if(kind == "error").alias("failed"),
        F.count_if(kind.isin("view", "click")).alias("skipped"), F.round(F.sum("value"), 3).alias("duration"),
    )


@query("process_list_sorted", "SELECT l_orderkey AS pid, l_linenumber AS thread, l_extendedprice AS cpu, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place, l_partkey FROM lineitem", "rollup")
def process_list_sorted(spark, sf_dir):
    """All rows with their places, the heaviest first."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("thread"), F.col("l_extendedprice").alias("cpu"), "l_partkey")
    return T.ranked(p, [F.desc("cpu"), "pid", "thread", "l_partkey"])


@query("process_filter", "SELECT l_orderkey AS pid, l_linenumber AS thread, l_shipmode_like AS command FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) WHERE l_shipmode_like LIKE 'R%'", "rollup")
def process_filter(spark, sf_dir):
    """Rows whose command begins with a text."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("thread"), F.concat("l_returnflag", "l_linestatus").alias("command"))
    return p.where(F.col("command").startswith("R"))


PATHS = "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages) "


def _paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query("file_find_pattern", PATHS + "SELECT page_id, path, regexp_extract(path, '([^/]+)/?$', 1) AS name FROM p WHERE regexp_matches(regexp_extract(path, '([^/]+)/?$', 1), '^[0-9]*7')", "discovery", (Param("regex", "string", "^[0-9]*7", min_length=1),))
def file_find_pattern(spark, sf_dir, regex="^[0-9]*7"):
    """Paths whose last part matches."""
    return D.find(_paths(spark, sf_dir), regex, hidden=True).drop("type")


@query("file_find_ext_depth", PATHS + "SELECT page_id, path FROM p WHERE suffix(path, '.html') AND len(string_split(path, '/')) <= 3", "discovery", (Param("extension", "string", "html", min_length=1), Param("max_depth", "integer", 3, minimum=1)))
def file_find_ext_depth(spark, sf_dir, extension="html", max_depth=3):
    """Paths by extension and depth."""
    return D.find(_paths(spark, sf_dir), extension=extension, max_depth=max_depth, hidden=True).select("page_id", "path")


@query("file_find_listed", PATHS + "SELECT page_id, path, regexp_extract(path, '([^/]+)/?$', 1) AS name, CASE WHEN suffix(path, '/') THEN 'directory' ELSE 'file' END AS type FROM p", "discovery")
def file_find_listed(spark, sf_dir):
    """Paths with name and kind."""
    return D.listed(_paths(spark, sf_dir))


@query("file_find_type", PATHS + "SELECT CASE WHEN suffix(path, '/') THEN 'directory' ELSE 'file' END AS type, count(*) AS n FROM p GROUP BY 1", "discovery")
def file_find_type(spark, sf_dir):
    """How many paths are directories."""
    return D.listed(_paths(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query("file_find_exclude", PATHS + "SELECT page_id, path FROM p WHERE path NOT LIKE '%/en/%' AND path NOT LIKE 'blog.%'", "discovery", (Param("exclude", "array", ("**/en/**", "blog.**/**")),))
def file_find_exclude(spark, sf_dir, exclude=("**/en/**", "blog.**/**")):
    """Paths outside of some globs."""
    return D.by_globs(_paths(spark, sf_dir), "path", (), tuple(exclude))


FILES = "WITH f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '.git/' || doc_id ELSE source || '/' || doc_id || '.txt' END AS path, n_chars AS size, 1717200000 - doc_id * 3600 % 2592000 AS modified FROM documents) "


def _files(spark, sf_dir):
    path = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(".git/"), F.col("doc_id").cast("string"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (F.lit(1717200000) - F.col("doc_id") * 3600 % 2592000).alias("modified"))


@query("file_find_size_time", FILES + "SELECT doc_id, path FROM f WHERE path NOT LIKE '.git/%' AND size >= 2000 AND modified >= 1717200000 - 604800 AND modified < 1717200000 - 86400", "discovery", (Param("size", "string", "+2k"), Param("changed_within", "string", "7d"), Param("changed_before", "string", "1d")))
def file_find_size_time(spark, sf_dir, size="+2k", changed_within="7d", changed_before="1d"):
    """Files by size and time of change, hidden ones left out."""
    return D.find(_files(spark, sf_dir), size=size, changed_within=changed_within, changed_before=changed_before, now=F.lit(1717200000)).select("doc_id", "path")


@query("file_find_hidden", FILES + "SELECT doc_id, path FROM f WHERE path LIKE '.git/%' AND size <= 1000", "discovery")
def file_find_hidden(spark, sf_dir):
    """Small hidden files."""
    return D.by_globs(D.find(_files(spark, sf_dir), hidden=True, size="-1k"), "path", (".git/*",)).select("doc_id", "path")


@query("files_by_time", FILES + "SELECT doc_id, row_number() OVER (ORDER BY modified DESC, doc_id) AS place FROM f", "discovery", (Param("key", "string", "modified", enum=("path", "size", "modified")), Param("descending", "boolean", True)))
def files_by_time(spark, sf_dir, key="modified", descending=True):
    """All files with their places by a key."""
    f = _files(spark, sf_dir)
    return T.ranked(f, [F.desc(key) if descending else F.asc(key), "doc_id"]).select("doc_id", "place")


@query(
    "search_sorted",
    LINES.rstrip() + ", " + FILES.removeprefix("WITH ") + "SELECT doc_id, line_number, row_number() OVER (ORDER BY modified - doc_id % 1000 * 60, doc_id, line_number) AS place FROM l JOIN f USING (doc_id) WHERE regexp_matches(line_text, '[Tt]h[a-z]+tion')",
    "search",
    (Param("sort", "string", "created", enum=S.SORTS),),
)
def search_sorted(spark, sf_dir, sort="created"):
    """Matches in files, with their places by path or by a time."""
    files = _files(spark, sf_dir).select("doc_id", "path", "modified", (F.col("modified") - F.col("doc_id") % 1000 * 60).alias("created"))
    found = S.search_files(table(spark, sf_dir, "documents").select("doc_id", "text"), pattern("[Tt]h[a-z]+tion")).select("doc_id", "line_number")
    return S.sorted_matches(found.join(files, "doc_id"), sort, "path" if sort == "path" else "doc_id").select("doc_id", "line_number", "place")


@query("dir_rank_top1", PATHS + "SELECT string_split(path, '/')[1] AS path, count(*) AS score FROM p GROUP BY 1 ORDER BY score DESC, 1 LIMIT 1", "discovery")
def dir_rank_top1(spark, sf_dir):
    """The directory with most entries."""
    p = _paths(spark, sf_dir).groupBy(F.split("path", "/")[0].alias("path")).agg(F.count("*").alias("score"))
    return p.orderBy(F.desc("score"), "path").limit(1)


_BLOCKS = """WITH t AS (SELECT doc_id, lang, string_split(replace(coalesce(text, ''), '*/', '* /'), chr(10)) AS a FROM documents),
n AS (SELECT doc_id, lang, len(a) AS n, len(list_filter(a, lambda x: NOT regexp_matches(x, '[^ \t\n\r\f\v]'))) AS b FROM t)
SELECT doc_id, CAST(n + 6 AS BIGINT) AS lines, CAST(2 AS BIGINT) AS code, CAST(n - b + 3 AS BIGINT) AS comments, CAST(b + 1 AS BIGINT) AS blanks FROM n"""


@query("lang_block_comments", _BLOCKS, "rollup")
def lang_block_comments(spark, sf_dir):
    """Code, comments and blanks of files with comments over several lines, and marks of comments in strings."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /"))
    code = F.concat(F.lit("/* begin\n"), body, F.lit('\nend */\nx = "/* no comment // at all";\n \n// one line "\ny(); /* a */ // b\n'))
    files = table(spark, sf_dir, "documents").select("doc_id", F.lit("java").alias("language"), code.alias("source_text"))
    return line_counts(files, "source_text", "language").select("doc_id", "lines", "code", "comments", "blanks")
