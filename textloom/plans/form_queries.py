"""Typed JSON records of tools, made from the tables and read back, so that SQL knows the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import bare_mail, clean_path, iso_utc, leading_int, leading_number
from textloom.operators import messages as M
from textloom.operators import search as S
from textloom.plans.params import Param
from textloom.plans.registry import query
from textloom.plans.search_queries import LINES
from textloom.plans.search_queries import docs as documents
from textloom.sources.tables import table


def _s(name):
    return F.col(name).cast("string")


def _struct(**fields):
    return F.struct(*[(c if not isinstance(c, (str, int, float)) else F.lit(c)).alias(n) for n, c in fields.items()])


def _record(json):
    return F.parse_json(F.to_json(json) if not isinstance(json, str) else json)


def _search_records(spark, sf_dir):
    """Search messages of each document with ``tion``: begin, a match for each line that has it, with all its submatches,
    a broken line, and a summary."""
    lines = F.filter(S.numbered(F.col("text")), lambda x: x["line_text"].contains("tion"))
    d = documents(spark, sf_dir).select("doc_id", lines.alias("lines")).where(F.size("lines") > 0)

    def submatches(line):
        parts = F.split(line, "tion", -1)
        starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.octet_length(F.array_join(F.slice(parts, F.lit(1), i), "tion")))
        return F.transform(starts, lambda x: F.struct(x.alias("start"), (x + 4).alias("end"), F.struct(F.lit("tion").alias("text")).alias("match")))

    path = F.concat(F.lit("src/"), _s("doc_id"))
    match = F.transform("lines", lambda x: F.to_json(_struct(type="match", data=_struct(path=_struct(text=path), line_number=x["line_number"], lines=_struct(text=F.concat(x["line_text"], F.lit("\n"))), submatches=submatches(x["line_text"])))))
    begin = _struct(type="begin", data=_struct(path=_struct(text=path)))
    n = F.aggregate("lines", F.lit(0), lambda a, x: a + F.size(F.split(x["line_text"], "tion", -1)) - 1)
    total = _struct(type="summary", data=_struct(elapsed_total=_struct(secs=2, nanos=(F.col("doc_id") % 1000) * 1_000_000), stats=_struct(searches=7, searches_with_match=1, matches=n)))
    texts = d.select("doc_id", F.explode(F.concat(F.array(F.to_json(begin)), match, F.array(F.lit("{broken"), F.to_json(total)))).alias("text"))
    return texts.select("doc_id", F.try_parse_json("text").alias("record")).where("record is not null")


HITS = LINES + ", f AS (SELECT doc_id, line_number, line_text, regexp_extract_all(line_text, 'tion') AS ms, regexp_split_to_array(line_text, 'tion') AS ps FROM l WHERE contains(line_text, 'tion')) "


@query("messages_by_type", HITS + "SELECT 'match' AS type, count(*) AS n FROM f UNION ALL SELECT 'summary', count(DISTINCT doc_id) FROM f", "forms")
def messages_by_type(spark, sf_dir):
    """Messages of some types, counted."""
    return M.of_types(_search_records(spark, sf_dir), ("match", "summary")).groupBy(M.at(F.col("record"), "type").alias("type")).agg(F.count("*").alias("n"))


@query("messages_matches", HITS + "SELECT doc_id, 'src/' || doc_id AS file, line_number, line_text, CAST(strlen(ps[1]) AS INT) AS column_start, CAST(strlen(ps[1]) + 4 AS INT) AS column_end, 'tion' AS match_text FROM f", "forms")
def messages_matches(spark, sf_dir):
    """Matches of search messages, by paths into them."""
    return M.search_matches(_search_records(spark, sf_dir))


@query("messages_submatches", HITS + ", k AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM f) SELECT doc_id, 'src/' || doc_id AS file, line_number, CAST(list_sum([strlen(x) for x in ps[1:k]]) + 4 * (k - 1) AS INT) AS column_start, CAST(list_sum([strlen(x) for x in ps[1:k]]) + 4 * k AS INT) AS column_end FROM k", "forms")
def messages_submatches(spark, sf_dir):
    """All matches of search messages."""
    return M.search_submatches(_search_records(spark, sf_dir)).drop("line_text", "match_text")


@query("messages_summary", HITS + "SELECT doc_id, CAST(7 AS BIGINT) AS files_searched, CAST(1 AS BIGINT) AS files_with_matches, CAST(sum(len(ms)) AS BIGINT) AS total_matches, CAST(2000 + doc_id % 1000 AS DOUBLE) AS execution_ms FROM f GROUP BY doc_id", "forms")
def messages_summary(spark, sf_dir):
    """Totals of search messages, with their time in milliseconds."""
    return M.search_totals(_search_records(spark, sf_dir))


def _diagnostics(spark, sf_dir):
    """A report of each order: an array, or an object that has it, with fields in either shape."""
    item = _struct(filename=F.concat(F.lit("f"), _s("l_partkey")), location=F.struct(F.col("l_linenumber").alias("row"), F.lit(3).alias("column")), code=F.concat(F.lit("E"), _s("l_suppkey")), message=F.col("l_returnflag"), severity=F.when(F.col("l_linestatus") == "F", "error").otherwise("warning"))
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_json(item).alias("item")).groupBy("l_orderkey").agg(F.collect_list("item").alias("items"))
    body = F.concat(F.lit("["), F.concat_ws(",", "items"), F.lit("]"))
    text = F.when(F.col("l_orderkey") % 2 == 0, body).otherwise(F.concat(F.lit('{"diagnostics":'), body, F.lit("}")))
    return M.diagnostics(each.select("l_orderkey", F.parse_json(text).alias("record")))


@query("diagnostics_json", "SELECT l_orderkey, 'f' || l_partkey AS file, l_linenumber AS line, 3 AS \"column\", 'E' || l_suppkey AS code, l_returnflag AS message, CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'warning' END AS severity FROM lineitem", "forms")
def diagnostics_json(spark, sf_dir):
    """Diagnostics of JSON reports in two shapes."""
    return _diagnostics(spark, sf_dir)


@query("diagnostics_counts", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS errors, count(*) FILTER (WHERE l_linestatus <> 'F') AS warnings, count(*) AS total FROM lineitem GROUP BY 1", "forms")
def diagnostics_counts(spark, sf_dir):
    """Errors and warnings of each report."""
    return M.severity_counts(_diagnostics(spark, sf_dir), "l_orderkey")


def _tests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "signup", "passed").when(F.col("event_type") == "error", "failed").otherwise("ignored")
    whole = _struct(type="test", name=F.concat(F.lit("t"), _s("event_id")), status=status, duration=F.col("value"))
    other = _struct(type="test", event=status, exec_time=F.col("value"), stdout="out")
    text = F.when(F.col("event_id") % 10 == 0, F.lit('{"type":"suite"}')).when(F.col("event_id") % 2 == 0, F.to_json(whole)).otherwise(F.to_json(other))
    return M.tests(e.select("event_id", "user_id", F.parse_json(text).alias("record")))


STATUS = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'passed' WHEN 'error' THEN 'failed' ELSE 'ignored' END"


@query("tests_json", f"SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE '' END AS name, {STATUS} AS status, round(value, 6) AS duration, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'out' END AS stdout, '' AS stderr FROM events WHERE event_id % 10 <> 0", "forms")
def tests_json(spark, sf_dir):
    """Test events with what stands for missing fields."""
    return _tests(spark, sf_dir).withColumn("duration", F.round("duration", 6))


@query("tests_totals", f"SELECT user_id, count(*) AS total, count(*) FILTER (WHERE s IN ('passed', 'ok')) AS passed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'ignored') AS skipped, round(sum(value), 4) AS duration_ms FROM (SELECT *, {STATUS} AS s FROM events WHERE event_id % 10 <> 0) GROUP BY 1", "forms")
def tests_totals(spark, sf_dir):
    """Passed, failed and skipped tests of each run."""
    return M.test_totals(_tests(spark, sf_dir), "user_id").withColumn("duration_ms", F.round("duration_ms", 4))


@query("benchmarks_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS mean, 0.5 AS stddev, 0.0 AS median, 0.0 AS min, 2.5 AS max, '1.5,2.5' AS times FROM events", "forms")
def benchmarks_json(spark, sf_dir):
    """Benchmark reports with their times; what is missing is 0."""
    one = _struct(mean=F.when(F.col("event_id") % 3 != 0, F.col("value")), stddev=0.5, max=2.5, times=F.array(F.lit(1.5), F.lit(2.5)))
    rows = M.benchmarks(table(spark, sf_dir, "events").select("event_id", _record(_struct(results=F.array(one))).alias("record")))
    return rows.withColumn("times", F.concat_ws(",", F.transform("times", lambda x: x.cast("string"))))


@query("processes_json", "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS INT) AS pid, event_type AS name, value AS cpu, 0.0 AS memory, 'u' || user_id AS \"user\", '' AS time, '' AS command FROM events", "forms")
def processes_json(spark, sf_dir):
    """Processes of JSON listings; what is missing is 0 or empty."""
    one = _struct(pid=F.when(F.col("event_id") % 4 != 0, F.col("event_id")), name=F.col("event_type"), cpu=F.col("value"), user=F.concat(F.lit("u"), _s("user_id")))
    return M.processes(table(spark, sf_dir, "events").select("event_id", _record(F.array(one)).alias("record")))


@query("syntax_matches_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'f' || user_id ELSE 'p' || user_id END AS file, CAST(event_id AS INT) AS line, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 5 END AS \"column\", event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS replacement FROM events", "forms")
def syntax_matches_json(spark, sf_dir):
    """Matches of syntax trees, with places in either shape."""
    even = _struct(file=F.concat(F.lit("f"), _s("user_id")), line=F.col("event_id"), column=2, text=F.col("event_type"), replacement="x")
    odd = _struct(path=F.concat(F.lit("p"), _s("user_id")), range=_struct(start=_struct(line=F.col("event_id"), column=5)), match=F.col("event_type"))
    text = F.concat(F.lit("["), F.when(F.col("event_id") % 2 == 0, F.to_json(even)).otherwise(F.to_json(odd)), F.lit("]"))
    return M.syntax_matches(table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("record")))


@query("api_rows", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INT) AS pos, 'pr_list' AS action, event_id AS number FROM events WHERE event_type = 'click'", "forms")
def api_rows(spark, sf_dir):
    """Rows of a forge's list answers."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("number"))
    own = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("number"))).alias("x"))
    rows = M.api_rows(own.select("user_id", F.parse_json(F.to_json("x")).alias("record")), "pr_list")
    return rows.select("user_id", "pos", "action", M.at(F.col("record"), "number", "long").alias("number"))


@query("languages_json", "SELECT c_custkey, 'L' || c_nationkey AS name, CAST(5 AS BIGINT) AS files, CAST(c_custkey * 10 AS BIGINT) AS code, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END AS comments, CAST(3 AS BIGINT) AS blanks, CAST(0 AS BIGINT) AS complexity, CAST(c_custkey * 10 + CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END + 3 AS BIGINT) AS lines, 'src/b.py:' || (c_custkey + 1) AS files_detail FROM customer", "forms", (Param("per_file", "boolean", True),))
def languages_json(spark, sf_dir, per_file=True):
    """Statistics of languages with those of their files."""
    k = F.col("c_custkey")
    file = _struct(Location=F.lit("./src/a/../b.py"), Code=k, Comment=F.lit(1), Complexity=F.lit(0))
    one = _struct(Name=F.concat(F.lit("L"), _s("c_nationkey")), Count=5, Code=k * 10, Comment=F.when(k % 2 == 0, F.col("c_nationkey")), Blank=3, Complexity=0, Files=F.array(file))
    rows = M.languages(table(spark, sf_dir, "customer").select("c_custkey", _record(F.array(one)).alias("record")), per_file)
    return rows.withColumn("files_detail", F.array_join(F.transform("files_detail", lambda f: F.concat(f["path"], F.lit(":"), f["lines"].cast("string"))), ",")) if per_file else rows


@query("json_top_level", "SELECT o_orderkey, 1 AS pos, CAST(o_custkey AS BIGINT) AS k FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_custkey + 1 AS BIGINT) FROM orders WHERE o_orderkey % 2 = 0", "forms")
def json_top_level(spark, sf_dir):
    """An array at the top as rows, an object as one row."""
    a, b = (_struct(k=F.col("o_custkey") + i) for i in (0, 1))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.array(a, b))).otherwise(F.to_json(a))
    rows = M.rows_of(table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(text).alias("record")))
    return rows.select("o_orderkey", "pos", M.at(F.col("record"), "k", "long").alias("k"))


@query("values_or_lines", "SELECT o_orderkey, 1 AS pos, CASE o_orderkey % 3 WHEN 0 THEN '[1,2]' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE 'a: ' || o_custkey END AS value FROM orders UNION ALL SELECT o_orderkey, 2, 'b: x' FROM orders WHERE o_orderkey % 3 = 2", "forms")
def values_or_lines(spark, sf_dir):
    """One JSON value as one row, any other text as its lines."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "[1, 2]").when(k == 1, _s("o_custkey")).otherwise(F.concat(F.lit("a: "), _s("o_custkey"), F.lit("\n \nb: x\n")))
    return M.values_or_lines(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text")


@query("toml_query", "SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS INT) AS nation FROM customer WHERE c_custkey % 5 <> 0", "forms")
def toml_query(spark, sf_dir):
    """Fields of TOML documents; broken ones are dropped."""
    text = F.concat(F.lit("# c\n[own]\nsegment = \""), "c_mktsegment", F.lit("\"\nnation = "), F.when(F.col("c_custkey") % 5 == 0, "?").otherwise(_s("c_nationkey")), F.lit("\n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.parse_json(M.toml_as_json(text)).alias("record")).where("record is not null")
    return rows.select("c_custkey", M.at(F.col("record"), "own.segment").alias("segment"), M.at(F.col("record"), "own.nation", "int").alias("nation"))


@query("json_functions", "SELECT event_id, 'k' AS keys, CAST(2 AS INT) AS length, CAST(json_extract(props, '$.k') AS VARCHAR) || ',7' AS mapped FROM events", "forms")
def json_functions(spark, sf_dir):
    """Keys of an object, length of an array, and a path of each of its elements."""
    doc = F.concat(F.lit("["), "props", F.lit(',{"k":7}]'))
    mapped = F.transform(F.from_json(doc, "array<string>"), lambda x: F.get_json_object(x, "$.k"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.json_array_length(doc).alias("length"), F.array_join(mapped, ",").alias("mapped"))


@query("paths_cleaned", "SELECT page_id, 'a/c' || page_id AS relative, '/x' AS absolute, '../b' AS up, '.' AS nothing FROM pages", "forms")
def paths_cleaned(spark, sf_dir):
    """Paths without . and .. parts."""
    k = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(".\\a\\b\\..\\.\\c"), k).alias("r"), F.concat(F.lit("/../"), k, F.lit("/../x/")).alias("a"), F.concat(k, F.lit("/../../b")).alias("u"), F.concat(k, F.lit("/..")).alias("n"))
    return p.select("page_id", *[clean_path(F.col(c)).alias(n) for c, n in (("r", "relative"), ("a", "absolute"), ("u", "up"), ("n", "nothing"))])


@query("numbers_parsed", "SELECT event_id, CAST(event_id AS INT) AS whole, CAST(event_id AS DOUBLE) + 0.5 AS number, CAST(NULL AS INT) AS none FROM events", "forms")
def numbers_parsed(spark, sf_dir):
    """Numbers that texts begin with."""
    k = _s("event_id")
    return table(spark, sf_dir, "events").select("event_id", leading_int(F.concat(F.lit(" "), k, F.lit("px"))).alias("whole"), leading_number(F.concat(k, F.lit(".5e0 s"))).alias("number"), leading_int(F.concat(F.lit("x"), k)).alias("none"))


@query("dates_and_addresses", "SELECT o_orderkey, strftime(to_timestamp(1700000000 + o_orderkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS date, 'c' || o_custkey || '@x.org' AS mail FROM orders", "forms")
def dates_and_addresses(spark, sf_dir):
    """Unix times as ISO dates, addresses without brackets."""
    mail = F.concat(F.lit("<c"), _s("o_custkey"), F.lit("@x.org>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso_utc(F.lit(1700000000) + F.col("o_orderkey")).alias("date"), bare_mail(mail).alias("mail"))
