"""Parsers of records: raw text in a tool's format is made from the tables and parsed back, so that SQL knows the result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.text import relative_date
from textloom.operators import diff as D
from textloom.operators import records as P
from textloom.operators import search as S
from textloom.plans.params import Param
from textloom.plans.registry import query
from textloom.sources.raw import blocks
from textloom.sources.scratch import scratch
from textloom.sources.tables import table, text_lines

HASH = "md5(CAST(o_orderkey AS VARCHAR)) || left(md5(CAST(o_custkey AS VARCHAR)), 8)"


def _s(name):
    return F.col(name).cast("string")


def _hash():
    return F.concat(F.md5(_s("o_orderkey")), F.expr("left(md5(cast(o_custkey as string)), 8)"))


def _log(spark, sf_dir):
    """The log of each order: one commit, in the format of a log with names, and a second one of every third order."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    head = F.concat_ws("\n", F.lit(P.COMMIT_START), _hash(), F.expr("left(md5(cast(o_orderkey as string)), 7)"), F.concat(F.lit("order "), _s("o_orderkey")), F.concat(F.lit("body of\n"), "o_orderpriority"), F.lit(""))
    meta = F.concat_ws("\n", F.lit(P.COMMIT_META), F.concat(F.lit("c"), _s("o_custkey")), F.lit("bot"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("3 days ago"), F.lit(P.COMMIT_END))
    tail = F.concat(F.lit("\n\n src/"), "o_orderstatus", F.lit(".txt | 3 +--\n src/F.txt | 1 +\n 2 files changed, "), (key % 100).cast("string"), F.lit(" insertions(+)\n"))
    again = F.when(key % 3 == 0, F.concat_ws("\n", F.lit(P.COMMIT_START), F.md5(_s("o_custkey")), F.lit("abc1234"), F.lit("again"), F.lit(P.COMMIT_META), F.lit("a"), F.lit("b"), F.lit("2024-01-01"), F.lit("now"), F.lit(P.COMMIT_END), F.lit("src/x.txt"), F.lit(""))).otherwise("")
    return o.select("o_orderkey", F.concat(head, F.lit("\n"), meta, tail, again).alias("log"))


COMMITS = f"""SELECT o_orderkey, 0 AS pos, {HASH} AS hash, left(md5(CAST(o_orderkey AS VARCHAR)), 7) AS short_hash, 'c' || o_custkey AS author, 'bot' AS committer, strftime(o_orderdate, '%Y-%m-%d') AS date, '3 days ago' AS date_relative, 'order ' || o_orderkey AS subject, 'body of' || chr(10) || o_orderpriority AS body, 2 AS files, CAST(o_orderkey % 100 AS INT) AS insertions, 0 AS deletions FROM orders
UNION ALL SELECT o_orderkey, 1, md5(CAST(o_custkey AS VARCHAR)), 'abc1234', 'a', 'b', '2024-01-01', 'now', 'again', '', NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0"""


@query("commit_blocks", COMMITS, "records")
def commit_blocks(spark, sf_dir):
    """Commits from blocks between marks."""
    return P.commits(_log(spark, sf_dir), "log", "o_orderkey").drop("files_changed")


@query("commit_files_distinct", "SELECT o_orderkey, 0 AS pos, CASE WHEN o_orderstatus = 'F' THEN 'src/F.txt' ELSE 'src/' || o_orderstatus || '.txt,src/F.txt' END AS files FROM orders UNION ALL SELECT o_orderkey, 1, 'src/x.txt' FROM orders WHERE o_orderkey % 3 = 0", "records")
def commit_files_distinct(spark, sf_dir):
    """The files of each commit, each once."""
    return P.commits(_log(spark, sf_dir), "log", "o_orderkey").select("o_orderkey", "pos", F.array_join("files_changed", ",").alias("files"))


@query("raw_log_commits", COMMITS.replace("SELECT o_orderkey, 0 AS pos, ", "SELECT ").replace("SELECT o_orderkey, 1, ", "SELECT "), "records")
def raw_log_commits(spark, sf_dir):
    """One log of all orders, written as files, and read block by block by as many tasks as the files have parts."""
    path = scratch(spark)
    _log(spark, sf_dir).select(F.col("log").alias("value")).write.text(path)
    found = blocks(spark, path, P.COMMIT_START)
    return P.commits(found.withColumn("log", F.concat(F.lit(f"{P.COMMIT_START}\n"), F.col("block"))), "log").drop("pos", "files_changed")


def _joined(df, key, order, line):
    """One text per key, its lines in order."""
    own = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return own.select(key, F.concat_ws("\n", F.transform("x", lambda x: x["line"])).alias("text"))


@query("numstat_totals", "SELECT l_orderkey, count(*) AS files, sum(CAST(l_quantity AS BIGINT))::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1", "records")
def numstat_totals(spark, sf_dir):
    """Totals of added and deleted lines of each order; binary files have no numbers."""
    line = F.concat_ws("\t", F.when(F.col("l_linenumber") == 5, "-").otherwise(F.col("l_quantity").cast("long").cast("string")), _s("l_linenumber"), F.concat(F.lit("f/"), _s("l_partkey")))
    lines = text_lines(_joined(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], line), "text", "l_orderkey")
    return P.numstat(lines).groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


@query("branch_parse", "SELECT c_custkey, 'b/' || c_custkey AS name, c_custkey % 10 = 0 AS current, left(md5(CAST(c_custkey AS VARCHAR)), 8) AS commit, CASE WHEN c_custkey % 3 = 0 THEN 'origin/b' || c_nationkey END AS remote, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS ahead, CAST(NULL AS INT) AS behind, c_mktsegment AS subject FROM customer WHERE c_custkey % 7 <> 0", "records")
def branch_parse(spark, sf_dir):
    """Branches with their upstreams; symbolic references are left out."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    remote = F.when(key % 3 == 0, F.concat(F.lit("[origin/b"), _s("c_nationkey"), F.lit(": ahead "), _s("c_nationkey"), F.lit("] "))).otherwise("")
    line = F.when(key % 7 == 0, F.concat(F.lit("  remotes/origin/HEAD -> origin/b"), _s("c_custkey"))).otherwise(
        F.concat(F.when(key % 10 == 0, "* ").otherwise("  "), F.lit("b/"), _s("c_custkey"), F.lit("  "), F.expr("left(md5(cast(c_custkey as string)), 8)"), F.lit(" "), remote, F.col("c_mktsegment"))
    )
    return P.branches(c.select("c_custkey", line.alias("line_text")))


@query("tag_parse", "SELECT p_partkey, 'v' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS annotation FROM part", "records")
def tag_parse(spark, sf_dir):
    """Tags, with or without an annotation."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("v"), _s("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("    "), "p_name")).otherwise(""))
    return P.tags(p.select("p_partkey", line.alias("line_text")))


@query("remote_pivot", "SELECT s_suppkey AS repo, 'r' || s_suppkey AS name, 'https://h/' || s_suppkey AS fetch_url, CASE WHEN s_suppkey % 4 <> 0 THEN 'ssh://h/' || s_suppkey END AS push_url FROM supplier", "records")
def remote_pivot(spark, sf_dir):
    """Fetch and push lines of each repository as one row per remote."""
    line = F.concat(F.lit("r"), _s("s_suppkey"), F.lit("\thttps://h/"), _s("s_suppkey"), F.lit(" (fetch)"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("\nr"), _s("s_suppkey"), F.lit("\tssh://h/"), _s("s_suppkey"), F.lit(" (push)"))).otherwise(""))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo"), line.alias("text"))
    return P.remotes(text_lines(s, "text", "repo"), "repo")


@query("config_parse", "SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'bare' || c_custkey ELSE 'k.' || c_custkey END AS key, CASE WHEN c_custkey % 4 < 3 THEN 'a=' || c_mktsegment END AS value, CASE WHEN c_custkey % 4 = 0 THEN 'local' END AS scope, CASE c_custkey % 4 WHEN 0 THEN 'file:x' WHEN 1 THEN 'file:y' END AS origin FROM customer", "records")
def config_parse(spark, sf_dir):
    """Settings in four shapes."""
    c = table(spark, sf_dir, "customer")
    k, kv = F.col("c_custkey") % 4, F.concat(F.lit("k."), _s("c_custkey"), F.lit("\ta="), F.col("c_mktsegment"))
    line = F.when(k == 0, F.concat(F.lit("local:file:x\t"), kv)).when(k == 1, F.concat(F.lit("file:y\t"), kv)).when(k == 2, F.concat(F.lit("k."), _s("c_custkey"), F.lit("=a="), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("bare"), _s("c_custkey")))
    return P.config(c.select("c_custkey", line.alias("line_text")))


@query("stash_parse", "SELECT CAST(o_orderkey % 50 AS INT) AS \"index\", o_orderkey, 'On ' || o_orderstatus || ': ' || o_orderpriority AS message FROM orders", "records")
def stash_parse(spark, sf_dir):
    """Entries of stash lists."""
    line = F.concat(F.lit("stash@{"), (F.col("o_orderkey") % 50).cast("string"), F.lit("}: On "), "o_orderstatus", F.lit(": "), "o_orderpriority")
    return P.stashes(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line_text")))


STATUS_SQL = "WITH s AS (SELECT l_orderkey, CASE l_partkey % 6 WHEN 0 THEN 'M ' WHEN 1 THEN ' M' WHEN 2 THEN '??' WHEN 3 THEN 'UU' WHEN 4 THEN 'R ' ELSE '!!' END AS xy, l_partkey FROM lineitem) "


def _status(spark, sf_dir):
    """The status of each order's repository: a branch line, then a file for each line item."""
    k = F.col("l_partkey") % 6
    xy = F.when(k == 0, "M ").when(k == 1, " M").when(k == 2, "??").when(k == 3, "UU").when(k == 4, "R ").otherwise("!!")
    line = F.concat(xy, F.lit(" "), F.when(k == 4, F.concat(F.lit("old"), _s("l_partkey"), F.lit(" -> "))).otherwise(""), F.lit("f/"), _s("l_partkey"))
    body = _joined(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], line)
    ahead = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit(" [ahead "), (F.col("l_orderkey") % 9 + 1).cast("string"), F.lit(", behind 2]"))).otherwise("")
    branch = F.concat(F.lit("## b/"), _s("l_orderkey"), F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("...origin/main"), ahead)), F.lit("\n"))
    return text_lines(body.select("l_orderkey", F.concat(branch, "text").alias("text")), "text", "l_orderkey")


@query("status_summary", STATUS_SQL + "SELECT l_orderkey, count(*) FILTER (WHERE xy IN ('M ', 'R ')) AS staged, count(*) FILTER (WHERE xy = ' M') AS modified, count(*) FILTER (WHERE xy = '??') AS untracked, count(*) FILTER (WHERE xy = 'UU') AS conflicted, count(*) FILTER (WHERE xy = '!!') AS ignored, count(*) FILTER (WHERE xy <> '!!') = 0 AS is_clean FROM s GROUP BY l_orderkey", "records")
def status_summary(spark, sf_dir):
    """Staged, modified, untracked, conflicted and ignored files of each repository."""
    return P.status_summary(P.status(_status(spark, sf_dir)), "l_orderkey")


@query("status_rows", STATUS_SQL + "SELECT l_orderkey, xy[1] AS index_status, xy[2] AS worktree_status, 'f/' || l_partkey AS path, CASE WHEN xy = 'R ' THEN 'old' || l_partkey END AS original_path FROM s", "records")
def status_rows(spark, sf_dir):
    """Files of each repository with both status letters and, if renamed, their old path."""
    return P.status(_status(spark, sf_dir)).drop("line_number")


@query("status_branches", "SELECT DISTINCT l_orderkey, 'b/' || l_orderkey AS branch, CASE WHEN l_orderkey % 3 <> 0 THEN 'origin/main' END AS upstream, CASE WHEN l_orderkey % 6 IN (2, 4) THEN CAST(l_orderkey % 9 + 1 AS INT) ELSE 0 END AS ahead, CASE WHEN l_orderkey % 6 IN (2, 4) THEN 2 ELSE 0 END AS behind FROM lineitem", "records")
def status_branches(spark, sf_dir):
    """The branch of each repository and how far it is from its upstream."""
    return P.status_branches(_status(spark, sf_dir)).drop("line_number")


@query("cherry_conflicts", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'content' ELSE 'modify/delete' END AS type, 'f/' || o_custkey AS file FROM orders WHERE o_orderkey % 3 <> 0", "records")
def cherry_conflicts(spark, sf_dir):
    """Conflicts from a tool's messages."""
    file = F.concat(F.lit("f/"), _s("o_custkey"))
    line = F.when(F.col("o_orderkey") % 3 == 0, "Auto-merging x").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CONFLICT (content): Merge conflict in "), file)).otherwise(F.concat(F.lit("CONFLICT (modify/delete): "), file, F.lit(" deleted in HEAD and modified in x")))
    return P.conflicts(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line_text")))


@query("cherry_picks", f"SELECT o_orderkey, {HASH} AS commit, left(md5(CAST(o_orderkey AS VARCHAR)), 7) AS short_commit, o_orderpriority AS subject FROM orders WHERE o_orderkey % 2 = 0", "records")
def cherry_picks(spark, sf_dir):
    """Picked commits from a tool's messages."""
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[main "), _hash(), F.lit("] "), F.col("o_orderpriority"))).otherwise("1 file changed")
    return P.picks(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line_text")))


@query("ps_parse", "SELECT CAST(event_id AS INT) AS pid, 'u' || user_id AS \"user\", round(value, 1) AS cpu, 0.5 AS memory, '0:01' AS time, 'cmd -x ' || event_type AS command, 'cmd' AS name FROM events", "records")
def ps_parse(spark, sf_dir):
    """Rows of process tables, with spaces in the command."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("u"), _s("user_id"), F.lit("  "), _s("event_id"), F.lit(" "), F.round("value", 1).cast("string"), F.lit(" 0.5 1 2 ? S 10:00 0:01 cmd -x "), F.col("event_type"))
    return P.processes(e.select(line.alias("line_text"))).select("pid", "user", "cpu", "memory", "time", "command", "name")


@query("lint_text_parse", "SELECT 'a:b/' || l_partkey || '.py' AS file, CAST(l_orderkey AS INT) AS line, l_linenumber AS \"column\", 'E' || (l_suppkey % 900 + 100) AS code, 'bad: ' || l_returnflag AS message FROM lineitem WHERE l_linenumber <> 7", "records")
def lint_text_parse(spark, sf_dir):
    """Diagnostics from lines of text; others are dropped."""
    l_ = table(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_linenumber") == 7, "All checks passed!").otherwise(F.concat(F.lit("a:b/"), _s("l_partkey"), F.lit(".py:"), _s("l_orderkey"), F.lit(":"), _s("l_linenumber"), F.lit(": E"), (F.col("l_suppkey") % 900 + 100).cast("string"), F.lit(" bad: "), F.col("l_returnflag")))
    return P.diagnostics(l_.select(line.alias("line_text")))


@query("time_parse", "SELECT event_id, CAST(event_id % 7 * 60 + event_id % 100 / 4.0 AS DOUBLE) AS mean, 0.25 AS user, 0.5 AS system, 0.0 AS stddev FROM events", "records")
def time_parse(spark, sf_dir):
    """Run times from a shell's report."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("real\t"), (F.col("event_id") % 7).cast("string"), F.lit("m"), (F.col("event_id") % 100 / 4).cast("string"), F.lit("s\nuser\t0m0.25s\nsys\t0m0.5s"))
    out = P.timings(text_lines(e.select("event_id", text.alias("text")), "text", "event_id"), "event_id")
    return out


@query("grep_text_parse", "SELECT 'src/' || user_id AS file, CAST(event_id AS INT) AS line_number, event_type || ':' || props AS match_line FROM events WHERE event_id % 5 <> 0", "records")
def grep_text_parse(spark, sf_dir):
    """file:line:text lines; those without a number are dropped."""
    line = F.concat(F.lit("src/"), _s("user_id"), F.lit(":"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(_s("event_id")), F.lit(":"), F.col("event_type"), F.lit(":"), F.col("props"))
    return P.grep_lines(table(spark, sf_dir, "events").select(line.alias("line_text")))


@query("ranked_dirs", "SELECT '/d/' || user_id AS path, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) / 2 ELSE 0.0 END AS score FROM events", "records")
def ranked_dirs(spark, sf_dir):
    """Ranked directories, with or without a score."""
    line = F.concat(F.when(F.col("event_id") % 2 == 0, F.concat((F.col("event_id") / 2).cast("decimal(12,1)").cast("string"), F.lit(" "))).otherwise(""), F.lit("/d/"), _s("user_id"))
    return P.ranked_paths(table(spark, sf_dir, "events").select(line.alias("line_text")))


@query("tree_parse", "SELECT '100644' AS mode, 'blob' AS type, md5(CAST(p_partkey AS VARCHAR)) AS hash, 'p/' || p_name AS path FROM part", "records")
def tree_parse(spark, sf_dir):
    """Entries of tree listings."""
    line = F.concat(F.lit("100644 blob "), F.md5(_s("p_partkey")), F.lit("\tp/"), F.col("p_name"))
    return P.tree(table(spark, sf_dir, "part").select(line.alias("line_text")))


# A diff of each order: one file, one hunk per line item, with a context line, a deletion (line numbers not divisible by
# 3) and an addition. Its lines are counted by hand in SQL.
def _diff_text(spark, sf_dir):
    l_ = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    n = _s("l_linenumber")
    at = (F.col("l_linenumber") * 10).cast("string")
    hunk = F.concat(F.lit("@@ -"), at, F.lit(",2 +"), at, F.lit(",2 @@\n same"), n, F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("\n--- old"), n)).otherwise(""), F.lit("\n+new"), n)
    body = _joined(l_, "l_orderkey", ["l_linenumber"], hunk)
    kind = F.when(F.col("l_orderkey") % 8 == 0, "new file mode 100644\n").otherwise("")
    name = F.concat(F.lit("f"), _s("l_orderkey"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"), kind, F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"))
    return body.select("l_orderkey", F.concat(head, "text").alias("diff"))


def _numbered(spark, sf_dir):
    lines = text_lines(_diff_text(spark, sf_dir), "diff", "l_orderkey").withColumnRenamed("line_number", "pos")
    return D.numbered_lines(lines, "l_orderkey")


ITEMS = "WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), "
NUMBERED = ITEMS + (
    "d AS (SELECT l_orderkey, n, 'context' AS type, 'same' || n AS content, n * 10 AS old_line_number, n * 10 AS new_line_number, 1 AS k FROM i UNION ALL SELECT l_orderkey, n, 'deletion', '-- old' || n, n * 10 + 1, NULL, 2 FROM i WHERE n % 3 <> 0 UNION ALL SELECT l_orderkey, n, 'addition', 'new' || n, NULL, n * 10 + 1, 3 FROM i) "
)


@query("diff_lines_numbered", NUMBERED + "SELECT l_orderkey, type, content, CAST(old_line_number AS BIGINT) AS old_line_number, CAST(new_line_number AS BIGINT) AS new_line_number FROM d", "diff")
def diff_lines_numbered(spark, sf_dir):
    """Lines of unified diffs with their numbers on both sides."""
    d = _numbered(spark, sf_dir)
    return d.select("l_orderkey", "type", "content", F.col("old_line_number").cast("long").alias("old_line_number"), F.col("new_line_number").cast("long").alias("new_line_number"))


@query("diff_totals", ITEMS + "j AS (SELECT 1) SELECT l_orderkey, CAST(1 AS BIGINT) AS files, count(*) AS hunks, count(*) AS additions, count(*) FILTER (WHERE n % 3 <> 0) AS deletions FROM i GROUP BY l_orderkey", "diff")
def diff_totals(spark, sf_dir):
    """Files, hunks, additions and deletions of each diff."""
    return D.totals(_numbered(spark, sf_dir), "l_orderkey")


@query("diff_truncate_lines", NUMBERED + "SELECT l_orderkey, type, content FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, k) AS r FROM d) WHERE r <= 4", "diff")
def diff_truncate_lines(spark, sf_dir):
    """The first lines of each file of a diff, over its hunks."""
    return D.first_lines(_numbered(spark, sf_dir), "l_orderkey", 4).select("l_orderkey", "type", "content")


@query("diff_change_types", ITEMS + "j AS (SELECT 1) SELECT CASE WHEN l_orderkey % 8 = 0 THEN 'added' ELSE 'modified' END AS change_type, count(DISTINCT l_orderkey) AS files FROM i GROUP BY 1", "diff")
def diff_change_types(spark, sf_dir):
    """Files by kind of change."""
    return _numbered(spark, sf_dir).groupBy("change_type").agg(F.countDistinct("file").alias("files"))


@query("semantic_diff_stats", ITEMS + "j AS (SELECT 1) SELECT l_orderkey, count(*) AS insertions, CAST(0 AS BIGINT) AS deletions FROM i GROUP BY l_orderkey", "diff")
def semantic_diff_stats(spark, sf_dir):
    """Insertions and deletions by the first characters alone, headers left out (so is a deleted line that begins --)."""
    return D.change_counts(text_lines(_diff_text(spark, sf_dir), "diff", "l_orderkey"), "l_orderkey")


BLAME = "WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem) SELECT l_orderkey, CAST(i AS INT) AS line_number, left(md5(CAST(l_orderkey AS VARCHAR)) || md5('x'), 40) AS commit_hash, left(md5(CAST(l_orderkey AS VARCHAR)), 7) AS short_commit, {author} AS author, strftime(to_timestamp(1700000000 + l_orderkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS date, ((1717200000 - 1700000000 - l_orderkey) // 2592000) || ' months ago' AS date_relative, 's' || l_orderkey AS summary, 'line ' || l_partkey AS line_text FROM x"


def _blame(spark, sf_dir):
    """Attribution of each order's file: a line for each line item, fields at the first line only."""
    w = Window.partitionBy("l_orderkey")
    i_ = table(spark, sf_dir, "lineitem").withColumns({"i": F.row_number().over(w.orderBy("l_linenumber", "l_partkey")), "n": F.count("*").over(w)})
    place = F.concat(F.expr("left(concat(md5(cast(l_orderkey as string)), md5('x')), 40)"), F.lit(" "), _s("i"), F.lit(" "), _s("i"))
    when = (F.lit(1700000000) + F.col("l_orderkey")).cast("string")
    fields = F.when(F.col("i") == 1, F.concat(F.lit(" "), _s("n"), F.lit("\nauthor clerk "), _s("l_orderkey"), F.lit("\nauthor-mail <c"), _s("l_orderkey"), F.lit("@x.org>\nauthor-time "), when, F.lit("\nsummary s"), _s("l_orderkey"))).otherwise("")
    line = F.concat(place, fields, F.lit("\n\tline "), _s("l_partkey"))
    return text_lines(_joined(i_, "l_orderkey", ["i"], line), "text", "l_orderkey").withColumnRenamed("line_number", "pos")


@query("blame_attribution", BLAME.format(author="'clerk ' || l_orderkey"), "diff")
def blame_attribution(spark, sf_dir):
    """Lines of porcelain attribution, whose fields stand at the first line of a group only."""
    return P.blame(_blame(spark, sf_dir), "l_orderkey", now=F.lit(1717200000)).drop("author_time")


@query("blame_addresses", BLAME.format(author="'c' || l_orderkey || '@x.org'"), "diff")
def blame_addresses(spark, sf_dir):
    """Attribution by address."""
    return P.blame(_blame(spark, sf_dir), "l_orderkey", emails=True, now=F.lit(1717200000)).drop("author_time")


@query("blame_truncated", "SELECT l_orderkey, CAST(i AS INT) AS line_number, n > 3 AS truncated FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE i <= 3", "diff", (Param("most", "integer", 3, minimum=1),))
def blame_truncated(spark, sf_dir, most=3):
    """The first lines of each file's attribution, and whether there are more."""
    return S.cap_in_groups(P.blame(_blame(spark, sf_dir), "l_orderkey").select("l_orderkey", "line_number"), "l_orderkey", ["line_number"], most)


@query("blame_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events", "diff")
def blame_forward_fill(spark, sf_dir):
    """Each row with the last header before it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("signup_id"))


AGO = "CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago' WHEN s < 604800 THEN (s // 86400) || ' days ago' WHEN s < 2592000 THEN (s // 604800) || ' weeks ago' WHEN s < 31536000 THEN (s // 2592000) || ' months ago' ELSE (s // 31536000) || ' years ago' END"


@query("relative_date_bucket", f"WITH a AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-06-01') AS BIGINT) - CAST(event_id * event_id % 100000000 AS BIGINT) AS t FROM events), b AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-06-01') AS BIGINT) - t AS s FROM a) SELECT event_id, {AGO} AS ago FROM b", "diff")
def relative_date_bucket(spark, sf_dir):
    """How long ago, in words."""
    now = F.lit(1717200000)
    then = now - F.col("event_id") * F.col("event_id") % 100000000
    return table(spark, sf_dir, "events").select("event_id", relative_date(then, now).alias("ago"))


def _shown(spark, sf_dir):
    """What is shown for each order, by its number: a commit, a tag, a tree or a file."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    own = F.concat_ws("\n", F.lit(P.COMMIT_START), _hash(), F.expr("left(md5(cast(o_orderkey as string)), 7)"), F.concat(F.lit("order "), _s("o_orderkey")), F.lit(P.COMMIT_META), F.lit("Ann"), F.lit("<ann@x.org>"), F.lit("Bob"), F.concat(F.lit("<b"), _s("o_custkey"), F.lit("@x.org>")), F.lit("2024-01-01"), F.lit("a day ago"), F.lit("2024-01-02"), F.lit(P.COMMIT_END))
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda i: F.concat(i.cast("string"), F.lit("\t2\tf"), i.cast("string"))), "\n")
    tag = F.concat(F.lit("tag v"), _s("o_orderkey"), F.lit("\nTagger: Ann <ann@x.org>\nDate:   2024-01-01\n\nrelease "), "o_orderpriority", F.lit("\nmore\n\ncommit "), F.md5(_s("o_custkey")), F.lit(" (tag: x)\nAuthor: Ann\n"))
    tree = F.concat(F.lit("100644 blob "), F.md5(_s("o_orderkey")), F.lit("\tsrc/"), _s("o_custkey"))
    blob = F.concat(F.lit("first\nsecond "), "o_orderpriority", F.lit("\nthird"))
    return o.select("o_orderkey", F.when(k == 0, F.concat(own, F.lit("\n\n"), numbers)).when(k == 1, tag).when(k == 2, tree).otherwise(blob).alias("shown"))


@query("show_kinds", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'tag' WHEN 2 THEN 'tree' ELSE 'blob' END AS type FROM orders", "records")
def show_kinds(spark, sf_dir):
    """What each shown object is, by its text."""
    return _shown(spark, sf_dir).select("o_orderkey", P.shown_kind(F.col("shown")).alias("type"))


SHOWN = f"SELECT o_orderkey, {HASH} AS hash, left(md5(CAST(o_orderkey AS VARCHAR)), 7) AS short_hash, 'order ' || o_orderkey AS subject, '' AS body, {{author}} AS author, {{committer}} AS committer, '2024-01-01' AS date, 'a day ago' AS date_relative, '2024-01-02' AS committer_date, CAST(least(n, 3) AS INT) AS files, CAST(CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 3 ELSE 6 END AS BIGINT) AS insertions, CAST(2 * least(n, 3) AS BIGINT) AS deletions, n > 3 AS truncated FROM (SELECT *, o_orderkey % 5 + 1 AS n FROM orders WHERE o_orderkey % 4 = 0)"


@query("show_commit", SHOWN.format(author="'Ann'", committer="'Bob'"), "records", (Param("most_files", "integer", 3, minimum=1),))
def show_commit(spark, sf_dir, most_files=3):
    """Shown commits, with the totals of their first files."""
    return P.shown_commits(_shown(spark, sf_dir), "shown", "o_orderkey", most_files=most_files)


@query("show_commit_addresses", SHOWN.format(author="'ann@x.org'", committer="'b' || o_custkey || '@x.org'"), "records")
def show_commit_addresses(spark, sf_dir):
    """Shown commits by address."""
    return P.shown_commits(_shown(spark, sf_dir), "shown", "o_orderkey", emails=True, most_files=3)


@query("show_tag", "SELECT o_orderkey, true AS annotated, 'v' || o_orderkey AS name, 'Ann <ann@x.org>' AS tagger, '2024-01-01' AS date, 'release ' || o_orderpriority || chr(10) || 'more' AS message, 'release ' || o_orderpriority AS annotation, md5(CAST(o_custkey AS VARCHAR)) AS object FROM orders WHERE o_orderkey % 4 = 1", "records")
def show_tag(spark, sf_dir):
    """Headers of shown tags."""
    own = _shown(spark, sf_dir)
    return P.shown_tags(own.where(P.shown_kind(F.col("shown")) == "tag"), "shown", "o_orderkey")


@query("show_blob", "SELECT o_orderkey, CAST(19 + length(o_orderpriority) AS INT) AS size, 'first|second ' || o_orderpriority AS lines, true AS truncated FROM orders WHERE o_orderkey % 4 = 3", "records", (Param("most_lines", "integer", 2, minimum=1),))
def show_blob(spark, sf_dir, most_lines=2):
    """The first lines of shown files."""
    out = P.shown_blobs(_shown(spark, sf_dir), "shown", "o_orderkey", most_lines=most_lines)
    return out.select("o_orderkey", "size", F.array_join("lines", "|").alias("lines"), "truncated")


@query("show_tree", "SELECT o_orderkey, '100644' AS mode, 'blob' AS type, md5(CAST(o_orderkey AS VARCHAR)) AS hash, 'src/' || o_custkey AS path FROM orders WHERE o_orderkey % 4 = 2", "records")
def show_tree(spark, sf_dir):
    """Entries of shown trees."""
    own = _shown(spark, sf_dir)
    return P.tree(text_lines(own.where(P.shown_kind(F.col("shown")) == "tree"), "shown", "o_orderkey").drop("line_number"))


@query("show_short", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'blob' ELSE 'commit' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN left(md5(CAST(o_orderkey AS VARCHAR)), 7) ELSE '' END AS short_hash, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS subject FROM orders", "records")
def show_short(spark, sf_dir):
    """Commits in one line, contents and nothing, told apart."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("\n"), F.expr("left(md5(cast(o_orderkey as string)), 7)"), F.lit(" "), "o_orderpriority", F.lit("\n"))).when(k == 1, "\n \n").otherwise(F.concat(F.lit("x = "), "o_orderpriority"))
    return P.shown_short(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "o_orderkey")


@query("stash_blocks", "SELECT o_orderkey, CAST(o_orderkey % 50 AS INT) AS \"index\", CASE WHEN o_orderkey % 2 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) ELSE '' END AS hash, 'On ' || o_orderstatus || ': ' || o_orderpriority AS message, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-01' ELSE '' END AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'a day ago' ELSE '' END AS date_relative FROM orders", "records")
def stash_blocks(spark, sf_dir):
    """Stashes from blocks between marks, or from plain lines where there are none."""
    name, message = F.concat(F.lit("stash@{"), (F.col("o_orderkey") % 50).cast("string"), F.lit("}")), F.concat(F.lit("On "), "o_orderstatus", F.lit(": "), "o_orderpriority")
    block = F.concat_ws("\n", F.lit(P.STASH_START), name, F.md5(_s("o_orderkey")), message, F.lit("2024-01-01"), F.lit("a day ago"), F.lit(P.STASH_END))
    text = F.when(F.col("o_orderkey") % 2 == 0, block).otherwise(F.concat(name, F.lit(": "), message))
    return P.stash_blocks(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "o_orderkey")


@query("stash_show", "SELECT l_orderkey, 'f/' || l_partkey AS path, CAST(l_quantity AS INT) AS additions, l_linenumber AS deletions FROM lineitem", "records")
def stash_show(spark, sf_dir):
    """Files of shown stashes."""
    line = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), _s("l_linenumber"), F.concat(F.lit("f/"), _s("l_partkey")))
    return P.numstat(table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line_text"))).select("l_orderkey", "path", "additions", "deletions")


@query("remote_show", "SELECT s_suppkey, 'r' || s_suppkey AS name, 'https://h/' || s_suppkey AS fetch_url, CASE WHEN s_suppkey % 2 = 0 THEN 'ssh://h/' || s_suppkey END AS push_url, 'main' AS head_branch, 'main:tracked,b' || s_nationkey || ':' || CASE s_suppkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'new' ELSE 'tracked' END AS branches FROM supplier", "records")
def remote_show(spark, sf_dir):
    """Shown remotes with their branches."""
    k = F.col("s_suppkey") % 3
    state = F.when(k == 0, "stale (use 'git remote prune' to remove)").when(k == 1, "new (next fetch will store in remotes/r)").otherwise("tracked")
    push = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  Push  URL: ssh://h/"), _s("s_suppkey"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("* remote r"), _s("s_suppkey"), F.lit("\n  Fetch URL: https://h/"), _s("s_suppkey"), F.lit("\n"), push, F.lit("  HEAD branch: main\n  Remote branches:\n    main    tracked\n    b"), _s("s_nationkey"), F.lit("   "), state, F.lit("\n  Local branches configured for 'git pull':\n    main merges with remote main\n"))
    out = P.head_and_branches(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text", "s_suppkey")
    word = lambda b: F.concat(b["name"], F.lit(":"), F.when(b["stale"], "stale").when(b["new"], "new").when(b["tracked"], "tracked"))
    return out.select("s_suppkey", "name", "fetch_url", "push_url", "head_branch", F.array_join(F.transform("tracked_branches", word), ",").alias("branches"))


@query("remote_urls", "SELECT s_suppkey, 'https://h/' || s_suppkey AS fetch_url, CASE WHEN s_suppkey % 2 = 0 THEN 'ssh://h/' || s_suppkey END AS push_url FROM supplier", "records")
def remote_urls(spark, sf_dir):
    """Both addresses of remotes, where there are two."""
    text = F.concat(F.lit("https://h/"), _s("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("\nssh://h/"), _s("s_suppkey"))).otherwise(""), F.lit("\n"))
    return P.remote_urls(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text", "s_suppkey", both=True)


@query("cherry_flags", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS has_conflicts, o_orderkey % 3 = 1 AS in_progress FROM orders", "records")
def cherry_flags(spark, sf_dir):
    """Which picks met conflicts, and which wait to be resolved."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "").when(k == 1, "error: could not apply abc1234\nhint: after resolving the conflicts").otherwise("CONFLICT (content): Merge conflict in x")
    return P.pick_flags(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "o_orderkey")


@query("tags_truncated", "SELECT p_brand, name, n > 20 AS truncated FROM (SELECT p_brand, 'v' || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY 'v' || p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE i <= 20", "records", (Param("most", "integer", 20, minimum=1),))
def tags_truncated(spark, sf_dir, most=20):
    """The first tags of each repository, and whether there are more."""
    tags = P.tags(table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("v"), _s("p_partkey"), F.lit("    "), "p_name").alias("line_text")))
    return S.cap_in_groups(tags.select("p_brand", "name"), "p_brand", ["name"], most)


@query("branches_truncated", "SELECT c_nationkey, name, n > 10 AS truncated FROM (SELECT c_nationkey, 'b/' || c_custkey AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'b/' || c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i <= 10", "records", (Param("most", "integer", 10, minimum=1),))
def branches_truncated(spark, sf_dir, most=10):
    """The first branches of each repository, and whether there are more."""
    line = F.concat(F.lit("  b/"), _s("c_custkey"), F.lit("  "), F.expr("left(md5(cast(c_custkey as string)), 8)"), F.lit(" "), "c_mktsegment")
    own = P.branches(table(spark, sf_dir, "customer").select("c_nationkey", line.alias("line_text")))
    return S.cap_in_groups(own.select("c_nationkey", "name"), "c_nationkey", ["name"], most)


@query("tree_truncated", "SELECT l_suppkey, '100644' AS mode, CASE WHEN l_partkey % 2 = 0 THEN 'tree' ELSE 'blob' END AS type, md5(CAST(l_partkey AS VARCHAR)) AS hash, 'p/' || l_partkey AS path, n > 10 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE i <= 10", "records", (Param("most", "integer", 10, minimum=1),))
def tree_truncated(spark, sf_dir, most=10):
    """The first entries of each supplier's tree, and whether there are more."""
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    line = F.concat(F.lit("100644 "), F.when(F.col("l_partkey") % 2 == 0, "tree").otherwise("blob"), F.lit(" "), F.md5(_s("l_partkey")), F.lit("\tp/"), _s("l_partkey"))
    return P.shown_trees(_joined(parts, "l_suppkey", ["l_partkey"], line), "text", "l_suppkey", most=most)


@query("tags_verified", "SELECT o_custkey, 'v' || max(o_orderkey) AS latest, count(*) AS tags, max(o_orderkey % 3) > 0 AND arg_max(o_orderkey % 3, o_orderkey) > 0 AS verified FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY 1", "records")
def tags_verified(spark, sf_dir):
    """Whether each customer's latest tag is among the verified ones; every third order's name is followed by a remark."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct()
    line = F.concat(F.lit("v"), _s("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, " unsigned").otherwise(" "), F.lit("\n"))
    latest = o.groupBy("o_custkey").agg(F.concat(F.lit("v"), F.max("o_orderkey").cast("string")).alias("latest"))
    found = P.verified_tags(_joined(o, "o_custkey", ["o_orderkey"], line).join(latest, "o_custkey"), "text", "latest", "o_custkey", "latest")
    return found.select("o_custkey", "latest", F.size("tags").cast("long").alias("tags"), "verified")


@query("stashes_truncated", "SELECT o_custkey, \"index\", message, n > 5 AS truncated FROM (SELECT o_custkey, CAST(o_orderkey AS INT) AS \"index\", 'On ' || o_orderstatus AS message, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i <= 5", "records", (Param("most", "integer", 5, minimum=1),))
def stashes_truncated(spark, sf_dir, most=5):
    """The first stashes of each customer, and whether there are more."""
    line = F.concat(F.lit("stash@{"), _s("o_orderkey"), F.lit("}: On "), F.col("o_orderstatus"))
    own = P.stashes(table(spark, sf_dir, "orders").select("o_custkey", line.alias("line_text")))
    return S.cap_in_groups(own, "o_custkey", ["index"], most)


@query("diff_truncate_files", "SELECT l_suppkey, file, n > 5 AS truncated FROM (SELECT l_suppkey, 'f' || l_orderkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE i <= 5", "diff", (Param("most", "integer", 5, minimum=1),))
def diff_truncate_files(spark, sf_dir, most=5):
    """The first files of each supplier's diff, and whether there are more."""
    orders = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    name = F.concat(F.lit("f"), _s("l_orderkey"))
    one = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1,2 @@\n same\n+diff --git a/x b/x"))
    diffs = _joined(orders, "l_suppkey", ["l_orderkey"], one)
    return D.first_files(text_lines(diffs, "text", "l_suppkey").withColumnRenamed("line_number", "pos"), "l_suppkey", most)


@query("diff_line_budget", ITEMS + "h AS (SELECT l_orderkey, n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS BIGINT) AS hunk, CASE WHEN n % 3 <> 0 THEN 3 ELSE 2 END AS lines FROM i), c AS (SELECT *, coalesce(sum(lines) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT l_orderkey, hunk, '@@ -' || n * 10 || ',2 +' || n * 10 || ',2 @@' AS header, CAST(greatest(0, least(lines, 4 - before)) AS BIGINT) AS lines, lines > greatest(0, 4 - before) AS truncated FROM c", "diff", (Param("most", "integer", 4, minimum=0),))
def diff_line_budget(spark, sf_dir, most=4):
    """How many lines of each hunk are within its file's budget; headers of emptied hunks stay."""
    return D.line_budget(_numbered(spark, sf_dir), "l_orderkey", most)
