"""Parsers, parameters and the registry on small inputs made by hand."""

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from textloom.functions.text import clean_path, glob, leading_int, pattern, relative_date, replacement
from textloom.operators import compose, diff, discovery, jsonq, records, replace, rollup, search, tabular
from textloom.plans import by_category, find, registry, run, select
from textloom.plans.params import InvalidArgument, Param, bind
from textloom.sources.tables import json_document, json_records, text_lines


def lines(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts, 1)], "source string, pos int, line_text string")


def test_params_report_all_problems():
    params = (Param("n", "integer", required=True, minimum=1), Param("kind", "string", enum=("a", "b")), Param("text", "string", max_length=2))
    with pytest.raises(InvalidArgument) as e:
        bind(params, {"n": 0, "kind": "c", "text": "abc", "other": 1})
    assert str(e.value).count(";") == 3
    assert bind(params, {"n": 2}) == {"n": 2, "kind": None, "text": None}
    with pytest.raises(InvalidArgument):
        bind(params, {"n": True})


def test_registry(spark, sf_dir):
    assert "search_regex" in by_category()["search"]
    assert find("BYTE OFFSETS") == ["search_regex"]
    assert {q.name for q in select(category="diff", least="stable")} <= set(registry.QUERIES)
    with pytest.raises(KeyError):
        run(spark, "nothing", sf_dir)
    with pytest.raises(InvalidArgument):
        run(spark, "file_view_range", sf_dir, first=0)
    with pytest.raises(ValueError):
        registry.query("search_regex")(lambda spark, sf_dir: None)
    assert run(spark, "file_view_range", sf_dir, first=1, last=1).select("line_number").distinct().count() == 1


def test_patterns(spark):
    with pytest.raises(ValueError):
        pattern("(")
    assert pattern("a.b", literal=True) == r"a\.b"
    assert pattern(r"\p{L}+") == r"\p{L}+"
    assert pattern("a.b", literal=True, multiline=True, ignore_case=True) == r"(?i)a\.b"
    df = spark.createDataFrame([("x ($1) y",)], "t string")
    assert df.select(F.regexp_replace("t", pattern("($1)", literal=True), replacement("$2\\", literal=True))).first()[0] == "x $2\\ y"


def test_globs(spark):
    cases = {"*.py": ("a.py", "x/b.py", "a.pyc"), "src/**/t?.txt": ("src/t1.txt", "src/a/b/t2.txt", "src/t12.txt"), "{a,b}/[!x]*": ("a/y1", "b/z", "a/x"), "**/d/*": ("d/f", "q/d/f", "d/e/f")}
    for g, names in cases.items():
        df = spark.createDataFrame([(n,) for n in names], "p string")
        assert [r.p for r in df.where(F.col("p").rlike(glob(g))).collect()] == list(names[:2]), g


def test_sizes_and_times(spark):
    files = spark.createDataFrame([("a/b.txt", 1000, 50), (".h/c", 5, 1), ("d/", 0, 99), ("a/e.txt", 1001, 99)], "path string, size long, modified long")
    names = lambda **k: [r.path for r in discovery.find(files, now=F.lit(100), **k).collect()]
    assert names() == ["a/b.txt", "d/", "a/e.txt"] and names(hidden=True, size="5b") == [".h/c"]
    assert names(size="+1k") == ["a/b.txt", "a/e.txt"] and names(size="-1k") == ["a/b.txt", "d/"]
    assert names(changed_within="10s") == ["d/", "a/e.txt"] and names(changed_before="10s") == ["a/b.txt"]
    assert names(kind="directory") == ["d/"] and names(max_depth=1) == ["d/"] and names(extension="txt", exclude=("**/e*",)) == ["a/b.txt"]
    for bad in ({"size": "big"}, {"changed_within": "soon"}):
        with pytest.raises(ValueError):
            names(**bad)


def test_all_replacements_of_a_line(spark):
    files = spark.createDataFrame([(1, "foobar foobar\n\u00e9 foo foobar"), (2, "foo"), (3, None), (4, "")], "k int, text string")
    got = [tuple(r) for r in replace.replacements(files, "foo(?=bar)", "X").collect()]
    assert got == [(1, 1, 0, 3, "foo", "X"), (1, 1, 7, 10, "foo", "X"), (1, 2, 7, 10, "foo", "X")]
    assert [tuple(r) for r in replace.replacements(files, "(fo)o(b?)", "$2$1", most=2).collect()] == [(1, 1, 0, 4, "foob", "bfo"), (1, 1, 7, 11, "foob", "bfo"), (2, 1, 0, 3, "foo", "fo")]
    got = {r.k: r for r in replace.change_manifest(files, "k", "foo", "X", most_files=3).collect()}
    assert set(got) == {1, 2, 3} and got[1].replacements_count == 4 and got[1].truncated and len(got[1].preview) == 2
    assert replace.change_manifest(files, "k", "zzz", "X").where("replacements is not null or preview is not null or modified or truncated").count() == 0


def test_context_within_a_row(spark):
    files = spark.createDataFrame([(1, "a\nx1\r\nb\nc\nx2"), (2, "none"), (3, None)], "k int, text string")
    got = [tuple(r) for r in search.with_context(files, "^x", 2, 1).collect()]
    assert got == [(1, 2, "x1", ["a"], ["b"]), (1, 5, "x2", ["b", "c"], [])]
    assert tuple(search.summary(files, "^x").first()) == (2, 1, 3)
    assert [tuple(r) for r in search.nearest_in_file(files, "^x").collect()] == [(1, 1, 2, "before"), (1, 3, 2, "after"), (1, 4, 5, "before")]
    assert [tuple(r) for r in search.matching_lines(files, "^x", most=1).collect()] == [(1, 2, "x1")]


def test_median_and_places_of_distributed_columns(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9)] + [("b", 2.0), ("b", None), ("c", None), (None, 7.0), ("d", 3.0), ("d", 3.0), ("d", 4.0)]
    got = {r.k: (r.n, r.nulls, r.median, r.distinct) for r in tabular.distributions(spark.createDataFrame(rows, "k string, x double"), "k").collect()}
    assert got == {"a": (4, 0, 3.0, 3), "b": (1, 1, 2.0, 1), "c": (0, 1, None, 0), None: (1, 0, 7.0, 1), "d": (3, 0, 3.0, 2)}
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    assert all(r.place == r.v + 1 for r in tabular.ranked(df, ["v"]).collect())
    assert [r.v for r in tabular.slice_rows(df, ["v"], 3, 5).orderBy("v").collect()] == [3, 4]


def test_commit_blocks(spark):
    text = f"junk{records.COMMIT_START}\nh1\ns1\nsubject\nbody\n\n{records.COMMIT_META}\nAnn\nBob\n2024\nnow\n{records.COMMIT_END}\n\n a b.txt | 2 +-\n a b.txt | 1 +\n 1 file changed, 2 insertions(+), 1 deletion(-)\n{records.COMMIT_START}\nh2\ns2\n\n{records.COMMIT_META}\nA\nB\nd\nr\n{records.COMMIT_END}\nx.txt\n{records.COMMIT_START}\ncut"
    got = records.commits(spark.createDataFrame([(1, text)], "k int, t string"), "t", "k").orderBy("pos").collect()
    assert [(r.hash, r.subject, r.body, r.author, r.committer, r.date_relative, r.files, r.insertions, r.deletions, r.files_changed) for r in got] == [("h1", "subject", "body", "Ann", "Bob", "now", 1, 2, 1, ["a b.txt"]), ("h2", "", "", "A", "B", "r", None, None, None, ["x.txt"])]


def test_shown_tag_without_annotation(spark):
    df = spark.createDataFrame([(1, "commit abc def\nAuthor: x"), (2, "tag v1\nTagger: T <t@x>\nDate:   d\n\nmsg\n\nmore\n\ncommit 123 (x)\n")], "k int, t string")
    got = records.shown_tags(df, "t", "k").orderBy("k").collect()
    assert (got[0].annotated, got[0].name, got[0].object) == (False, None, "abc")
    assert tuple(got[1])[1:] == (True, "v1", "T <t@x>", "d", "msg\n\nmore", "msg", "123")


def test_pipeline_stops_at_the_first_failure(spark):
    start = spark.createDataFrame([(1,), (2,)], "a int")
    more = lambda values, add=10: values.select((F.col("a") + add).alias("a"))
    got = compose.pipeline(start, [("one", more, "a", {}), ("two", more, "a", {"add": 100})])
    assert sorted(r.a for r in got.collect()) == [111, 112]
    own = spark.createDataFrame([(5,)], "a int")
    assert [r.a for r in compose.pipeline(start, [("one", more, "a", {"values": own})]).collect()] == [15]
    called = []
    with pytest.raises(compose.StepFailed, match="step two"):
        compose.pipeline(start, [("one", more, "a", {}), ("two", more, "missing", {}), ("three", lambda values: called.append(1), "a", {})])
    assert not called


def test_import_needs_no_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=ROOT, capture_output=True).returncode == 0


def test_offsets_are_bytes(spark):
    got = search.search(lines(spark, "é the", "none", "the the"), pattern("the")).select("column_start", "column_end", "match_text").collect()
    assert [tuple(r) for r in got] == [(3, 6, "the"), (0, 3, "the")]


def test_lines_keep_the_last_empty_one(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, "")], "k int, t string")
    assert [(r.k, r.line_number, r.line_text) for r in text_lines(df, "t", "k").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]


def test_diff_with_header_like_lines(spark):
    text = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -5 +5,2 @@ f
--- old
+++ new
 same
@@ -20,2 +21 @@
-a
-b
+c
diff --git a/y b/z
rename from y
rename to z""".split("\n")
    got = diff.numbered_lines(lines(spark, *text), "source").orderBy("pos").select("file", "hunk", "type", "content", "old_line_number", "new_line_number").collect()
    assert [tuple(r) for r in got] == [
        ("x", 1, "deletion", "-- old", 5, None),
        ("x", 1, "addition", "++ new", None, 5),
        ("x", 1, "context", "same", 6, 6),
        ("x", 2, "deletion", "a", 20, None),
        ("x", 2, "deletion", "b", 21, None),
        ("x", 2, "addition", "c", None, 21),
    ]


def test_blame_carries_fields_within_a_group(spark):
    a, b = "a" * 40, "b" * 40
    text = [f"{a} 1 1 2", "author Ann", "summary one", "\tx", f"{a} 2 2", "\ty", f"{b} 1 3 1", "author Bob", "\tz", f"{a} 9 4 1", "\tw"]
    got = records.blame(lines(spark, *text), "source").orderBy("line_number").select("line_number", "author", "summary", "line_text").collect()
    assert [tuple(r) for r in got] == [(1, "Ann", "one", "x"), (2, "Ann", "one", "y"), (3, "Bob", "", "z"), (4, "", "", "w")]


def test_status_and_conflicts(spark):
    rows = records.status(lines(spark, "## main", "R  a -> b", " M c", "?? d", "AA e"))
    got = rows.orderBy("pos").select("index_status", "worktree_status", "path", "original_path").collect()
    assert [tuple(r) for r in got] == [("R", " ", "b", "a"), (" ", "M", "c", None), ("?", "?", "d", None), ("A", "A", "e", None)]
    assert tuple(records.status_summary(rows, "source").first()) == ("s", 1, 1, 1, 1, 0, False)
    got = records.conflicts(lines(spark, "CONFLICT (content): Merge conflict in f x/y", "CONFLICT (modify/delete): q deleted in HEAD")).collect()
    assert [(r.type, r.file) for r in got] == [("content", "f x/y"), ("modify/delete", "q")]


def test_numstat_config_tags(spark):
    assert [tuple(r)[2:] for r in records.numstat(lines(spark, "1\t2\ta b", "-\t-\tbin", "x")).collect()] == [(1, 2, "a b")]
    got = records.config(lines(spark, "local:file:x\tk\tv=1", "o\tk\tv", "a=b=c", "bare")).select("key", "value", "scope", "origin").collect()
    assert [tuple(r) for r in got] == [("k", "v=1", "local", "file:x"), ("k", "v", None, "o"), ("a", "b=c", None, None), ("bare", None, None, None)]
    assert [(r.name, r.annotation) for r in records.tags(lines(spark, "v1    first one", "v2")).collect()] == [("v1", "first one"), ("v2", None)]


def test_branches(spark):
    got = records.branches(lines(spark, "* (HEAD detached at abc) 0123456 s", "  b  0123456 [o/b: ahead 1, behind 2] t u", "  r/HEAD -> o/b")).collect()
    assert [(r.name, r.current, r.remote, r.ahead, r.behind, r.subject) for r in got] == [("(HEAD detached at abc)", True, None, None, None, "s"), ("b", False, "o/b", 1, 2, "t u")]


def test_json_stream_takes_whole_tokens(spark):
    df = spark.createDataFrame([(1, '30 null\n{"a":\n "}"} [1,2]x 5'), (2, ""), (3, None)], "k int, t string")
    assert [(r.k, r.pos, r.value, r.complete) for r in jsonq.stream_values(df, "t").orderBy("k", "pos").collect()] == [(1, 1, "30", False), (1, 2, "null", False), (1, 3, '{"a":"}"}', False), (1, 4, "[1,2]", False)]


def test_json_sources(spark):
    df = spark.createDataFrame([('{"a":1}',), ("",), ("{",)], "line string")
    assert json_records(df, "line").count() == 1
    assert df.where("line = ''").select(json_document(F.col("line")).isNull().alias("n")).first().n
    with pytest.raises(Exception):
        df.select(json_document(F.col("line"))).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("12ab", "./a\\b"), ("x", "c")], "n string, p string")
    assert [tuple(r) for r in df.select(leading_int(F.col("n")), clean_path(F.col("p"))).collect()] == [(12, "a/b"), (None, "c")]
    ages = spark.createDataFrame([(0,), (59,), (60,), (3600,), (86400,), (604800,), (2592000,), (31536000,)], "s long")
    got = [r[0] for r in ages.select(relative_date(F.lit(0) - F.col("s"), F.lit(0))).collect()]
    assert got == ["just now", "just now", "1 minutes ago", "1 hours ago", "1 days ago", "1 weeks ago", "1 months ago", "1 years ago"]


def test_rollups(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, x int")
    assert {r.k: r.s for r in df.groupBy("k").agg(rollup.sum_or_null(F.col("x")).alias("s")).collect()} == {"a": None, "b": 2}
    assert df.where("false").agg(rollup.sum_or_null(F.col("x")).alias("s")).first().s == 0
    g = spark.createDataFrame([("a", 1), ("b", 7)], "k string, n int")
    assert {r.k: r.p for r in g.select("k", rollup.share_of_total(F.col("n")).alias("p")).collect()} == {"a": 12.5, "b": 87.5}


def test_greedy_budget(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate((5, 4, 9, 1, 3))] + [("b", 0, 11), ("b", 1, 10)], "k string, i int, c long")
    got = compose.greedy_budget(df, "k", "i", "c", 10).orderBy("k", "i").collect()
    assert [r.runs for r in got] == [True, True, False, True, False, False, True]


def test_trends(spark):
    rows = [("up", i, v) for i, v in enumerate((1.0, 1.0, 2.0, 2.0))] + [("few", 0, 1.0), ("flat", 0, 1.0)] + [("flat", i, 1.0) for i in range(1, 5)]
    got = compose.trends(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v").collect()
    assert {r.k: r.trend for r in got} == {"up": "degrading", "few": "insufficient_data", "flat": "stable"}


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "doc_id"
