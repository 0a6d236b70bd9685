"""Expressions over JSON, batches and budgets, reachability, code and comments, ignore rules, streams with state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import compose as C
from textloom.operators.code import line_counts
from textloom.operators.ignore import rules_of, with_ignored
from textloom.operators.jsonexpr import compiled, evaluate
from textloom.sources.scratch import written
from textloom.streaming.state import last_runs

DOC = '{"a":[{"b":1,"t":"x"},{"b":2.5,"t":"y","z":null},{"t":"x"},7,"s"],"o":{"k":true,"a b":[10,20],"e":{}},"n":null,"s":"äö"}'


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (".", [DOC]), (".s", ['"äö"']), (".missing", ["null"]), (".a[1].b", ["2.5"]), ('.o."a b"[1]', ["20"]), (".a[] | .t", ['"x"', '"y"', '"x"', "null", "null"]), (".o[]", ["[10,20]", "{}", "true"]),
        (".a | length", ["5"]), (".s | length", ["2"]), (".n | length", ["0"]), (".o | keys", ['["a b","e","k"]']), (".a | keys", ["[0,1,2,3,4]"]), (".a | map(.b)", ["[1,2.5,null,null,null]"]),
        (".a[] | select(.b >= 2)", ['{"b":2.5,"t":"y","z":null}']), ('.a[] | select(.t == "x" and .b == 1) | .b', ["1"]), ('.a[] | select(.t == "y" or .b < 2) | .t', ['"x"', '"y"']),
        ('.a[] | select((.t == "x" or .t == "y") and .b != 1) | .t', ['"y"', '"x"']), (".a | map(select(.b)) | length", ["2"]), (".o | select(.k) | .e", ["{}"]), (".a[] | select(.z)", []), (".s[]", []), (".a | map(.t) | map(.) | length", ["5"]),
    ],
)
def test_expressions(spark, expression, want):
    rows = spark.createDataFrame([(1, DOC)], "id int, t string").select("id", F.parse_json("t").alias("record"))
    got = [x.value for x in evaluate(rows, expression).orderBy("pos").collect()]
    as_json = lambda xs: [json.loads(x) for x in xs]
    assert (as_json(got) if not expression.endswith("[]") else sorted(got)) == (as_json(want) if not expression.endswith("[]") else sorted(want))


def test_bad_expressions_raise_before_a_plan():
    for bad in ("", "|", ".a |", "select(.a", "map()", ".a[-1]", "foo", ".a b", "select(.a[] == 1)", "select(.a == )", ".a ? .b", "keys)"):
        with pytest.raises(ValueError, match="bad expression"):
            compiled(bad)


def test_global_budget_equals_the_loop(spark, monkeypatch):
    monkeypatch.setattr(C, "BUDGET_BLOCK", 40)
    r = random.Random(3)
    for n, most, budget in ((0, 5, 10), (300, 9, 200), (500, 60, 900), (200, 3, 10_000), (100, 50, 0), (150, 1, 20)):
        tasks = [(i * 3, r.randint(0, most)) for i in range(n)]
        used, want = 0, {}
        for i, c in tasks:
            want[i] = used + c <= budget
            used += c if want[i] else 0
        shuffled = r.sample(tasks, len(tasks))
        got = C.global_budget(spark.createDataFrame([*shuffled, (None, 1), (-5, None)], "i long, c long"), "i", "c", budget).collect()
        assert {x.i: x.runs for x in got if x.i is not None and x.c is not None} == want
        assert not any(x.runs for x in got if x.i is None or x.c is None)


def test_circles_end_and_depths_are_least(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("x", "y"), (None, "q"), ("d", None)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    starts = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    assert {tuple(x) for x in C.reachable(starts, edges, 9, written).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {x.node for x in C.reachable(starts, edges, 1, written).collect()} == {"a", "b", "c"}


def test_failing_tasks_are_rows_and_run_again(spark):
    ran = []

    def work(rows):
        ran.append({x.key for x in rows.collect()})
        return rows.withColumns({"result": F.when(F.col("v") > 0, F.col("v") * 2), "error": F.when(F.col("v") <= 0, "bad")})

    tasks = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 0), (4, None, 5)], "id int, key string, v int")
    first, cache = C.cached_batch(tasks, "key", work, None, written)
    assert {(x.id, x.result, x.error, x.from_cache) for x in first.collect()} == {(1, 2, None, False), (2, 2, None, False), (3, None, "bad", False), (4, 10, None, False)}
    more = tasks.union(spark.createDataFrame([(5, "c", 3)], tasks.schema))
    ran.clear()
    second, cache = C.cached_batch(more, "key", work, cache, written)
    assert {(x.id, x.from_cache) for x in second.collect()} == {(1, True), (2, True), (3, False), (4, False), (5, False)}
    assert ran[0] == {"b", "c"} and {x.key for x in cache.collect()} == {"a", "c"}


def test_a_run_is_counted_while_it_is_written(spark, tmp_path):
    log, df = str(tmp_path / "log"), spark.range(100).where("id % 3 = 0")
    for k in range(4):
        with C.Profiled(df, "threes", log, most=10 if k % 2 else None) as run:
            run.step("plan")
            run.rows.write.mode("overwrite").parquet(str(tmp_path / "out"))
            run.step("write")
    with pytest.raises(RuntimeError), C.Profiled(df, "fails", log):
        raise RuntimeError
    rows = spark.read.parquet(log).collect()
    assert len(rows) == 4 and {x.rows for x in rows} == {34} and sorted(x.truncated for x in rows) == [False, False, True, True]
    assert all([s.step for s in x.steps] == ["plan", "write"] and x.duration >= 0 for x in rows)
    trends = C.step_trends(spark.read.parquet(log), "skill", "began", "steps").collect()
    assert {(x.skill, x.step, x.n) for x in trends} == {("threes", "plan", 4), ("threes", "write", 4)}


def by_character(text):
    """Kinds of lines by reading one character after the other, C syntax."""
    state, line, out, i = "code", set(), [], 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if c == "\n":
            out.append(line)
            line, state = set(), state if state == "block" else "code"
            i += 1
            continue
        if state == "code" and two in ("/*", "//"):
            state, i = ("block" if two == "/*" else "line"), i + 2
            line.add("comment")
            continue
        if state == "block" and two == "*/":
            state, i = "code", i + 2
            line.add("comment")
            continue
        if state in "\"'" and c == "\\" and i + 1 < len(text) and text[i + 1] != "\n":
            i += 2
            continue
        if not c.isspace():
            line.add("comment" if state in ("block", "line") else "code")
        if state == "code" and c in "\"'":
            state = c
        elif state == c and c in "\"'":
            state = "code"
        i += 1
    if line or (text and text[-1] != "\n"):
        out.append(line)
    return tuple(sum(1 for x in out if k(x)) for k in (lambda x: True, lambda x: "code" in x, lambda x: x == {"comment"}, lambda x: not x))


def test_lines_of_code_equal_reading_characters(spark):
    r = random.Random(4)
    texts = ["", "x", "\n", "/* a\n\n b */ x\n", '"/*" // c\n', "/* never closed\n\nx", "'\"' /* ' */ y\n// \"\n/**/\n", '"a\\"/*b" c\n', "\n"]
    texts += ["".join(r.choice(["/*", "*/", "//", '"', "'", "\n", " ", "x", "\\", "*", "/", "\n\n"]) for _ in range(r.randint(1, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, "java", t) for i, t in enumerate(texts)], "id int, language string, text string")
    got = {x.id: (x.lines, x.code, x.comments, x.blanks) for x in line_counts(rows, "text", F.col("language")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == by_character(t), repr(t)


def test_other_languages_and_odd_texts(spark):
    rows = [(1, "Python", '"""doc # no\n# still text"""\n# c\nx = 1 # y\n'), (2, "sql", "-- c\nselect '--' /* a\nb */\n\n"), (3, "html", "<!-- a\nb --><p>\n"), (4, "unknown", "# text\n\n"), (5, None, "a"), (6, "java", None), (7, "c", "/* x\n" * 30_000 + "*/\n")]
    out = line_counts(spark.createDataFrame(rows, "id int, lang string, text string"), "text", F.col("lang"))
    got = {x.id: (x.lines, x.code, x.comments, x.blanks) for x in out.collect()}
    assert got == {1: (4, 3, 1, 0), 2: (4, 1, 2, 1), 3: (2, 1, 1, 0), 4: (2, 1, 0, 1), 5: (1, 1, 0, 0), 6: (0, 0, 0, 0), 7: (30_001, 0, 30_001, 0)}


def test_ignore_rules(spark):
    rules = [("", ["# top", "", "*.log", "!keep.log", "build/", "/only_top.txt", "docs/**/x.md", "a?c", "deep/**"]), ("src", ["*.txt", "!/a.txt", "!*.log"]), ("src/gen", ["*", "!ok.txt"]), ("vendor", ["!build/"])]
    lines = [(f, i, x) for f, xs in rules for i, x in enumerate(xs)]
    want = {
        "x.log": True, "keep.log": False, "src/x.log": False, "lib/y/z.log": True, "build/a": True, "build": False, "lib/build/b.txt": True, "only_top.txt": True, "lib/only_top.txt": False, "docs/x.md": True, "docs/a/b/x.md": True, "lib/docs/x.md": False,
        "abc": True, "a/c": False, "abbc": False, "deep/er/f": True, "deep": False, "src/a.txt": False, "src/b.txt": True, "src/q/a.txt": True, "src/gen/no.c": True, "src/gen/ok.txt": False, "vendor/build/f": False, "build/keep.log": True,
    }
    own = rules_of(spark.createDataFrame(lines, "folder string, place int, line string"))
    paths = spark.createDataFrame([(p,) for p in [*want, "x.log"]], "path string")
    got = with_ignored(paths, "path", own).collect()
    assert len(got) == len(want) + 1
    assert {x.path: x.ignored for x in got} == want


def test_state_survives_a_restart_and_equals_a_batch(spark, tmp_path):
    schema, r = "k string, at long, v string", random.Random(5)
    rows = [(r.choice(["a", "b", "c", None]), r.randint(0, 200), f"v{i}") for i in range(300)]
    source, target, seen = tmp_path / "in", tmp_path / "checkpoint", {}

    def keep(df, _):
        for x in df.collect():
            seen[x.key] = (x.runs, x.last)

    for part in range(3):  # each start goes on from what the one before left
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = last_runs(spark.readStream.schema(schema).parquet(str(source)), "k", "at", "v", 4)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(target)).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for k in ("a", "b", "c", None):
        own = sorted((at, v) for key, at, v in rows if key == k)
        want[k] = (len(own), ",".join(v for _, v in own[-4:]))
    assert seen == want
