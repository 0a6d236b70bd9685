"""Changes between two versions against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import diff as D
from textloom.operators import versions as V
from textloom.sources.tables import text_lines

KIND = "id long, old string, new string"
ODD = [(None, None), (None, "a\nb"), ("a\nb", None), ("", ""), ("", None), (None, ""), ("", "a"), ("a\n", "a"), ("a", "a\n"), ("a\nb\n", "b\na\n"), ("x\nx\nx", "x"), ("\r\na", "a")]


def texts(seed, words, n=60):
    r = random.Random(seed)
    for _ in range(n):
        old = [r.choice(words) for _ in range(r.randrange(1, 30))]
        new = [x for x in old if r.random() > 0.2]
        for _ in range(r.randrange(4)):
            new.insert(r.randrange(len(new) + 1), r.choice(words))
        yield "\n".join(old), "\n".join(new) if new else None


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def lines(text):
    return [] if text is None else text.split("\n")


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [*ODD, *texts(1, ["a", "b"]), *texts(2, list("abcdefgh")), *texts(3, [f"w{i}" for i in range(500)])]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], KIND), rows


def test_changes_applied_give_the_new_text(pairs):
    df, rows = pairs
    got = V.apply_changes(V.compare(df, "old", "new"), "old").orderBy("id").collect()
    assert [r.patched for r in got] == [new for _, new in rows]


def test_changes_hold_no_equal_line_at_their_ends(pairs):
    for r in V.compare(pairs[0], "old", "new").collect():
        for c in r.changes:
            assert c.removed or c.added
            assert lines(r.old)[c.old_at : c.old_at + len(c.removed)] == c.removed
            assert lines(r.new)[c.new_at : c.new_at + len(c.added)] == c.added
            assert not (c.removed and c.added and (c.removed[0] == c.added[0] or c.removed[-1] == c.added[-1]))


def test_few_kinds_of_lines_change_as_little_as_can_be(spark):
    # No line stands once on both sides, so nothing is fixed beforehand.
    rows = [(a + "\n" + a, b + "\n" + b) for a, b in texts(4, ["a", "b", "c"], 40) if b]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], KIND)
    got = {r.id: r for r in V.counts(V.compare(df, "old", "new"), "id").collect()}
    for i, (a, b) in enumerate(rows):
        a, b = lines(a), lines(b)
        if any(a.count(x) == 1 and b.count(x) == 1 for x in a):
            continue
        n = common(a, b)
        assert (got[i].deletions, got[i].insertions) == (len(a) - n, len(b) - n)


@pytest.mark.parametrize("context", [0, 1, 3])
def test_unified_diff_read_back(pairs, context):
    df, rows = pairs
    diffs = V.unified(V.compare(df, "old", "new"), "old", F.concat(F.lit("f"), F.col("id").cast("string")), "id", context=context)
    got = D.numbered_lines(text_lines(diffs, "diff", "id").withColumnRenamed("line_number", "pos"), "id").collect()
    kinds = {r.id: r.change_type for r in got}
    for i, (old, new) in enumerate(rows):
        a, b = (lines(x[:-1] if x and x.endswith("\r") else x) for x in (old, new))
        own = sorted((r for r in got if r.id == i), key=lambda r: r.pos)
        assert bool(own) == (a != b)
        if a == b:
            continue
        assert kinds[i] == ("added" if old is None else "deleted" if new is None else "modified")
        for r in own:
            clean = lambda x: x.removesuffix("\r")
            if r.type != "addition":
                assert clean(a[r.old_line_number - 1]) == r.content
            if r.type != "deletion":
                assert clean(b[r.new_line_number - 1]) == r.content
        gone, come = {r.old_line_number for r in own if r.type == "deletion"}, {r.new_line_number for r in own if r.type == "addition"}
        assert [x for n, x in enumerate(a, 1) if n not in gone] == [x for n, x in enumerate(b, 1) if n not in come]
        near = {n for n in range(1, len(a) + 1) if n not in gone and any(abs(n - g) <= context for g in gone)}
        assert near <= {r.old_line_number for r in own if r.type == "context"} or context == 0


def test_long_texts_of_repeated_lines_end_soon():
    r = random.Random(5)
    a = [r.randrange(50) for _ in range(20_000)]
    b = [r.randrange(50) for _ in range(20_000)]
    began = time.time()
    found = V._matches(a, b)
    assert time.time() - began < 20
    assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
    assert len(found) > 3_000


def test_nothing_is_shuffled(spark, pairs):
    plan = V.apply_changes(V.compare(pairs[0], "old", "new"), "old")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    found = V.compare(none, "old", "new")
    assert V.apply_changes(found, "old").count() == 0
    assert V.unified(found, "old", F.lit("f"), "id").count() == 0
    assert V.counts(found, "id").count() == 0
