"""Trees, verified tags, files of diffs, and sorted matches: odd rows."""

import pytest

from textloom.operators import diff as D
from textloom.operators import records as P
from textloom.operators import search as S


def test_trees_are_cut_with_a_flag(spark):
    text = "040000 tree abc\tsrc\n\n  100644 blob def\ta b.md \n120000 commit 1\tx\n100644 blob 123\tc"
    raw = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = lambda most: [tuple(r) for r in P.shown_trees(raw, "t", "id", most=most).collect()]
    assert got(3) == [(1, "040000", "tree", "abc", "src", False), (1, "100644", "blob", "def", "a b.md", False), (1, "100644", "blob", "123", "c", False)]
    assert got(1) == [(1, "040000", "tree", "abc", "src", True)]


def test_verified_tags(spark):
    rows = [(1, "v1\n\n v2 \n", " v2"), (2, "v1 x", "v1"), (3, None, "v"), (4, "v", None), (5, "", ""), (6, "v\nv", "v")]
    got = {r.id: (r.tags, r.verified) for r in P.verified_tags(spark.createDataFrame(rows, "id int, t string, n string"), "t", "n", "id").collect()}
    assert got == {1: (["v1", "v2"], True), 2: (["v1 x"], False), 3: ([], False), 4: (["v"], False), 5: ([], False), 6: (["v", "v"], True)}


def test_files_of_a_diff_are_no_lines_of_its_hunks(spark):
    lines = ["diff --git a/x b/x", "@@ -1 +1 @@", "+diff --git a/z b/z", "diff --git a/y b/y", "diff --git a/x b/x"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "s int, pos int, line_text string")
    assert [tuple(r) for r in D.first_files(df, "s", 2).orderBy("file").collect()] == [(1, "x", False), (1, "y", False)]
    assert [tuple(r) for r in D.first_files(df, "s", 1).collect()] == [(1, "x", True)]


def test_numbered_lines_of_a_second_file_start_anew(spark):
    text = "@@ -9 +9 @@\n lost\ndiff --git a/p b/q\nrename from p\n--- a/p\n+++ b/q\n@@ -3,2 +4 @@ f\n-new file\n same\ndiff --git a/n b/n\nnew file mode 1\n@@ -0,0 +1,2 @@\n+one\nnew file\n+two\n@@ -5 +8 @@\n-x\ndiff --git odd\n@@ -1 +1 @@\n+y"
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "s int, pos int, line_text string")
    got = [(r.file, r.change_type, r.hunk, r.type, r.content, r.old_line_number, r.new_line_number) for r in D.numbered_lines(df, "s").orderBy("pos").collect()]
    assert got == [
        ("q", "renamed", 1, "deletion", "new file", 3, None),
        ("q", "renamed", 1, "context", "same", 4, 4),
        ("n", "added", 1, "addition", "one", None, 1),
        ("n", "added", 1, "addition", "two", None, 2),
        ("n", "added", 2, "deletion", "x", 5, None),
        (None, "modified", 1, "addition", "y", None, 1),
    ]


@pytest.mark.parametrize("by, want", [("path", ["a1", "a2", "b1", "c1"]), ("modified", ["c1", "b1", "a1", "a2"]), ("created", ["a1", "a2", "b1", "c1"])])
def test_matches_sorted(spark, by, want):
    rows = [("a", 1, 5, 1), ("a", 2, 5, 1), ("b", 1, 4, 1), ("c", 1, None, 2)]
    df = spark.createDataFrame(rows, "path string, line_number int, modified int, created int")
    got = S.sorted_matches(df, by).orderBy("place").collect()
    assert [r.place for r in got] == [1, 2, 3, 4] and [f"{r.path}{r.line_number}" for r in got] == want


def test_unsorted_matches_have_no_place_and_bad_sorts_raise(spark):
    df = spark.createDataFrame([("a", 1)], "path string, line_number int")
    assert S.sorted_matches(df, "none").first().place is None
    with pytest.raises(ValueError):
        S.sorted_matches(df, "size")
