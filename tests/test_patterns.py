"""Search and replacement by line against splitting first, for patterns that look beyond what they match."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import pattern, required_word
from textloom.operators import replace as R
from textloom.operators import search as S
from textloom.sources.tables import text_lines

TEXTS = ["foo\nbar", "foo bar\nfoo", "bar\r\nfoo\r\n", "", "\n\n", "a\uffffb foo\ufffe\uffff\n\ufffe\ufffefoo", "foo\u2028bar\u0085x", "Foo FOO foofoo\nbar foo bar", None, "tab\tfoo\n  foo  \nx", "1foo2\n_foo_\nfoo-1", "é foo é\nßfoo"]
PATTERNS = [
    "foo", r"foo(?!\s)", r"foo(?=\s)", r"foo(?! )", r"(?<!\s)foo", r"(?<=\s)foo", r"\Afoo", r"\Abar", r"foo\z", r"foo\Z", "^foo", "^bar", "foo$", "bar$", "^$", "^foo$", r"\bfoo\b", r"\Bfoo",
    r"foo\s", r"\sfoo", r"foo\S", r"foo[^a]", r"foo[\s\S]", r"foo.", r".foo", "fo+", "(foo)+", "foo|bar", "(?:foo|bar) ", "f(o)o", r"(f)(oo)", "(?i)foo", "(?-i)foo", "[fF]oo", r"foo{1}", "(foo)?bar", "x?foo", r"\uffff", r"\ufffe+", "a.b", r"foo(?=.bar)",
    r"foo(?:$|\s)", r"(?:^|\s)foo", r"(?!foo)bar", r"(?<!^)foo", r"[^\n]foo", r"foo\W", r"\wfoo", r"foo(?!$)", r"\Qfoo\E", "(?x) f o o", r"foo\r", r"o(?=\ufffe)", r"\x66oo",
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()


def split_first(files):
    return text_lines(files, "text", "id")


def some(rows):
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("at", range(0, len(PATTERNS), 18))
def test_patterns_find_what_splitting_first_finds(files, at):
    lines = split_first(files).cache()
    for regex in PATTERNS[at : at + 18]:
        p = pattern(regex)
        want = some(S.search(lines, p).select("id", "line_number", "line_text", "column_start", "column_end", "match_text"))
        got = some(S.search_files(files, p).select("id", "line_number", "line_text", "column_start", "column_end", "match_text"))
        assert got == want, regex
        total = S.summary(files, p).first()
        assert (total.total_matches, total.files_with_matches, total.files_searched) == (len(want), len({r[0] for r in want}), len(TEXTS)), regex


def test_required_words():
    assert required_word(pattern("[Tt]h[a-z]+tion")) == "tion"
    assert required_word(pattern("on", word=True)) == "on"
    assert required_word(pattern("a.b c", literal=True)) == "b c"
    for regex in ("foo|bar", "(?i)foo", "(foo)?", r"\Qa\E", "(?x) a b", r"\x66", "(?=foo)"):
        assert required_word(pattern(regex)) is None, regex
    assert required_word(pattern("foo", ignore_case=True)) is None


def test_replacements_where_texts_have_the_marks(files):
    for regex, new in (("foo", "X"), ("(fo)(o)", "$2\ufffe$1$1"), ("\ufffe", "[$0$0]"), ("\uffff", "\uffff\ufffe\uffff"), ("o", "")):
        rows = R.replacements(files, pattern(regex), new).collect()
        by_line = {}
        for r in rows:
            by_line.setdefault((r.id, r.line_number), []).append(r)
        lines = {(r.id, r.line_number): r.line_text for r in split_first(files).collect()}
        changed = {(r.id, r.line_number): r.new for r in split_first(files).withColumn("new", F.regexp_replace("line_text", pattern(regex), new)).collect()}
        for key, line in lines.items():
            raw, out, at = line.encode(), b"", 0
            for r in sorted(by_line.get(key, []), key=lambda r: r.column_start):
                assert raw[r.column_start : r.column_end].decode() == r.original_text
                out, at = out + raw[at : r.column_start] + r.replaced_text.encode(), r.column_end
            assert (out + raw[at:]).decode() == changed[key], (regex, line)


def test_nearest_lines_of_a_long_file(spark):
    hits = {3, 4, 900, 2001, 4999}
    text = "\n".join("hit" if i in hits else "x" for i in range(1, 5001))
    got = {r.line_number: (r.match_line, r.side) for r in S.nearest_in_file(spark.createDataFrame([(1, text)], "id int, text string"), pattern("^hit$")).collect()}
    for n in range(1, 5001):
        near = min(sorted(hits), key=lambda h: abs(h - n))
        assert (n in got) == (n not in hits)
        assert n in hits or got[n] == (near, "before" if n < near else "after")


def test_multiline_anchors(spark):
    files = spark.createDataFrame([(1, "foo\nbar\nfoo bar\r\n"), (2, "x")], "id int, text string")
    found = {r: S.search(files, pattern(r, multiline=True), "text").count() for r in ("^bar", "^bar$", "foo$.^bar", "bar$", r"\Abar", "^ba.*ba")}
    assert found == {"^bar": 1, "^bar$": 1, "foo$.^bar": 1, "bar$": 1, r"\Abar": 0, "^ba.*ba": 1}
