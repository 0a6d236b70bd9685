"""Code, comments and blanks of source files, with block comments and strings told apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Syntax:
    """Marks of comments up to a line's end, pairs of marks of block comments, and of strings (those of one mark hold
    backslash escapes and end with the line; those of three go over lines)."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    text: tuple[str, ...] = ('"', "'")


_C = Syntax(("//",), (("/*", "*/"),))
# The marks of languages.
SYNTAXES = {
    "c": _C, "cpp": _C, "java": _C, "go": Syntax(("//",), (("/*", "*/"),), ('"', "'", "`")), "javascript": Syntax(("//",), (("/*", "*/"),), ('"', "'", "`")), "rust": Syntax(("//",), (("/*", "*/"),), ('"',)),
    "css": Syntax((), (("/*", "*/"),)), "python": Syntax(("#",), (), ('\"\"\"', "\'\'\'", '"', "'")), "shell": Syntax(("#",)), "ruby": Syntax(("#",), (("=begin", "=end"),)), "sql": Syntax(("--",), (("/*", "*/"),), ("'",)),
    "lua": Syntax(("--",), (("--[[", "]]"),)), "haskell": Syntax(("--",), (("{-", "-}"),), ('"',)), "html": Syntax((), (("<!--", "-->"),), ()), "xml": Syntax((), (("<!--", "-->"),), ()),
}
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"


def _pattern(syntax: Syntax) -> str:
    """Strings in group 1, comments in group 2: read from the left, each begins outside of the ones before. Nothing backtracks."""
    q = lambda x: "".join("\\" + c for c in x)
    strings = [f"{q(m)}(?s:.)*?(?:{q(m)}|\\z)" for m in syntax.text if len(m) > 1] + [f"{q(m)}(?:\\\\.|[^\\\\\\n{q(m)}])*+(?:{q(m)}|(?=\\n)|\\z|\\\\)" for m in syntax.text if len(m) == 1]
    comments = [f"{q(a)}(?s:.)*?(?:{q(b)}|\\z)" for a, b in syntax.block] + [f"{q(m)}[^\\n]*+" for m in syntax.line]
    return f"(?d)({'|'.join(strings) or '(?!)'})|({'|'.join(comments) or '(?!)'})"


def kinds(text: Column, language: str) -> Column:
    """The kind of each line of a text, as an array: code, comment or blank. A line with anything but comments and white space
    is code, one of white space alone is blank, inside a comment too. Comment marks within strings, and string marks within
    comments, are none. Unknown languages have no comments. Work grows with the text: one scan finds strings and comments,
    comments are cut at line ends, and each line is judged by itself."""
    syntax = SYNTAXES.get(language, Syntax(text=()))
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _OTHER * 2), _pattern(syntax), f"$1{_OPEN}$2{_CLOSE}")
    cut = F.transform(F.split(marked, f"[{_OPEN}{_CLOSE}]", -1), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.concat(F.lit(_OPEN), F.replace(x, F.lit("\n"), F.lit(f"{_CLOSE}\n{_OPEN}")), F.lit(_CLOSE))))
    lines = F.split(F.array_join(cut, ""), "\n", -1)

    def kind(line: Column) -> Column:
        code = F.regexp_replace(line, f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", "")
        return F.when(code.rlike(r"\S"), "code").when(F.translate(line, _OPEN + _CLOSE, "").rlike(r"\S"), "comment").otherwise("blank")

    return F.transform(lines, kind)


def line_counts(files: DataFrame, text: str, language: str) -> DataFrame:
    """files' other columns with lines, code, comments and blanks, by the syntax that the column ``language`` names. A last
    line without anything, behind a line feed at the end, is no line; null texts have none."""
    each = F.lit(None).cast("array<string>")
    for name in SYNTAXES:
        each = F.when(F.lower(language) == name, kinds(F.col(text), name)).otherwise(each)
    each = F.coalesce(each, kinds(F.col(text), ""), F.expr("cast(array() as array<string>)"))
    rows = files.withColumn("_kinds", each)
    rows = rows.withColumn("_kinds", F.when(F.col(text).endswith("\n") | (F.col(text) == ""), F.slice("_kinds", F.lit(1), F.greatest(F.size("_kinds") - 1, F.lit(0)))).otherwise(F.col("_kinds")))
    count = lambda k: F.size(F.filter("_kinds", lambda x: x == k)).cast("long")
    return rows.select(*[c for c in files.columns if c != text], F.size("_kinds").cast("long").alias("lines"), count("code").alias("code"), count("comment").alias("comments"), count("blank").alias("blanks"))
