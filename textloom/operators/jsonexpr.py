"""Query expressions over JSON values, made into column expressions: paths, iteration, select, map, keys and length.

    .items[] | select(.price >= 5 and .kind == "a") | .name

Every stage makes, of a value, an array of values; stages are chained inside the row, and rows are made at the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<path>\.(?:[A-Za-z_]\w*|"[^"]*")?)|(?P<index>\[-?\d+\])|(?P<each>\[\])|(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<op>==|!=|>=|<=|>|<)|(?P<word>[a-z]+)|(?P<mark>[|()]))""")
_NONE = "cast(array() as array<variant>)"
Stage = Callable[[Column], Column]


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad expression {text!r} at {text[at:]!r}")
        out.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
        at = m.end()
    return out


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _each(v: Column) -> Column:
    """The elements of an array or the values of an object; none of anything else."""
    return F.when(_is(v, "ARRAY"), _array(v)).when(_is(v, "OBJECT"), F.map_values(_map(v))).otherwise(F.expr(_NONE))


def _within(path: str) -> Stage:
    return lambda v: F.try_variant_get(v, f"${path}", "variant")


def _keys(v: Column) -> Column:
    """Names in order, or places from 0; null of anything else."""
    names = F.to_variant_object(F.array_sort(F.map_keys(_map(v))))
    places = F.to_variant_object(F.transform(_array(v), lambda x, i: i))
    return F.when(_is(v, "OBJECT"), names).when(_is(v, "ARRAY"), places)


def _length(v: Column) -> Column:
    n = F.when(_is(v, "ARRAY"), F.size(_array(v))).when(_is(v, "OBJECT"), F.size(_map(v))).when(_is(v, "STRING"), F.length(F.try_variant_get(v, "$", "string")))
    return F.to_variant_object(F.array(F.coalesce(n, F.lit(0)).cast("long")))


class _Compiler:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or (value is not None and token[1] != value):
            raise ValueError(f"bad expression {self.text!r}: {value or 'more'} expected, found {token[1] or 'its end'!r}")
        self.at += 1
        return token

    def pipe(self) -> Stage:
        stages = [self.stage()]
        while self.peek() == ("mark", "|"):
            self.take()
            stages.append(self.stage())

        def run(v: Column) -> Column:
            out = stages[0](v)
            for stage in stages[1:]:
                out = F.flatten(F.transform(out, stage))
            return out

        return run

    def stage(self) -> Stage:
        kind, value = self.peek()
        if kind in ("path", "index", "each"):
            return self.path()
        if kind == "word" and value in ("select", "map"):
            self.take()
            self.take("(")
            inner = self.condition() if value == "select" else self.pipe()
            self.take(")")
            if value == "select":
                return lambda v: F.when(inner(v), F.array(v)).otherwise(F.expr(_NONE))
            return lambda v: F.array(F.to_variant_object(F.flatten(F.transform(_each(v), inner))))
        if kind == "word" and value in ("keys", "length"):
            self.take()
            return (lambda v: F.array(_keys(v))) if value == "keys" else (lambda v: F.array(F.try_variant_get(_length(v), "$[0]", "variant")))
        raise ValueError(f"bad expression {self.text!r}: a path, select, map, keys or length expected, found {value or 'its end'!r}")

    def steps(self) -> list[str | None]:
        """Steps of a path as the reader's path syntax; None for each."""
        out: list[str | None] = []
        while self.peek()[0] in ("path", "index", "each"):
            kind, value = self.take()
            name = value[1:].strip('"')
            if kind == "each":
                out.append(None)
            elif kind == "index":
                if value.startswith("[-"):
                    raise ValueError(f"bad expression {self.text!r}: places count from 0")
                out.append(value)
            elif name:
                if "'" in name:
                    raise ValueError(f"bad expression {self.text!r}: quotes in names aren't known")
                out.append(f"['{name}']")
        return out

    def path(self) -> Stage:
        parts: list[str | None] = []
        for step in self.steps():
            if step is not None and parts and parts[-1] is not None:
                parts[-1] += step
            else:
                parts.append(step)

        def run(v: Column) -> Column:
            out = F.array(v)
            for part in parts:
                out = F.flatten(F.transform(out, _each)) if part is None else F.transform(out, _within(part))
            return out

        return run

    def condition(self) -> Callable[[Column], Column]:
        out = self.both()
        while self.peek() == ("word", "or"):
            self.take()
            out = (lambda a, b: lambda v: a(v) | b(v))(out, self.both())
        return out

    def both(self) -> Callable[[Column], Column]:
        out = self.test()
        while self.peek() == ("word", "and"):
            self.take()
            out = (lambda a, b: lambda v: a(v) & b(v))(out, self.test())
        return out

    def test(self) -> Callable[[Column], Column]:
        if self.peek() == ("mark", "("):
            self.take()
            out = self.condition()
            self.take(")")
            return out
        if self.peek()[0] not in ("path", "index"):
            raise ValueError(f"bad expression {self.text!r}: a path expected, found {self.peek()[1] or 'its end'!r}")
        steps = self.steps()
        if None in steps:
            raise ValueError(f"bad expression {self.text!r}: a condition is on one value")
        where = "$" + "".join(s or "" for s in steps)
        if self.peek()[0] != "op":  # anything but null and false
            return lambda v: F.coalesce(F.try_variant_get(v, where, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, where, "variant")) & (F.coalesce(F.try_variant_get(v, where, "string"), F.lit("")) != "false"), F.lit(False))
        op, (kind, value) = self.take()[1], self.take()
        if kind not in ("text", "number"):
            raise ValueError(f"bad expression {self.text!r}: a number or text expected, found {value!r}")
        literal = json.loads(value)

        def run(v: Column) -> Column:
            found = F.try_variant_get(v, where, "variant")
            if kind == "text":
                mine = F.when(_is(found, "STRING"), F.try_variant_get(found, "$", "string"))
            else:
                mine = F.when(~_is(found, "STRING") & ~_is(found, "BOOLEAN"), F.try_variant_get(found, "$", "double"))
            other = F.lit(literal if kind == "text" else float(literal))
            compared = {"==": mine == other, "!=": mine != other, ">=": mine >= other, "<=": mine <= other, ">": mine > other, "<": mine < other}[op]
            return F.coalesce(compared, F.lit(op == "!="))

        return run


def compiled(expression: str) -> Stage:
    """The column function of an expression: a value as VARIANT to the array of its results. ValueError if it isn't one."""
    own = _Compiler(expression)
    out = own.pipe()
    if own.peek()[0] != "end":
        raise ValueError(f"bad expression {expression!r} at {own.peek()[1]!r}")
    return out


def evaluate(records: DataFrame, expression: str, record: str = "record", value: str = "value") -> DataFrame:
    """records' other columns with pos (from 1) and value, JSON text, of each result of an expression over ``record``.

    .a.b[0] and ."a b" go into objects and arrays, null where nothing is; [] gives each element or value; select(test) keeps
    what meets tests of a path against a number or text (== != < <= > >=, and, or, brackets), a value of another type meets
    only !=; a path alone tests for anything but null and false; map(stages) works on each and gives one array; keys and
    length are those of objects, arrays and (length) texts."""
    stage = compiled(expression)
    others = [c for c in records.columns if c != record]
    out = records.select(*others, F.posexplode(stage(F.col(record))).alias("pos", "_v"))
    return out.select(*others, (F.col("pos") + 1).alias("pos"), F.coalesce(F.to_json("_v"), F.lit("null")).alias(value))
