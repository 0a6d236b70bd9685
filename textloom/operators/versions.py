"""Two versions of a text: what has changed, as ranges of lines, as a unified diff, and applied again."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

NAMES = ("old_at", "old_n", "new_at", "new_n")
RANGES = ArrayType(StructType([StructField(x, IntegerType()) for x in NAMES]))
#: Lines that stand at so many places have their places kept as one number each.
OFTEN = 8


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose second ones rise too."""
    ends, last, before = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(ends, y)
        before[i] = last[at - 1] if at else -1
        ends[at : at + 1] = [y]
        last[at : at + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The lengths of the longest common subsequences of a and each prefix of b. A row of the table of lengths is one large
    integer, whose bit j is clear where the length grows with b[j]."""
    places: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    often = {y: sum(1 << j for j in at) for y, at in places.items() if len(at) >= OFTEN}
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        if x in places:
            at = often[x] if x in often else sum(1 << j for j in places[x])
            met = row & at
            row = ((row + met) | (row - met)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places with equal values that rise on both sides: first those of values that stand once on each side, as
    many of them as rise together, then a longest common subsequence of what lies between two of them. Time: the product
    of a range's two lengths over the bits of a word; memory: the lengths."""
    once_a, once_b = ({x for x, n in Counter(s).items() if n == 1} for s in (a, b))
    at = {y: j for j, y in enumerate(b) if y in once_b}
    fixed = _rising([(i, at[x]) for i, x in enumerate(a) if x in once_a and x in at])
    ends = [(-1, -1), *fixed, (len(a), len(b))]
    todo = [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:], strict=False)]
    found = list(fixed)
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            found.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                found.append((i, b.index(a[i], j, m)))
            continue
        half = (i + k) // 2
        sums = _common_lengths(a[i:half], b[j:m]) + _common_lengths(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(sums.argmax())
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(found)


def _ranges(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old_at, old_n, new_at, new_n) of the ranges that differ, in order."""
    own: dict[str, int] = {}
    a, b = ([own.setdefault(x, len(own)) for x in lines] for lines in (old, new))
    out, i, j = [], 0, 0
    for p, q in [*_matches(a, b), (len(a), len(b))]:
        if p > i or q > j:
            out.append((i, p - i, j, q - j))
        i, j = p + 1, q + 1
    return out


@F.pandas_udf(RANGES)
def _changed(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(NAMES, r, strict=True)) for r in _ranges(list(a), list(b))] for a, b in zip(old, new, strict=True)])


def _own_lines(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n", -1), F.expr("cast(array() as array<string>)"))


def compare(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with ``changes`` for the columns ``old`` and ``new``: an array of (old_at, removed, new_at, added), places from 0
    in the lines of either side, and the lines themselves, in order; all lines between two changes are equal.

    Lines end at line feeds; a text that ends with one has an empty last line. A null text has no lines, and an empty one
    has one empty line. Equal texts have no changes. A row is compared by itself: nothing is shuffled."""
    rows = pairs.withColumns({"_old": _own_lines(F.col(old)), "_new": _own_lines(F.col(new))})
    rows = rows.withColumn("_at", _changed("_old", "_new"))
    part = lambda side, c: F.slice(f"_{side}", c[f"{side}_at"] + 1, c[f"{side}_n"])
    each = lambda c: F.struct(c["old_at"].alias("old_at"), part("old", c).alias("removed"), c["new_at"].alias("new_at"), part("new", c).alias("added"))
    return rows.withColumn("changes", F.transform("_at", each)).drop("_old", "_new", "_at")


def _end(c: Column) -> Column:
    return c["old_at"] + F.size(c["removed"])


def _before(changes: Column, i: Column) -> Column:
    """Where the change before the i-th one ends, in old lines."""
    return F.when(i == 0, 0).otherwise(_end(F.get(changes, i - 1)))


def apply_changes(compared: DataFrame, old: str, to: str = "patched") -> DataFrame:
    """compared with ``to``: the new text, made of the lines of ``old`` and the changes alone; null if there are no lines."""
    rows = compared.withColumn("_old", _own_lines(F.col(old)))
    changes = F.col("changes")
    parts = F.transform(changes, lambda c, i: F.concat(F.slice("_old", _before(changes, i) + 1, c["old_at"] - _before(changes, i)), c["added"]))
    last = F.when(F.size(changes) == 0, 0).otherwise(_end(F.element_at(changes, F.when(F.size(changes) == 0, 1).otherwise(-1))))
    rows = rows.withColumn("_new", F.concat(F.flatten(parts), F.slice("_old", last + 1, F.size("_old"))))
    return rows.withColumn(to, F.when(F.size("_new") > 0, F.array_join("_new", "\n"))).drop("_old", "_new")


def counts(compared: DataFrame, *keys: str) -> DataFrame:
    """keys, ranges, insertions and deletions of each row."""
    total = lambda side: F.aggregate("changes", F.lit(0).cast("long"), lambda n, c: n + F.size(c[side]))
    return compared.select(*keys, F.size("changes").cast("long").alias("ranges"), total("added").alias("insertions"), total("removed").alias("deletions"))


def unified(compared: DataFrame, old: str, name: Column, *keys: str, context: int = 3, to: str = "diff") -> DataFrame:
    """keys and ``to``: the unified diff of each row with changes, under the file name ``name``, with up to ``context`` equal
    lines around each change. Changes with at most twice as many lines between them share a hunk. The text that
    ``diff.numbered_lines`` reads back."""
    rows = compared.where(F.size("changes") > 0).withColumns({"_old": _own_lines(F.col(old)), "_name": name})
    changes = F.col("changes")
    apart = lambda c, i: (i == 0) | (c["old_at"] - _before(changes, i) > 2 * context)
    rows = rows.withColumn("_starts", F.filter(F.transform(changes, lambda c, i: F.when(apart(c, i), i)), lambda i: i.isNotNull()))
    following = lambda j: F.coalesce(F.get("_starts", j + 1), F.size(changes))
    rows = rows.withColumn("_hunks", F.transform("_starts", lambda s, j: F.slice(changes, s + 1, following(j) - s)))
    marked = lambda lines, mark: F.transform(lines, lambda x: F.concat(F.lit(mark), x))

    def hunk(h: Column) -> Column:
        first, last = F.get(h, F.lit(0)), F.element_at(h, -1)
        lead = F.least(first["old_at"], F.lit(context))
        stop = F.least(_end(last) + context, F.size("_old"))
        begin = first["old_at"] - lead
        until = lambda c, i: F.coalesce(F.get(h, i + 1)["old_at"], stop) - _end(c)
        body = F.flatten(F.transform(h, lambda c, i: F.concat(marked(c["removed"], "-"), marked(c["added"], "+"), marked(F.slice("_old", _end(c) + 1, until(c, i)), " "))))
        grown = F.aggregate(h, F.lit(0), lambda n, c: n + F.size(c["added"]) - F.size(c["removed"]))
        n_old = stop - begin
        side = lambda at, n: F.concat(F.when(n == 0, at).otherwise(at + 1).cast("string"), F.lit(","), n.cast("string"))
        head = F.concat(F.lit("@@ -"), side(begin, n_old), F.lit(" +"), side(first["new_at"] - lead, n_old + grown), F.lit(" @@"))
        return F.concat(F.array(head), marked(F.slice("_old", begin + 1, lead), " "), body)

    kind = F.when(F.size("_old") == 0, "new file mode 100644\n").when((F.size(changes) == 1) & (F.size("_old") == F.size(changes[0]["removed"])) & (F.size(changes[0]["added"]) == 0), "deleted file mode 100644\n").otherwise("")
    head = F.concat(F.lit("diff --git a/"), "_name", F.lit(" b/"), "_name", F.lit("\n"), kind, F.lit("--- a/"), "_name", F.lit("\n+++ b/"), "_name", F.lit("\n"))
    return rows.select(*keys, F.concat(head, F.array_join(F.flatten(F.transform("_hunks", hunk)), "\n")).alias(to))
