"""Discovery over tables of paths: by name, kind, extension, depth, size, time and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import basename, glob

#: Bytes of a size's unit, seconds of a duration's.
SIZES = {"b": 1, "k": 1000, "m": 1000**2, "g": 1000**3, "t": 1000**4, "ki": 1024, "mi": 1024**2, "gi": 1024**3, "ti": 1024**4}
SECONDS = {"s": 1, "sec": 1, "min": 60, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}


def by_globs(df: DataFrame, path: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path fits one of the globs to include, if there are any, and none of those to exclude."""
    if include:
        df = df.where(F.col(path).rlike("|".join(map(glob, include))))
    return df.where(~F.col(path).rlike("|".join(map(glob, exclude)))) if exclude else df


def size_condition(size: Column, text: str) -> Column:
    """``+1k`` (at least), ``-100M`` (at most) or ``5b`` (just so many bytes)."""
    if not (m := re.fullmatch(r"([+-]?)(\d+)([a-zA-Z]*)", text)) or (unit := m[3].lower().removesuffix("b") or "b") not in SIZES:
        raise ValueError(f"not a size: {text}")
    n = int(m[2]) * SIZES[unit]
    return size >= n if m[1] == "+" else size <= n if m[1] == "-" else size == n


def seconds(text: str) -> int:
    """``7d``, ``1h`` or ``30min`` in seconds."""
    if not (m := re.fullmatch(r"(\d+)\s*([a-z]+)", text)) or m[2] not in SECONDS:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * SECONDS[m[2]]


def listed(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with name (the last part) and type: a path that ends in a slash is a directory, any other a file."""
    return paths.withColumns({"name": basename(F.translate(path, "\\", "/")), "type": F.when(F.col(path).rlike(r"[/\\]$"), "directory").otherwise("file")})


def find(
    paths: DataFrame,
    pattern: str | None = None,
    kind: str = "any",
    extension: str | None = None,
    max_depth: int | None = None,
    hidden: bool = False,
    size: str | None = None,
    changed_within: str | None = None,
    changed_before: str | None = None,
    exclude: tuple[str, ...] = (),
    now: Column | None = None,
) -> DataFrame:
    """Rows of paths (path; size in bytes and modified, a Unix time, if asked for) that meet all conditions, with name and
    type. hidden: also those with a part that begins with a dot. Depth counts the parts, from 1. ``now`` is a parameter, so
    that results can be repeated."""
    out = by_globs(listed(paths), "path", (), exclude)
    if pattern is not None:
        out = out.where(F.col("name").rlike(pattern))
    if kind != "any":
        out = out.where(F.col("type") == kind)
    if extension is not None:
        out = out.where(F.col("name").endswith("." + extension.removeprefix(".")))
    if max_depth is not None:
        out = out.where(F.size(F.split(F.rtrim(F.col("path"), F.lit("/")), "/")) <= max_depth)
    if not hidden:
        out = out.where(~F.col("path").rlike(r"(^|/)\.[^./]"))
    if size is not None:
        out = out.where(size_condition(F.col("size"), size))
    now = F.unix_timestamp() if now is None else now
    if changed_within is not None:
        out = out.where(F.col("modified") >= now - seconds(changed_within))
    if changed_before is not None:
        out = out.where(F.col("modified") < now - seconds(changed_before))
    return out
