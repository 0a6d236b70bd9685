"""Ignore rules: lines of patterns in folders, negated ones too; the deepest folder's last fitting line decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEEP, _UNDER, _ALL = "\ue000", "\ue001", "\ue002"


def _regex(pattern: Column) -> Column:
    """A pattern of paths relative to its folder: * and ? stop at slashes, ** doesn't; one with a slash before its end holds
    from the folder on, another fits at any depth."""
    body = F.regexp_replace(pattern, "^/|/$", "")
    out = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    for a, b in (("**/", _DEEP), ("/**", _UNDER), ("**", _ALL), ("*", "[^/]*"), ("?", "[^/]"), (_DEEP, "(?:.*/)?"), (_UNDER, "/.*"), (_ALL, ".*")):
        out = F.replace(out, F.lit(a), F.lit(b))
    anchored = F.regexp_replace(pattern, "/$", "").contains("/")
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), out, F.lit("$"))


def rules_of(lines: DataFrame) -> DataFrame:
    """(folder, place, regex, negated, folders_only) of lines (folder, place, line) of ignore files; folder is "" at the top.
    Blank lines and those that begin with # are none; ! negates; a slash at the end means folders only."""
    line = F.regexp_replace("line", r"\s+$", "")
    own = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    bare = F.regexp_replace("line", "^!", "")
    return own.select("folder", "place", _regex(bare).alias("regex"), F.col("line").startswith("!").alias("negated"), F.col("line").endswith("/").alias("folders_only"))


def with_ignored(paths: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """paths with ignored. A path is ignored if the rules say so of it or of a folder that it lies in: what lies in an
    ignored folder can't be taken back. Of the rules that fit, those of the deepest folder count, of these the last.

    Folders of all paths are judged once each, by an equal join of their own parents with the folders of rules."""
    parts = F.split(F.col(path), "/")
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(upto(n).alias("node"), (n < F.size(parts)).alias("is_folder")))
    each = paths.select(F.col(path).alias("_path"), F.explode(nodes).alias("n")).select("_path", "n.*")
    judged = each.select("node", "is_folder").distinct()
    own = F.split("node", "/")
    parents = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.array_join(F.slice(own, F.lit(1), k), "/"))
    by_folder = judged.select("node", "is_folder", F.explode(parents).alias("folder")).join(rules, "folder")
    below = F.when(F.col("folder") == "", F.col("node")).otherwise(F.expr("substring(node, length(folder) + 2)"))
    fits = by_folder.where(F.regexp_like(below, F.col("regex")) & (F.col("is_folder") | ~F.col("folders_only")))
    said = fits.groupBy("node", "is_folder").agg(F.max_by(~F.col("negated"), F.struct(F.length("folder"), "place")).alias("ignored"))
    hit = each.join(said.where("ignored"), ["node", "is_folder"], "left_semi").select(F.col("_path").alias(path)).distinct().withColumn("_hit", F.lit(True))
    return paths.join(hit, path, "left").withColumn("ignored", F.coalesce("_hit", F.lit(False))).drop("_hit")
