"""Parsers of tool output: blocks between markers and lines of fields, as columns of expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import bare_mail, iso_utc, relative_date


def _int(x: Column) -> Column:
    return F.when(x != "", x.try_cast("int"))


# The marks of commit and stash blocks.
COMMIT_START, COMMIT_META, COMMIT_END = ">>>COMMIT_START<<<", ">>>META<<<", ">>>COMMIT_END<<<"
STASH_START, STASH_END = ">>>STASH_START<<<", ">>>STASH_END<<<"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _lines(x: Column) -> Column:
    """Lines behind any empty ones at the beginning."""
    return F.split(F.regexp_replace(x, r"^\n+", ""), "\n", -1)


def _line(lines: Column, i: int) -> Column:
    return F.coalesce(F.get(lines, F.lit(i)), F.lit(""))


def _blocks(raw: DataFrame, text: str, keys: tuple[str, ...], start: str) -> DataFrame:
    parts = F.split(F.col(text), start, -1)
    return raw.select(*keys, F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "block"))


def commits(raw: DataFrame, text: str, *keys: str, emails: bool | None = None) -> DataFrame:
    """Commit blocks, pos from 0 in their text: the start mark; hash, short hash, subject and body; the meta mark; author,
    committer, date and relative date; the end mark; then a line of totals (n files changed, n insertions(+), n
    deletions(-)) and the names of the files, alone or before a bar, each once.

    emails: None for blocks as above; else blocks of seven meta lines (author, address, committer, address, date, relative
    date, committer's date), of which author and committer are the addresses, without brackets, or the names.
    """
    # Each step makes what the next one names several times, so that a block is cut once.
    meta_at, after_meta = f"instr(block, '{COMMIT_META}')", f"substring(block, instr(block, '{COMMIT_META}') + {len(COMMIT_META)})"
    parts = _blocks(raw, text, keys, COMMIT_START).select(*keys, "pos", "block", F.expr(meta_at).alias("_meta_at"), F.expr(after_meta).alias("_rest"))
    parts = parts.withColumn("_end_at", F.instr("_rest", COMMIT_END)).where("_meta_at > 0 and _end_at > 0")
    tail = F.split(F.expr(f"substring(_rest, _end_at + {len(COMMIT_END)})"), "\n")
    sums = r"files? changed|insertion|deletion"
    parts = parts.select(
        *keys, "pos", _lines(F.expr("left(block, _meta_at - 1)")).alias("_head"), _lines(F.expr("left(_rest, _end_at - 1)")).alias("_meta"),
        F.filter(F.transform(tail, lambda x: F.rtrim(x)), lambda x: x != "").alias("_lines"),
    )
    names = F.filter("_lines", lambda x: ~x.rlike(sums) & (x.contains("|") | ~x.rlike("^(>>>|-)")))
    parts = parts.select(*keys, "pos", "_head", "_meta", F.get(F.filter("_lines", lambda x: x.rlike(r"\d+ files? changed")), F.lit(0)).alias("_stat"), names.alias("_names"))
    f, meta, stat = F.col("_head"), F.col("_meta"), F.col("_stat")
    if emails is None:
        who = {"author": _line(meta, 0), "committer": _line(meta, 1), "date": _line(meta, 2), "date_relative": _line(meta, 3)}
    else:
        own = [bare_mail(_line(meta, i + 1)) if emails else _line(meta, i) for i in (0, 2)]
        who = {"author": own[0], "committer": own[1], "date": _line(meta, 4), "date_relative": _line(meta, 5), "committer_date": _line(meta, 6)}
    names = F.array_distinct(F.filter(F.transform("_names", lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != ""))
    body = F.array_join(F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))), "\n")
    return parts.select(
        *keys, "pos", *[_line(f, i).alias(n) for i, n in enumerate(("hash", "short_hash", "subject"))], _stripped(body).alias("body"), *[c.alias(n) for n, c in who.items()],
        _int(F.regexp_extract(stat, r"(\d+) files? changed", 1)).alias("files"),
        F.when(stat.isNotNull(), F.coalesce(F.when(stat.contains("insertion"), _int(F.regexp_extract(stat, r"(\d+) insertions?\(\+\)", 1))), F.lit(0))).alias("insertions"),
        F.when(stat.isNotNull(), F.coalesce(F.when(stat.contains("deletion"), _int(F.regexp_extract(stat, r"(\d+) deletions?\(-\)", 1))), F.lit(0))).alias("deletions"),
        names.alias("files_changed"),
    )


def shown_kind(text: Column) -> Column:
    """What a shown object is: commit, tag, tree or blob."""
    return (
        F.when(text.contains(COMMIT_START), "commit").when(F.ltrim(text).startswith("tag "), "tag").when(text.rlike(r"(?m)^\d+\s+(tree|blob)\s+[a-f0-9]+\s+"), "tree").otherwise("blob")
    )


def shown_commits(raw: DataFrame, text: str, *keys: str, emails: bool = False, most_files: int = 100) -> DataFrame:
    """Shown commits with committer_date, and the totals of the first ``most_files`` of their numstat lines; truncated:
    whether there are more."""
    own = raw.where(shown_kind(F.col(text)) == "commit")
    out = commits(own.withColumn("_text", F.col(text)), text, *keys, "_text", emails=emails).where("pos = 0").drop("pos", "files", "insertions", "deletions", "files_changed")
    parts = F.transform(F.split(F.substring_index("_text", COMMIT_END, -1), "\n"), lambda x: F.split(x, "\t"))
    rows = F.filter(parts, lambda p: (F.size(p) == 3) & F.get(p, F.lit(0)).rlike(r"^\d+$") & F.get(p, F.lit(1)).rlike(r"^\d+$"))
    total = lambda i: F.aggregate(F.slice(rows, 1, most_files), F.lit(0).cast("long"), lambda a, p: a + F.get(p, F.lit(i)).cast("long"))
    return out.withColumns({"files": F.least(F.size(rows), F.lit(most_files)), "insertions": total(0), "deletions": total(1), "truncated": F.size(rows) > most_files}).drop("_text")


def shown_tags(raw: DataFrame, text: str, *keys: str) -> DataFrame:
    """Headers of shown tags: name, tagger, date, message, its first line as annotation, and object: the commit that
    follows. Of what is no annotated tag, only the object is known."""
    lines = F.split(F.col(text), "\n", -1)
    annotated = F.get(lines, F.lit(0)).startswith("tag ")
    field = lambda name: F.trim(F.regexp_extract(F.get(F.filter(lines, lambda x: x.startswith(f"{name} ")), F.lit(0)), f"^{name} (.*)$", 1))
    message = _stripped(F.regexp_extract(F.col(text), r"(?s)^tag [^\n]*\n(?:[^\n]+\n)*\n(.*?)(?=\ncommit |$)", 1))
    found = lambda c: F.when(annotated, F.coalesce(c, F.lit("")))
    return raw.select(
        *keys, annotated.alias("annotated"), found(F.trim(F.expr(f"substring(split({text}, '\n')[0], 5)"))).alias("name"), found(field("Tagger:")).alias("tagger"),
        found(field("Date:")).alias("date"), found(message).alias("message"), found(F.substring_index(message, "\n", 1)).alias("annotation"),
        F.substring_index(field("commit"), " ", 1).alias("object"),
    )


def verified_tags(raw: DataFrame, text: str, name: str, *keys: str) -> DataFrame:
    """keys, tags (the names in the lines of ``text``, blank lines left out) and verified: whether ``name`` is one of them.
    Null texts have no names; a null or blank name is never verified."""
    tags = F.coalesce(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: _stripped(x)), lambda x: x != ""), F.expr("cast(array() as array<string>)"))
    rows = raw.select(*keys, _stripped(F.col(name)).alias("_name"), tags.alias("tags"))
    return rows.select(*keys, "tags", F.coalesce(F.array_contains("tags", F.col("_name")), F.lit(False)).alias("verified"))


def shown_trees(raw: DataFrame, text: str, *keys: str, most: int = 100) -> DataFrame:
    """keys, mode, type (tree or blob), hash and path of the first ``most`` entries of each shown tree, in their order, and
    truncated: whether the tree has more. Works inside the row."""
    shape = r"^(\d+)\s+(tree|blob)\s+([a-f0-9]+)\s+(.+)$"
    rows = raw.select(*keys, F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: _stripped(x)), lambda x: x.rlike(shape)).alias("_entries"))
    rows = rows.select(*keys, (F.size("_entries") > most).alias("truncated"), F.explode(F.slice("_entries", 1, most)).alias("_entry"))
    return rows.select(*keys, *[F.regexp_extract("_entry", shape, i).alias(n) for i, n in enumerate(("mode", "type", "hash", "path"), 1)], "truncated")


def shown_blobs(raw: DataFrame, text: str, *keys: str, most_lines: int = 500) -> DataFrame:
    """Shown contents: size in characters, the first lines, and whether there are more."""
    lines = F.split(F.col(text), "\n", -1)
    return raw.where(shown_kind(F.col(text)) == "blob").select(*keys, F.col(text).alias("content"), F.length(text).alias("size"), F.slice(lines, 1, most_lines).alias("lines"), (F.size(lines) > most_lines).alias("truncated"))


def shown_short(raw: DataFrame, text: str, *keys: str) -> DataFrame:
    """``hash subject`` in the first line that isn't blank: a commit; anything else is a blob, nothing an empty commit."""
    first = F.coalesce(F.get(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    shape = r"^([a-f0-9]{7,40})\s+(.+)$"
    kind = F.when((first == "") | first.rlike(shape), "commit").otherwise("blob")
    return raw.select(*keys, kind.alias("type"), F.regexp_extract(first, shape, 1).alias("short_hash"), F.regexp_extract(first, shape, 2).alias("subject"))


def numstat(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``added TAB deleted TAB path``; lines of other shapes, binary files too, are dropped."""
    f = F.split(F.col(text), "\t")
    out = lines.where(F.size(f) == 3).withColumns({"additions": _int(f[0]), "deletions": _int(f[1]), "path": f[2]})
    return out.where("additions is not null and deletions is not null").drop(text)


def branches(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``* name hash [remote: ahead n, behind m] subject``; symbolic references (->) are dropped."""
    x = F.col(text)
    shape = r"^([*+ ]) (\S+|\(.*?\))\s+([0-9a-f]{7,40})(?: \[([^\]:]+)(?:: ([^\]]*))?\])? ?(.*)$"
    out = lines.where(x.rlike(shape) & ~x.contains(" -> "))
    g = lambda i: F.regexp_extract(x, shape, i)
    return out.select(
        *[c for c in lines.columns if c != text], g(2).alias("name"), (g(1) == "*").alias("current"), g(3).alias("commit"), F.nullif(g(4), F.lit("")).alias("remote"),
        _int(F.regexp_extract(g(5), r"ahead (\d+)", 1)).alias("ahead"), _int(F.regexp_extract(g(5), r"behind (\d+)", 1)).alias("behind"), g(6).alias("subject"),
    )


def tags(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``name  annotation`` with two spaces or more between; a name alone has no annotation."""
    x = F.col(text)
    shape = r"^(\S.*?)\s{2,}(.+)$"
    name = F.when(x.rlike(shape), F.regexp_extract(x, shape, 1)).otherwise(F.trim(x))
    return lines.where(F.trim(x) != "").select(*[c for c in lines.columns if c != text], name.alias("name"), F.nullif(F.regexp_extract(x, shape, 2), F.lit("")).alias("annotation"))


def remotes(lines: DataFrame, *keys: str) -> DataFrame:
    """``name TAB url (fetch)`` and ``(push)`` lines as one row per remote."""
    shape = r"^(\S+)\s+(\S+)\s+\((fetch|push)\)$"
    x = F.col("line_text")
    rows = lines.where(x.rlike(shape)).select(*keys, F.regexp_extract(x, shape, 1).alias("name"), F.regexp_extract(x, shape, 2).alias("url"), F.regexp_extract(x, shape, 3).alias("kind"))
    return rows.groupBy(*keys, "name").agg(F.max(F.when(F.col("kind") == "fetch", F.col("url"))).alias("fetch_url"), F.max(F.when(F.col("kind") == "push", F.col("url"))).alias("push_url"))


def config(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``scope:origin TAB key TAB value``, ``origin TAB key TAB value``, ``key=value`` (first =) or a bare key."""
    x = F.col(text)
    f = F.split(x, "\t", 3)
    three, scoped = F.size(f) == 3, F.size(f).eqNullSafe(F.lit(3)) & f[0].rlike(r"^(system|global|local|worktree|command):")
    return lines.where(F.trim(x) != "").select(
        *[c for c in lines.columns if c != text],
        F.when(three, f[1]).when(x.contains("="), F.substring_index(x, "=", 1)).otherwise(x).alias("key"),
        F.when(three, F.get(f, F.lit(2))).when(x.contains("="), F.expr(f"substring({text}, instr({text}, '=') + 1)")).alias("value"),
        F.when(scoped, F.substring_index(f[0], ":", 1)).alias("scope"),
        F.when(scoped, F.regexp_extract(f[0], r"^[a-z]+:(.*)$", 1)).when(three, f[0]).alias("origin"),
    )


def stashes(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``stash@{n}: message``."""
    shape = r"^stash@\{(\d+)\}: (.*)$"
    x = F.col(text)
    return lines.where(x.rlike(shape)).select(*[c for c in lines.columns if c != text], F.regexp_extract(x, shape, 1).cast("int").alias("index"), F.regexp_extract(x, shape, 2).alias("message"))


def stash_blocks(raw: DataFrame, text: str, *keys: str) -> DataFrame:
    """Stash blocks of two lines or more: stash@{n}, hash, message, date, relative date; missing ones are empty. Texts
    without such blocks are read as lines of ``stash@{n}: message``."""
    blocks = _blocks(raw, text, keys, STASH_START).where(F.col("block").contains(STASH_END))
    f = F.filter(F.transform(F.split(F.split("block", STASH_END, 2)[0], "\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    names = ("hash", "message", "date", "date_relative")
    index = F.regexp_extract(_line(f, 0), r"\{(\d+)\}", 1).try_cast("int").alias("index")
    own = blocks.where(F.size(f) >= 2).select(*keys, index, *[_line(f, i).alias(n) for i, n in enumerate(names, 1)])
    plain = raw.where(~F.col(text).rlike(f"(?s){STASH_START}.*{STASH_END}")).select(*keys, F.explode(F.split(F.col(text), "\r?\n")).alias("line_text"))
    empty = [F.lit("").alias(n) for n in ("hash", "date", "date_relative")]
    return own.unionByName(stashes(plain).select(*keys, "index", "message", *empty))


def head_and_branches(raw: DataFrame, text: str, *keys: str) -> DataFrame:
    """Shown remotes: name, fetch_url, push_url, head_branch and tracked_branches (name, stale, tracked, new)."""
    x = F.col(text)
    pick = lambda label: F.nullif(F.trim(F.regexp_extract(x, rf"(?m)^\s*{label}(.*)$", 1)), F.lit(""))
    part = F.split(F.regexp_extract(x, r"(?ms)^\s*Remote branches:\s*?\n(.*?)(?=^\s*$|^\s*Local (?:branches|refs) configured for|\z)", 1), "\n")
    shape = r"^\s+(\S.*?)\s{2,}(\S+).*$"
    branch = lambda l: F.struct(F.regexp_extract(l, shape, 1).alias("name"), *[(F.regexp_extract(l, shape, 2) == k).alias(k) for k in ("stale", "tracked", "new")])  # noqa: E731, E741
    return raw.where(x.rlike(r"(?m)^\* remote \S+")).select(
        *keys, F.regexp_extract(x, r"(?m)^\* remote (\S+)", 1).alias("name"), pick("Fetch URL:").alias("fetch_url"), pick("Push  URL:").alias("push_url"), pick("HEAD branch:").alias("head_branch"),
        F.transform(F.filter(part, lambda l: l.rlike(shape)), branch).alias("tracked_branches"),
    )


def remote_urls(raw: DataFrame, text: str, *keys: str, push: bool = False, both: bool = False) -> DataFrame:
    """The first line that isn't blank as fetch_url, or as push_url; with ``both`` the second one is the push_url."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda x: F.trim(x) != "")
    fetch = F.lit(None).cast("string") if push else F.get(lines, F.lit(0))
    other = F.get(lines, F.lit(0)) if push else F.get(lines, F.lit(1)) if both else F.lit(None).cast("string")
    return raw.where(F.size(lines) > 0).select(*keys, fetch.alias("fetch_url"), other.alias("push_url"))


def status(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """Two status letters, a path, and the old path of a renamed one."""
    x = F.col(text)
    rest = F.expr(f"substring({text}, 4)")
    moved = x.rlike(r"^[RC]") & rest.contains(" -> ")
    return lines.where(~x.startswith("##") & (F.length(x) > 3)).select(
        *[c for c in lines.columns if c != text], F.substring(x, 1, 1).alias("index_status"), F.substring(x, 2, 1).alias("worktree_status"),
        F.when(moved, F.regexp_extract(rest, r"^.* -> (.*)$", 1)).otherwise(rest).alias("path"), F.when(moved, F.regexp_extract(rest, r"^(.*?) -> ", 1)).alias("original_path"),
    )


def status_branches(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``## branch...upstream [ahead n, behind m]`` lines: branch, upstream, ahead and behind (0 where not named)."""
    x = F.col(text)
    shape = r"^## (?:No commits yet on )?(.+?)(?:\.\.\.(\S+))?(?: \[(.*)\])?$"
    n = lambda word: F.coalesce(_int(F.regexp_extract(F.regexp_extract(x, shape, 3), rf"{word} (\d+)", 1)), F.lit(0))
    return lines.where(x.startswith("## ")).select(*[c for c in lines.columns if c != text], F.regexp_extract(x, shape, 1).alias("branch"), F.nullif(F.regexp_extract(x, shape, 2), F.lit("")).alias("upstream"), n("ahead").alias("ahead"), n("behind").alias("behind"))


def status_summary(rows: DataFrame, *keys: str) -> DataFrame:
    i, w = F.col("index_status"), F.col("worktree_status")
    clash = (i == "U") | (w == "U") | ((i == "A") & (w == "A")) | ((i == "D") & (w == "D"))
    out = rows.groupBy(*keys).agg(
        F.count_if(~i.isin(" ", "?", "!") & ~clash).alias("staged"), F.count_if(~w.isin(" ", "?", "!") & ~clash).alias("modified"),
        F.count_if(i == "?").alias("untracked"), F.count_if(clash).alias("conflicted"), F.count_if(i == "!").alias("ignored"),
    )
    return out.withColumn("is_clean", F.expr("staged + modified + untracked + conflicted = 0"))


def conflicts(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``CONFLICT (type): ... in file``, or ``CONFLICT (modify/delete): file deleted in ...``."""
    x = F.col(text)
    kind = F.regexp_extract(x, r"^CONFLICT \(([^)]*)\): ", 1)
    file = F.when(kind == "modify/delete", F.regexp_extract(x, r"^CONFLICT \([^)]*\): (\S+) deleted", 1)).otherwise(F.regexp_extract(x, r"^.* in (.+)$", 1))
    return lines.where(x.startswith("CONFLICT (")).select(*[c for c in lines.columns if c != text], kind.alias("type"), file.alias("file"))


def picks(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``[branch hash] subject``."""
    shape = r"^\[(\S+) ([0-9a-f]{7,40})\] (.*)$"
    x = F.col(text)
    return lines.where(x.rlike(shape)).select(*[c for c in lines.columns if c != text], F.regexp_extract(x, shape, 2).alias("commit"), F.expr("left(regexp_extract(%s, '^\\\\[\\\\S+ ([0-9a-f]{7,40})', 1), 7)" % text).alias("short_commit"), F.regexp_extract(x, shape, 3).alias("subject"))


def pick_flags(runs: DataFrame, errors: str, *keys: str) -> DataFrame:
    """has_conflicts and in_progress of runs, from what a tool wrote to its error stream."""
    x = F.col(errors)
    return runs.select(*keys, (x.contains("error: could not apply") | x.contains("CONFLICT")).alias("has_conflicts"), x.contains("hint: after resolving").alias("in_progress"))


def processes(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """Process tables of 11 fields or more: user, pid, cpu, memory, time, command with its spaces; headers are dropped."""
    f = F.split(F.trim(text), r"\s+", 11)
    rows = lines.where((F.size(f) == 11) & f[1].rlike(r"^\d+$"))
    return rows.select(*[c for c in lines.columns if c != text], f[0].alias("user"), f[1].cast("int").alias("pid"), f[2].try_cast("double").alias("cpu"), f[3].try_cast("double").alias("memory"), f[9].alias("time"), f[10].alias("command"), F.regexp_extract(f[10], r"^(\S+)", 1).alias("name"))


def diagnostics(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``file:line:column: CODE message``; other lines are dropped."""
    shape = r"^(.+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$"
    x = F.col(text)
    names = (("file", None), ("line", "int"), ("column", "int"), ("code", None), ("message", None))
    return lines.where(x.rlike(shape)).select(*[c for c in lines.columns if c != text], *[(F.regexp_extract(x, shape, i) if kind is None else F.regexp_extract(x, shape, i).cast(kind)).alias(n) for i, (n, kind) in enumerate(names, 1)])


def timings(lines: DataFrame, *keys: str) -> DataFrame:
    """``real/user/sys XmY.YYYs`` lines as seconds in one row per key, with a deviation of 0."""
    shape = r"^(real|user|sys)\s+(\d+)m([\d.]+)s$"
    x = F.col("line_text")
    rows = lines.where(x.rlike(shape)).select(*keys, F.regexp_extract(x, shape, 1).alias("k"), (F.regexp_extract(x, shape, 2).cast("int") * 60 + F.regexp_extract(x, shape, 3).cast("double")).alias("s"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("s")))
    return rows.groupBy(*keys).agg(pick("real").alias("mean"), pick("user").alias("user"), pick("sys").alias("system"), F.lit(0.0).alias("stddev"))


def grep_lines(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``file:line:text``; lines without a number in the second place are dropped."""
    shape = r"^([^:]+):(\d+):(.*)$"
    x = F.col(text)
    return lines.where(x.rlike(shape)).select(*[c for c in lines.columns if c != text], F.regexp_extract(x, shape, 1).alias("file"), F.regexp_extract(x, shape, 2).cast("int").alias("line_number"), F.regexp_extract(x, shape, 3).alias("match_line"))


def ranked_paths(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``score path`` or ``path`` (score 0)."""
    shape = r"^\s*([\d.]+)\s+(/.*)$"
    x = F.col(text)
    scored = x.rlike(shape)
    return lines.where(F.trim(x) != "").select(*[c for c in lines.columns if c != text], F.when(scored, F.regexp_extract(x, shape, 2)).otherwise(F.trim(x)).alias("path"), F.when(scored, F.regexp_extract(x, shape, 1).try_cast("double")).otherwise(0.0).alias("score"))


def tree(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """``mode type hash TAB path``."""
    shape = r"^(\d{6}) (\w+) ([0-9a-f]+)\t(.+)$"
    x = F.col(text)
    return lines.where(x.rlike(shape)).select(*[c for c in lines.columns if c != text], *[F.regexp_extract(x, shape, i).alias(n) for i, n in enumerate(("mode", "type", "hash", "path"), 1)])


def blame(lines: DataFrame, file: str, emails: bool = False, now: Column | None = None) -> DataFrame:
    """Attribution (file, pos, line_text): header lines ``hash old new count`` or ``hash old new`` begin an entry, fields
    follow, and a line that begins with a tab is the content. Fields are carried forward within a commit's group. author is
    the address, without brackets, if ``emails`` and there is one; date is in UTC, date_relative as of ``now``."""
    x = F.col("line_text")
    head = r"^([0-9a-f]{40}) (\d+) (\d+)(?: (\d+))?$"
    is_head = x.rlike(head)
    w = Window.partitionBy(file).orderBy("pos")
    rows = lines.withColumns(
        {
            "hash": F.last(F.when(is_head, F.regexp_extract(x, head, 1)), ignorenulls=True).over(w),
            "line_number": F.last(F.when(is_head, F.regexp_extract(x, head, 3).cast("int")), ignorenulls=True).over(w),
            "starts": F.when(is_head & (F.regexp_extract(x, head, 4) != ""), 1).otherwise(0),
        }
    )
    rows = rows.withColumn("part", F.sum("starts").over(w))
    own = Window.partitionBy(file, "part", "hash").orderBy("pos")
    carry = lambda name: F.last(F.when(x.startswith(f"{name} "), F.expr(f"substring(line_text, {len(name) + 2})")), ignorenulls=True).over(own)
    rows = rows.withColumns({"name": carry("author"), "mail": carry("author-mail"), "author_time": carry("author-time").try_cast("long"), "summary": carry("summary")})
    author = F.coalesce(bare_mail(F.col("mail")), F.col("name"), F.lit("")) if emails else F.coalesce("name", F.lit(""))
    return rows.where(x.startswith("\t")).select(
        file, "line_number", F.col("hash").alias("commit_hash"), F.substring("hash", 1, 7).alias("short_commit"), author.alias("author"), "author_time",
        F.coalesce(iso_utc(F.col("author_time")), F.lit("")).alias("date"), F.coalesce(relative_date(F.col("author_time"), F.unix_timestamp() if now is None else now), F.lit("")).alias("date_relative"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.expr("substring(line_text, 2)").alias("line_text"),
    )
