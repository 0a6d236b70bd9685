"""Search, view and replace queries. documents stand in for files, pages for paths, conversations for line streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import glob, pattern, replacement
from textloom.operators import discovery as D
from textloom.operators import replace as R
from textloom.operators import search as S
from textloom.operators import tabular as T
from textloom.operators.ignore import rules_of, with_ignored
from textloom.plans.params import Param
from textloom.plans.registry import query
from textloom.sources.tables import table, text_lines

#: Lines of documents, for DuckDB.
LINES = "WITH t AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, lang, source, unnest(a) AS line_text, CAST(unnest(generate_series(1, len(a))) AS INT) AS line_number FROM t) "
MATCH = "doc_id, line_number, CAST(strlen(regexp_extract(line_text, '^(.*?)({0})', 1)) AS INT) AS column_start, CAST(strlen(regexp_extract(line_text, '^(.*?)({0})', 1)) + strlen(regexp_extract(line_text, '({0})', 1)) AS INT) AS column_end, regexp_extract(line_text, '({0})', 1) AS match_text"
ENGLISH = "[Tt]h[a-z]+tion"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def doc_lines(spark, sf_dir):
    return text_lines(docs(spark, sf_dir), "text", "doc_id", "lang", "source")


def _matches(found, *more):
    return found.select("doc_id", "line_number", "column_start", "column_end", "match_text", *more)


@query("search_regex", LINES + f"SELECT {MATCH.format(ENGLISH)}, line_text FROM l WHERE regexp_matches(line_text, '{ENGLISH}')", "search", (Param("regex", "string", ENGLISH, min_length=1),))
def search_regex(spark, sf_dir, regex=ENGLISH):
    """First match of a pattern in each line, with byte offsets."""
    return _matches(S.search_files(docs(spark, sf_dir), pattern(regex)), "line_text")


@query("search_literal", LINES + f"SELECT {MATCH.format('ng. ').replace('ng. ', 'ng[.] ')} FROM l WHERE contains(line_text, 'ng. ')", "search", (Param("text", "string", "ng. ", min_length=1),))
def search_literal(spark, sf_dir, text="ng. "):
    """First occurrence of a literal text in each line."""
    return _matches(S.search_files(docs(spark, sf_dir), pattern(text, literal=True)))


@query("search_ignore_case", LINES + f"SELECT {MATCH.format('(?i)the (of|and)')} FROM l WHERE regexp_matches(line_text, '(?i)the (of|and)')".replace("'^(.*?)((?i)the", "'(?i)^(.*?)(the"), "search")
def search_ignore_case(spark, sf_dir):
    """Search in any case."""
    return _matches(S.search_files(docs(spark, sf_dir), pattern("the (of|and)", ignore_case=True)))


@query(
    "search_word",
    LINES + "SELECT doc_id, line_number, CAST(strlen(regexp_extract(line_text, '^(.*?)((^|[^0-9A-Za-z_])on($|[^0-9A-Za-z_]))', 1)) + strlen(regexp_extract(line_text, '^(.*?)(^|[^0-9A-Za-z_])on($|[^0-9A-Za-z_])', 2)) AS INT) AS column_start FROM l WHERE regexp_matches(line_text, '(^|[^0-9A-Za-z_])on($|[^0-9A-Za-z_])')",
    "search",
)
def search_word(spark, sf_dir):
    """Search for a whole (ASCII) word."""
    return S.search_files(docs(spark, sf_dir), pattern("on", word=True)).select("doc_id", "line_number", "column_start")


@query("search_multiline", "SELECT doc_id, CAST(strlen(regexp_extract(text, '(?s)^(.*?)(er[.].Th[a-z]+)', 1)) AS INT) AS column_start, regexp_extract(text, '(?s)(er[.].Th[a-z]+)', 1) AS match_text FROM documents WHERE regexp_matches(text, '(?s)er[.].Th[a-z]+')", "search")
def search_multiline(spark, sf_dir):
    """A pattern whose dot crosses line ends, one row per document."""
    return S.search(table(spark, sf_dir, "documents"), pattern("er[.].Th[a-z]+", multiline=True), "text").select("doc_id", "column_start", "match_text")


@query("search_line_anchors", LINES + "SELECT doc_id, line_number, line_text FROM l WHERE regexp_matches(line_text, '^(The|Die|La|El) ') OR regexp_matches(line_text, 'tion[.]$')", "search")
def search_line_anchors(spark, sf_dir):
    """Patterns that hold a line's ends."""
    return S.search_files(docs(spark, sf_dir), pattern(r"\A(?:The|Die|La|El) |tion\.(?!\s|.)")).select("doc_id", "line_number", "line_text")


@query("search_multiline_anchors", "SELECT doc_id, CAST(strlen(regexp_extract(text, '(?s)^(.*?)([.]\n[A-Z])', 1)) AS INT) AS column_start FROM documents WHERE regexp_matches(text, '(?ms)[.]$.^[A-Z]')", "search")
def search_multiline_anchors(spark, sf_dir):
    """Patterns over several lines, whose anchors match at line ends."""
    return S.search(docs(spark, sf_dir), pattern(r"\.$.^[A-Z]", multiline=True), "text").select("doc_id", "column_start")


_TREE = "SELECT doc_id, text, source || '/' || lang || '/d' || doc_id || '.txt' AS path, source, lang FROM documents"
_IGNORED = f"""WITH t AS ({_TREE}), g AS (SELECT *, source LIKE '%2' AS by_source, source LIKE '%3' AND lang = 'en' AS by_folder,
CASE WHEN source LIKE '%4' AND suffix(path, '7.txt') THEN false WHEN source LIKE '%4' AND lang = 'de' THEN true WHEN suffix(path, '11.txt') THEN false WHEN suffix(path, '1.txt') THEN true ELSE false END AS by_name FROM t)
SELECT path, CAST(len(string_split(text, 'tion')) - 1 AS BIGINT) AS n FROM g WHERE NOT (by_source OR by_folder OR by_name) AND contains(text, 'tion')"""


@query("search_ignore_rules", _IGNORED, "search")
def search_ignore_rules(spark, sf_dir):
    """Search outside of what ignore files name, in folders, with negated rules, the deepest and last one deciding."""
    d = docs(spark, sf_dir)
    files = d.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "source", "text")
    top = ("# names", "", "*1.txt", "!*11.txt", "*2/", "*3/en")
    # The top's ignore file, and one in each source's folder whose name ends in 4.
    lines = F.array(*[F.struct(F.lit("").alias("folder"), F.lit(i).alias("place"), F.lit(x).alias("line")) for i, x in enumerate(top)])
    deep = F.array(*[F.struct(F.col("source").alias("folder"), F.lit(i).alias("place"), F.lit(x).alias("line")) for i, x in enumerate(("de/**", "!*7.txt"))])
    sources = files.select("source").distinct()
    own = sources.select(F.inline(F.when(F.col("source").endswith("4"), F.concat(lines, deep)).otherwise(lines))).distinct()
    kept = with_ignored(files.select("path", "text"), "path", rules_of(own)).where(~F.col("ignored"))
    return kept.where(F.col("text").contains("tion")).select("path", (F.size(F.split("text", "tion", -1)) - 1).cast("long").alias("n"))


@query("search_file_types", LINES + f"SELECT lang, {MATCH.format('sch')} FROM l WHERE lang IN ('de', 'fr') AND contains(line_text, 'sch')", "search", (Param("types", "array", ("de", "fr")),))
def search_file_types(spark, sf_dir, types=("de", "fr")):
    """Search in files of some types only."""
    return S.search_files(docs(spark, sf_dir).where(F.col("lang").isin(*types)), pattern("sch", literal=True)).select("lang", "doc_id", "line_number", "column_start", "column_end", "match_text")


@query("search_ignore_globs", LINES + f"SELECT source, {MATCH.format('ough')} FROM l WHERE source NOT LIKE 'src1%' AND contains(line_text, 'ough')".replace("ough", "thou"), "search")
def search_ignore_globs(spark, sf_dir):
    """Search outside of the sources that a glob names."""
    return S.search_files(docs(spark, sf_dir).where(~F.col("source").rlike(glob("src1*"))), pattern("thou", literal=True)).select("source", "doc_id", "line_number", "column_start", "column_end", "match_text")


@query("search_max_per_file", LINES + "SELECT doc_id, line_number, line_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS n FROM l WHERE regexp_matches(line_text, '[a-z]+tion')) WHERE n <= 3", "search", (Param("most", "integer", 3, minimum=1),))
def search_max_per_file(spark, sf_dir, most=3):
    """The first matching lines of each file."""
    return S.matching_lines(docs(spark, sf_dir).select("doc_id", "text"), "[a-z]+tion", most=most)


@query("search_summary", LINES + "SELECT count(*) FILTER (WHERE contains(line_text, 'tion')) AS total_matches, count(DISTINCT doc_id) FILTER (WHERE contains(line_text, 'tion')) AS files_with_matches, count(DISTINCT doc_id) AS files_searched FROM l", "search")
def search_summary(spark, sf_dir):
    """Totals of a search."""
    return S.summary(docs(spark, sf_dir), "tion")


@query("search_glob", LINES + "SELECT source, doc_id, line_number FROM l WHERE regexp_full_match(source, 'src(1[0-4]|[^/])') AND NOT regexp_full_match(source, 'src[^/]*5') AND contains(line_text, 'oution')", "search", (Param("include", "array", ("src{1[0-4],?}",)), Param("exclude", "array", ("**/src*5",))))
def search_glob(spark, sf_dir, include=("src{1[0-4],?}",), exclude=("**/src*5",)):
    """Search in the sources that some globs name and others don't."""
    own = D.by_globs(docs(spark, sf_dir), "source", include, exclude)
    return S.matching_lines(own.select("source", "doc_id", "text"), "oution").select("source", "doc_id", "line_number")


@query("search_truncated_topk", LINES + "SELECT doc_id, line_number, true AS truncated FROM l WHERE contains(line_text, 'tion') ORDER BY doc_id, line_number LIMIT 100", "search", (Param("most", "integer", 100, minimum=1),))
def search_truncated_topk(spark, sf_dir, most=100):
    """The first matches in file and line order, and whether there are more."""
    return S.cap(S.matching_lines(docs(spark, sf_dir).select("doc_id", "text"), "tion").drop("line_text"), ["doc_id", "line_number"], most)


@query("search_sort_path", "SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) AS place FROM pages WHERE contains(html, 'tion')", "search")
def search_sort_path(spark, sf_dir):
    """Matching pages with their places in the order of their paths."""
    return T.ranked(table(spark, sf_dir, "pages").where(F.col("html").contains("tion")).select("url", "page_id"), ["url", "page_id"])


@query("search_count_occurrences", LINES + "SELECT doc_id, line_number, CAST(len(regexp_extract_all(line_text, 'th[a-z]')) AS BIGINT) AS occurrences FROM l WHERE regexp_matches(line_text, 'th[a-z]')", "search")
def search_count_occurrences(spark, sf_dir):
    """All matches of each line, counted."""
    return S.matching_lines(docs(spark, sf_dir), "th[a-z]").select("doc_id", "line_number", F.regexp_count("line_text", F.lit("th[a-z]")).cast("long").alias("occurrences"))


@query("search_html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages", "search")
def search_html_title(spark, sf_dir):
    """Title and links of each page, by pattern."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("file_view_range", LINES + "SELECT doc_id, line_number, line_text FROM l WHERE line_number BETWEEN 2 AND 4", "view", (Param("first", "integer", 2, minimum=1), Param("last", "integer", 4, minimum=1)))
def file_view_range(spark, sf_dir, first=2, last=4):
    """A range of lines of every file."""
    return doc_lines(spark, sf_dir).where(F.col("line_number").between(first, last)).select("doc_id", "line_number", "line_text")


@query("file_line_numbers", "WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS a FROM conversations) SELECT conv_id, turn, CAST(unnest(generate_series(1, len(a))) AS INT) AS line_number, unnest(a) AS content FROM t", "view")
def file_line_numbers(spark, sf_dir):
    """Numbered lines of each turn of the conversations."""
    return text_lines(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn").withColumnRenamed("line_text", "content")


CONTEXT = LINES + ", c AS (SELECT *, lag(line_text) OVER w AS b1, lag(line_text, 2) OVER w AS b2, lead(line_text) OVER w AS a1 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)) SELECT doc_id, line_number, line_text, concat_ws('|', b2, b1) AS context_before, concat_ws('|', a1) AS context_after FROM c WHERE regexp_matches(line_text, 'oution')"


@query("search_context_before_after", CONTEXT, "search")
def search_context_before_after(spark, sf_dir):
    """Matches with two lines before and one behind."""
    found = S.with_context(docs(spark, sf_dir), "oution", 2, 1)
    return found.select("doc_id", "line_number", "line_text", F.concat_ws("|", "context_before").alias("context_before"), F.concat_ws("|", "context_after").alias("context_after"))


NEAREST = LINES + ", m AS (SELECT doc_id, line_number AS match_line FROM l WHERE contains(line_text, 'oution')), x AS (SELECT doc_id, line_number FROM l WHERE NOT contains(line_text, 'oution')), r AS (SELECT x.doc_id, x.line_number, m.match_line, row_number() OVER (PARTITION BY x.doc_id, x.line_number ORDER BY abs(x.line_number - m.match_line), m.match_line) AS n FROM x JOIN m USING (doc_id)) SELECT doc_id, line_number, match_line, CASE WHEN line_number < match_line THEN 'before' ELSE 'after' END AS side FROM r WHERE n = 1"


@query("context_nearest", NEAREST, "search")
def context_nearest(spark, sf_dir):
    """Every line without a match goes to the nearest match of its file."""
    return S.nearest_in_file(docs(spark, sf_dir).select("doc_id", "text"), "oution")


@query("replace_manifest", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'tion')) AS BIGINT) AS replacements_count, contains(text, 'tion') AS modified, md5(replace(text, 'tion', 'TION')) AS new_md5 FROM documents", "replace")
def replace_manifest(spark, sf_dir):
    """Replacements of each file and a digest of the new text."""
    return R.manifest(table(spark, sf_dir, "documents"), "doc_id", "text", "tion", "TION").select("doc_id", "replacements_count", "modified", F.md5("new_text").alias("new_md5"))


@query("replace_totals", "SELECT count(*) AS files_processed, CAST(sum(len(regexp_extract_all(text, 'tion'))) AS BIGINT) AS total_replacements, count(*) FILTER (WHERE contains(text, 'tion')) AS files_modified FROM documents", "replace")
def replace_totals(spark, sf_dir):
    """Files, replacements and modified files."""
    return R.totals(R.manifest(table(spark, sf_dir, "documents"), "doc_id", "text", "tion", "TION"))


def _all_matches(regex, new, old="ms[k]"):
    """SQL of all matches ms[k] of each line, with byte offsets: ``old`` states the part that is replaced, ``new`` by what."""
    return LINES + (
        f", m AS (SELECT doc_id, line_number, regexp_extract_all(line_text, '{regex}') AS ms, regexp_split_to_array(line_text, '{regex}') AS ps FROM l WHERE regexp_matches(line_text, '{regex}')), k AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM m), "
        f"r AS (SELECT doc_id, line_number, k, CAST(list_sum([strlen(x) for x in ps[1:k]]) + coalesce(list_sum([strlen(x) for x in ms[1:k - 1]]), 0) AS INT) AS column_start, {old} AS original_text, {new} AS replaced_text FROM k) "
    )


REPLACED = "doc_id, line_number, column_start, CAST(column_start + strlen(original_text) AS INT) AS column_end, original_text, replaced_text"
TIONS = _all_matches("[a-z]+tion", "regexp_replace(ms[k], 'tion$', 'TION')")


@query("replace_all_matches", TIONS + f"SELECT {REPLACED} FROM r", "replace")
def replace_all_matches(spark, sf_dir):
    """Every replacement of every line, with offsets."""
    return R.replacements(docs(spark, sf_dir).select("doc_id", "text"), "([a-z]+)tion", "$1TION")


@query("replace_capped", TIONS + f"SELECT {REPLACED} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number, k) AS n FROM r) WHERE n <= 2", "replace", (Param("most", "integer", 2, minimum=1),))
def replace_capped(spark, sf_dir, most=2):
    """The first replacements of each file, with offsets."""
    return R.replacements(docs(spark, sf_dir).select("doc_id", "text"), "([a-z]+)tion", "$1TION", most=most)


@query("replace_literal", _all_matches("[.] The", "'$1 \\'") + f"SELECT {REPLACED} FROM r", "replace", (Param("text", "string", ". The", min_length=1), Param("new", "string", "$1 \\")))
def replace_literal(spark, sf_dir, text=". The", new="$1 \\"):
    """Every replacement of a literal text by another, in which $ and \\ mean nothing."""
    return R.replacements(docs(spark, sf_dir).select("doc_id", "text"), pattern(text, literal=True), replacement(new, literal=True))


@query("replace_lookahead", _all_matches("th(?:at|e) a", "'<>'", "left(ms[k], length(ms[k]) - 2)") + f"SELECT {REPLACED} FROM r", "replace")
def replace_lookahead(spark, sf_dir):
    """Matches that depend on what follows them, which isn't replaced."""
    return R.replacements(docs(spark, sf_dir).select("doc_id", "text"), "th(?:at|e)(?= a)", "<>")


WORDS = "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(^|[^0-9A-Za-z_])(on[^0-9A-Za-z_])*on($|[^0-9A-Za-z_])')) AS BIGINT) > 0 AS modified FROM documents"


@query("replace_word_ignore_case", WORDS, "replace")
def replace_word_ignore_case(spark, sf_dir):
    """Files in which a whole word, in any case, would be replaced."""
    return R.manifest(docs(spark, sf_dir), "doc_id", "text", pattern("on", ignore_case=True, word=True), "ON").select("doc_id", "modified")


@query("replace_dotall", "SELECT doc_id, md5(regexp_replace(text, '(?s)er[.].Th', 'er. Th', 'g')) AS new_md5 FROM documents", "replace")
def replace_dotall(spark, sf_dir):
    """A replacement across line ends."""
    return R.manifest(docs(spark, sf_dir), "doc_id", "text", pattern("er[.].Th", multiline=True), "er. Th").select("doc_id", F.md5("new_text").alias("new_md5"))


CHANGES = LINES + (
    ", f AS (SELECT DISTINCT doc_id FROM l ORDER BY doc_id LIMIT 100), c AS (SELECT doc_id, sum(len(regexp_extract_all(line_text, 'oution'))) AS n, count(*) FILTER (WHERE contains(line_text, 'oution')) AS shown FROM l GROUP BY doc_id) "
    "SELECT doc_id, CAST(n AS BIGINT) AS replacements_count, n > 0 AS modified, CASE WHEN n > 0 THEN CAST(n AS INT) END AS n_replacements, CASE WHEN n > 0 THEN CAST(shown AS INT) END AS n_preview, (SELECT count(*) FROM documents) > 100 AS truncated FROM f JOIN c USING (doc_id)"
)


@query("replace_change_manifest", CHANGES, "replace", (Param("most_files", "integer", 100, minimum=1), Param("dry_run", "boolean", True)))
def replace_change_manifest(spark, sf_dir, most_files=100, dry_run=True):
    """Changes of the first files: nothing is listed where nothing would change."""
    out = R.change_manifest(docs(spark, sf_dir), "doc_id", "oution", "<>", most_files=most_files, dry_run=dry_run)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return out.select("doc_id", "replacements_count", "modified", size("replacements").alias("n_replacements"), size("preview").alias("n_preview"), "truncated")


@query("replace_groups", "SELECT doc_id, md5(regexp_replace(text, '([a-z]+)ing ([a-z]+)', '\\2 \\1ing', 'g')) AS new_md5 FROM documents", "replace")
def replace_groups(spark, sf_dir):
    """A replacement that names groups."""
    return R.manifest(table(spark, sf_dir, "documents"), "doc_id", "text", "([a-z]+)ing ([a-z]+)", "$2 $1ing").select("doc_id", F.md5("new_text").alias("new_md5"))


PREVIEW = LINES + ", c AS (SELECT *, lag(line_text) OVER w AS context_before, lead(line_text) OVER w AS context_after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)) SELECT doc_id, line_number, context_before, line_text AS original_line, replace(line_text, 'oution', '<>') AS replaced_line, context_after FROM c WHERE contains(line_text, 'oution')"


@query("replace_preview", PREVIEW, "replace")
def replace_preview(spark, sf_dir):
    """What a dry run shows."""
    return R.preview(docs(spark, sf_dir).select("doc_id", "text"), "oution", "<>")
