"""Queries on delimited tables and on JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import jsonq as J
from textloom.operators import tabular as T
from textloom.operators.jsonexpr import evaluate
from textloom.plans.params import Param
from textloom.plans.registry import query
from textloom.sources.raw import csv_records
from textloom.sources.scratch import scratch
from textloom.sources.tables import delimited, json_records, table


@query("csv_count", "SELECT count(*) AS count FROM orders", "tabular")
def csv_count(spark, sf_dir):
    """Rows of a table."""
    return T.count(table(spark, sf_dir, "orders"))


@query("csv_headers", " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, count({c}) AS n_values FROM customer" for i, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), 1)), "tabular")
def csv_headers(spark, sf_dir):
    """Columns and how many values they have."""
    return T.headers(table(spark, sf_dir, "customer"))


@query("csv_select", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "tabular", (Param("columns", "array", ("o_orderkey", "o_orderstatus", "o_totalprice")),))
def csv_select(spark, sf_dir, columns=("o_orderkey", "o_orderstatus", "o_totalprice")):
    """Some columns."""
    return table(spark, sf_dir, "orders").select(*columns)


@query("csv_slice", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100", "tabular", (Param("start", "integer", 100, minimum=0), Param("end", "integer", 150, minimum=0)))
def csv_slice(spark, sf_dir, start=100, end=150):
    """A range of rows in key order."""
    return T.slice_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], start, end)


@query("csv_sort", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer", "tabular")
def csv_sort(spark, sf_dir):
    """All rows with their places by balance."""
    return T.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"])


@query("csv_dedup", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem", "tabular")
def csv_dedup(spark, sf_dir):
    """Distinct rows of some columns."""
    return T.dedup(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query("csv_frequency", "SELECT event_type AS value, count(*) AS count, floor(count(*) * 1000.0 / sum(count(*)) OVER () + 0.5) / 10 AS percent FROM events GROUP BY event_type", "tabular", (Param("column", "string", "event_type"),))
def csv_frequency(spark, sf_dir, column="event_type"):
    """Values with count and percent."""
    return T.frequency(table(spark, sf_dir, "events"), column)


def _stats_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"SELECT '{c}' AS field, count({x}) AS n, count(*) - count({x}) AS nulls, min({x}) AS min, max({x}) AS max, round(avg({x}), 8) AS mean, round(stddev_samp({x}), 8) AS stddev, median({x}) AS median, count(DISTINCT {x}) AS \"distinct\" FROM lineitem"


@query("csv_stats", " UNION ALL ".join(map(_stats_sql, ("l_quantity", "l_extendedprice", "l_discount"))), "tabular")
def csv_stats(spark, sf_dir):
    """Statistics of numeric columns."""
    out = T.stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({"mean": F.round("mean", 8), "stddev": F.round("stddev", 8)})


SCHEMA = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, CASE WHEN count({c}) = 0 THEN 'null' WHEN count_if(regexp_full_match(CAST({c} AS VARCHAR), '[+-]?[0-9]+')) = count({c}) THEN 'integer' WHEN count_if(regexp_full_match(CAST({c} AS VARCHAR), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) = count({c}) THEN 'number' WHEN count_if(regexp_full_match(CAST({c} AS VARCHAR), '[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]([ T].*)?')) = count({c}) THEN 'date' ELSE 'string' END AS type, count({c}) < count(*) AS nullable FROM orders"
    for i, c in enumerate(("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), 1)
)


@query("csv_schema", SCHEMA, "tabular")
def csv_schema(spark, sf_dir):
    """Types that all values of a column, read as text, have."""
    return T.schema(table(spark, sf_dir, "orders"))


@query("csv_parse", "SELECT c_custkey, c_name, c_mktsegment FROM customer", "tabular")
def csv_parse(spark, sf_dir):
    """Quoted CSV lines, made from a table, read back as fields."""
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment").alias("line"))
    return delimited(lines, "line", "c_custkey bigint, c_name string, c_mktsegment string")


@query("column_extract", "SELECT o_orderkey, o_orderpriority AS first, CAST(o_custkey AS VARCHAR) AS second FROM orders", "tabular", (Param("columns", "array", (3, 2)),))
def column_extract(spark, sf_dir, columns=(3, 2)):
    """Some fields of tab-separated lines."""
    o = table(spark, sf_dir, "orders")
    lines = o.select("o_orderkey", F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority").alias("line"))
    own = T.columns_of(lines, "line", list(columns), "\t")
    return lines.select("o_orderkey", own[0].alias("first"), own[1].alias("second"))


@query("column_extract_regex", "SELECT doc_id, regexp_split_to_array(text, '[ ,.]+')[2] AS second, regexp_split_to_array(text, '[ ,.]+')[4] AS fourth FROM documents", "tabular")
def column_extract_regex(spark, sf_dir):
    """Some fields of texts, by a pattern between fields."""
    own = T.columns_of(None, "text", [2, 4], "[ ,.]+", is_regex=True)
    return table(spark, sf_dir, "documents").select("doc_id", own[0].alias("second"), own[1].alias("fourth"))


@query("csv_multiline", "SELECT doc_id, lang, md5(text) AS text_md5, 'x, \"' || source || '\"' AS note FROM documents WHERE text IS NOT NULL", "tabular")
def csv_multiline(spark, sf_dir):
    """A delimited file whose fields hold line feeds, separators and quotes, written by Spark and read back in parts."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    d = table(spark, sf_dir, "documents").where("text is not null")
    note = F.concat(F.lit('x, "'), "source", F.lit('"'))
    path = scratch(spark)
    # A null is a field without any characters; concat_ws alone would leave the field out.
    fields = [F.coalesce(c, F.lit("")) for c in (F.col("doc_id").cast("string"), quoted(F.col("lang")), quoted(F.col("text")), quoted(note))]
    d.select(F.concat_ws(",", *fields).alias("value")).write.text(path)
    read = csv_records(spark, path, "doc_id bigint, lang string, text string, note string")
    return read.select("doc_id", "lang", F.md5("text").alias("text_md5"), "note")


_ITEM = "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events"


def _nested(spark, sf_dir):
    """A document of each event: {"type", "items": [{"n", "t"}, {"n", "t"}, {"n"}], "o": {"b", "a"}}."""
    k = J.path(F.try_parse_json("props"), "$.k", "int")
    item = lambda n, **more: F.struct(n.alias("n"), *[c.alias(name) for name, c in more.items()])
    doc = F.struct(F.col("event_type").alias("type"), F.array(F.to_json(item(k, t=F.col("event_type"))), F.to_json(item(k + 1, t=F.lit("x"))), F.to_json(item(k + 2))).alias("i"), F.struct(k.alias("b"), F.lit("v").alias("a")).alias("o"))
    text = F.concat(F.lit('{"type":"'), doc["type"], F.lit('","items":['), F.concat_ws(",", doc["i"]), F.lit('],"o":'), F.to_json(doc["o"]), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("record"))


_EACH = f"WITH e AS ({_ITEM}), i AS (SELECT event_id, event_type, k + j AS n, j, CASE j WHEN 0 THEN event_type WHEN 1 THEN 'x' END AS t FROM e, range(3) r(j)) "


@query("json_expr_select", _EACH + "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY j) AS INT) AS pos, CAST(n AS VARCHAR) AS value FROM i WHERE n >= 50 AND t = 'x' OR n < 3", "json", (Param("expression", "string", '.items[] | select(.n >= 50 and .t == "x" or .n < 3) | .n', min_length=1),))
def json_expr_select(spark, sf_dir, expression='.items[] | select(.n >= 50 and .t == "x" or .n < 3) | .n'):
    """An expression that goes through arrays and keeps some elements."""
    return evaluate(_nested(spark, sf_dir), expression)


@query("json_expr_map", _EACH + "SELECT event_id, 1 AS pos, '[' || string_agg(coalesce('\"' || t || '\"', 'null'), ',' ORDER BY j) || ']' AS value FROM i GROUP BY event_id", "json")
def json_expr_map(spark, sf_dir):
    """One field of each element, as an array."""
    return evaluate(_nested(spark, sf_dir), ".items | map(.t)")


@query("json_expr_keys", f"WITH e AS ({_ITEM}) SELECT event_id, CAST(p AS INT) AS pos, CASE p WHEN 1 THEN '[\"items\",\"o\",\"type\"]' END AS value FROM e, (VALUES (1)) v(p)", "json")
def json_expr_keys(spark, sf_dir):
    """The names of an object."""
    return evaluate(_nested(spark, sf_dir), "keys")


@query("json_expr_length", f"WITH e AS ({_ITEM}) SELECT event_id, 1 AS pos, CAST(CASE WHEN k >= 90 THEN 3 WHEN k >= 89 THEN 2 WHEN k >= 88 THEN 1 ELSE 0 END AS VARCHAR) AS value FROM e", "json")
def json_expr_length(spark, sf_dir):
    """How many elements meet a test."""
    return evaluate(_nested(spark, sf_dir), ".items | map(select(.n >= 90)) | length")


@query("json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events", "json")
def json_path(spark, sf_dir):
    """A path of each record."""
    return table(spark, sf_dir, "events").select("event_id", J.path(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("json_select", "SELECT event_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50 AND event_type = 'click'", "json")
def json_select(spark, sf_dir):
    """Records that meet a condition on a path."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.where(J.path(F.try_parse_json("props"), "$.k", "int") >= 50).select("event_id", "event_type")


@query("json_slurp", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id", "json")
def json_slurp(spark, sf_dir):
    """All records of a key as one array."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("id"))
    return J.slurp(own, "user_id", "id", "event_id").select("user_id", F.concat_ws(",", "values").alias("ids"))


@query("json_explode", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) + i AS item, CAST(i AS INT) AS pos FROM events, range(3) r(i)", "json")
def json_explode(spark, sf_dir):
    """One row per element of an array in a document."""
    k = J.path(F.try_parse_json("props"), "$.k", "int")
    doc = F.concat(F.lit('{"items":['), F.concat_ws(",", k.cast("string"), (k + 1).cast("string"), (k + 2).cast("string")), F.lit("]}"))
    e = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return e.select("event_id", F.posexplode(F.from_json("doc", "items array<int>")["items"]).alias("pos", "item"))


@query("ndjson_skip_bad", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0", "json")
def ndjson_skip_bad(spark, sf_dir):
    """Lines of JSON, of which blank and broken ones are dropped."""
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 11 == 0, F.lit(" ")).otherwise(F.col("props"))
    lines = table(spark, sf_dir, "events").select("event_id", broken.alias("line"))
    return json_records(lines, "line").select("event_id", J.path(F.col("record"), "$.k", "int").alias("k"))


STREAM = "SELECT event_id, 1 AS pos, replace(props, ' ', '') AS value, event_id % 9 <> 0 AS complete FROM events UNION ALL SELECT event_id, 2, '{\"b\":[1,null],\"a\":\"}\"}', event_id % 9 <> 0 FROM events UNION ALL SELECT event_id, 3, '30', true FROM events WHERE event_id % 9 <> 0"


@query("json_stream", STREAM, "json")
def json_stream(spark, sf_dir):
    """JSON values one behind the other, compact or over several lines, as rows; complete: whether the whole text was read."""
    text = F.concat(F.regexp_replace("props", ":", ":\n  "), F.lit(' {"b": [1,\n null], "a": "}"} '), F.when(F.col("event_id") % 9 == 0, "nothing").otherwise("30"))
    return J.stream_values(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")


@query("xml_query", "SELECT event_id, event_type AS kind, round(value, 2) AS value FROM events WHERE event_type <> 'error'", "json")
def xml_query(spark, sf_dir):
    """Fields of XML documents."""
    xml = F.concat(F.lit("<e><kind>"), "event_type", F.lit("</kind><value>"), F.col("value").cast("string"), F.lit("</value></e>"))
    e = table(spark, sf_dir, "events").select("event_id", F.from_xml(xml, "kind string, value double").alias("x"))
    return e.where("x.kind <> 'error'").select("event_id", "x.kind", F.round("x.value", 2).alias("value"))
