"""Every registered query against its SQL, on the small tables."""

import duckdb
import pandas as pd
import pytest

from textloom.plans import QUERIES, run

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value as text; null, in whatever form, is a text of its own."""
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "<null>"
    try:
        return repr(round(float(v), 6)) if not isinstance(v, (str, bool)) and not hasattr(v, "isoformat") else str(v)
    except (TypeError, ValueError):
        return str(v)


def rows(df, columns):
    return sorted(tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [q.name for q in QUERIES.values() if q.oracle is not None])
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = run(spark, name, sf_dir).toPandas(), duck.execute(QUERIES[name].oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_every_query_has_sql():
    assert [q.name for q in QUERIES.values() if q.oracle is None] == []
