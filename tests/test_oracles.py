"""Each query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fieldloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that round to four or five places.
ROUGH = {n for n, sql in plans.SQL.items() if ", 5)" in sql or ", 4)" in sql}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(df):
    """Rows as (texts, numbers), in the order of the texts and then of the numbers' first places."""
    columns = sorted(df.columns)
    made = []
    for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist():
        made.append((tuple(str(v) for v in r if not isinstance(v, float)), tuple(v + 0.0 for v in r if isinstance(v, float))))
    return columns, sorted(made, key=lambda r: (r[0], [round(v, 3) for v in r[1]]))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    """Six places, but for a last place that engines round either way: means of two prices end in a 5 there."""
    columns, got = rows(plans.QUERIES[name](spark, DATA).toPandas())
    names, want = rows(duck.execute(plans.SQL[name]).df())
    assert columns == names and [g[0] for g in got] == [w[0] for w in want]
    for (_, a), (_, b) in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9, abs=1.1e-6 if name not in ROUGH else 1.1e-4)


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["county_id", "year", "key", "n", "target", "features"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
