"""Every catalogued query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from emberline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.6g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, sf, name):
    found = catalogue.queries()[name](spark, sf)
    columns = sorted(found.columns)
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(normal(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(normal(row[c]) for c in columns) for row in found.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0
