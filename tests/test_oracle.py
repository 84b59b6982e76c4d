"""Every query that SQL can express gives the same rows as DuckDB."""

import pytest

from tesserae import catalog

SQL = catalog.oracle_sql()


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in places) for r in rows), key=lambda r: [(v is None, str(type(v)), v if not isinstance(v, list) else str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == ordered(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
