"""Each query of the engine beside its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from keystrata.plans import catalog, engine  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def plain(x):
    if isinstance(x, (decimal.Decimal, float)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted_rows(got.columns, [tuple(r) for r in got.collect()]) == sorted_rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
