"""Every query with SQL gives the rows of that SQL; the others run."""

import os

import duckdb
import pytest
from lodestrand import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(plain(r[k])) for k in order) for r in rows)


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return 0.0 if value == 0 and isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_are_those_of_the_sql(spark, con, sf, name):
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = catalogue.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert bag(got.columns, got.collect()) == bag(columns, rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_the_others_give_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
