"""The registered queries: contracts, SQL, and one query an operator."""

import re

import __spark_entry__ as entry
import duckdb
import pytest
from lodestrand.llm import queries as q

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == list(range(1, 11))
    assert set(q.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(q.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(q.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = q.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_columns_of_contracts(spark, sf):
    want = {"op9_simhash": "doc_id fingerprint component_id", "op10_toxicity": "doc_id held_out score predicted", "op6_neighbours": "query_id rank vec_id score", "op5_mixing": "doc_id size source_size target taken"}
    for name, columns in want.items():
        assert q.QUERIES[name](spark, sf).columns[: len(columns.split())] == columns.split()
    rows = q.QUERIES["op9_simhash"](spark, sf).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] <= r["doc_id"] for r in rows)
