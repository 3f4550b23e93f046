"""Every query against its SQL in DuckDB, on whole tables."""

import math

import duckdb
import pytest

from quillmark.catalog.oracles import ORACLES
from quillmark.catalog.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _value(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    ours = QUERIES[name](spark, sf)
    theirs = duck.execute(ORACLES[name])
    columns = sorted(ours.columns)
    kinds = {c[0]: str(c[1]) for c in theirs.description}
    assert columns == sorted(kinds)
    assert {c: TYPES[t] for c, t in ours.dtypes} == kinds
    order = [c[0] for c in theirs.description]
    expected = sorted(
        (tuple(_value(r[order.index(c)]) for c in columns) for r in theirs.fetchall()), key=repr
    )
    got = sorted((tuple(r) for r in ours.select(*columns).collect()), key=repr)
    assert got == expected
