"""Every named query of the engine against its SQL in DuckDB, over the smallest test tables."""

import os

import duckdb
import pytest

from lodestone.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def cells(rows):
    return sorted(tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    order = sorted(df.columns)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == order
    rows = [[r[columns.index(c)] for c in order] for r in want.fetchall()]
    assert cells([[r[c] for c in order] for r in df.collect()]) == cells(rows)
