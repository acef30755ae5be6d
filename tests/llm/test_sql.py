"""The operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from quantloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    r = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = [tuple(x[names.index(c)] for c in columns) for x in r.fetchall()]
    got = [tuple(x[c] for c in columns) for x in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
