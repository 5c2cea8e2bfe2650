"""Each query of the engine against its SQL, on the smallest driver tables."""

import datetime
import os

import duckdb
import pytest

from signet import inputs
from signet import queries as Q

SF = "/root/testdata/sf0.001"


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value.isoformat() if isinstance(value, datetime.date) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in inputs.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = Q.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(x) for x in row]) for row in found.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == want
