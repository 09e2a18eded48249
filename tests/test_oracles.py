"""Every registered query of the library against its SQL."""

import math

import duckdb
import pytest

from colmerge.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = sql.sql(oracle_sql()[name])
    assert columns == sorted(told.columns)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
    assert {c: kinds[k] for c, k in df.dtypes} == dict(zip(told.columns, map(str, told.types), strict=True))
    assert plain(df.select(columns).collect()) == plain(told.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
