"""Every query of the library gives the rows that its SQL gives in another engine."""

import math
from collections import Counter

import duckdb
import pytest

from tracewell.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def other():
    db = duckdb.connect()
    for t in ("events", "pages", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_same_rows(spark, other, name):
    got = Q.queries()[name](spark, SF)
    want = other.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = Counter(tuple(map(plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", sorted(Q.EDGES))
def test_edge_cases(spark, other, name):
    column, kind, rows, out, _ = Q.EDGES[name]
    got = spark.createDataFrame([(r,) for r in rows], f"{column} {kind}").select(column, *[f(Q.F.col(column)).alias(n) for n, f in out.items()])
    want = other.sql(Q.edge_sql(name)).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in want)
