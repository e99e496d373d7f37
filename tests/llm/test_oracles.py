from collections import Counter

import duckdb
import pytest

from tracewell.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf), db.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert ours == Counter(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
