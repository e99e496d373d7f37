import pytest

from tracewell.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.INPUTS))
def test_reads_every_row(spark, name):
    rows = Q.queries()[f"{name}_events"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/events.parquet").count()
