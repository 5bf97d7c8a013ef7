import pytest

from compare import rows_of, sql_rows
from genloom.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    got = rows_of(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert got == sql_rows(ORACLES[name], sf)
    else:
        assert got[1]


def test_entry_returns_discoveries(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_partkey", "w", "threshold"] and df.count() == 188


def test_scan_reads_only_what_is_needed(spark, sf):
    plan = QUERIES["position_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), GreaterThanOrEqual(l_partkey,50)" in plan and "l_comment" not in plan and "l_tax" not in plan
