import pytest

import __spark_entry__
from siftline import queries as core
from tests.conftest import SF
from tests.oracle import same, tables


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, name):
    same(core.QUERIES[name](spark, SF), tables(SF), core.ORACLE_SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["ksum", "n_matches"]
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_prune(spark):
    plan = core.QUERIES["probe_semi_sum"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
