import pytest

from meltframe.plans.catalog import QUERIES
from meltframe.plans.oracle import ORACLE
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_answer_as_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLE[name]) == "ok"


def test_no_pair_joins_and_single_shuffle_for_the_parameters(spark):
    plan = QUERIES["empirical_params"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_sum" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_no_query_plans_a_cartesian_product(spark):
    for name in ("decode_candidates", "mean_impute", "banned_complement", "masked_update", "crowding_distance"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "row_id" and df.count() > 0
