"""Faults found on larger tables, each on the few orders that show it."""

import pytest
from harness import compare, duck

import __spark_entry__


@pytest.fixture
def few(spark, tmp_path):
    """A folder whose orders have the given keys."""

    def make(*keys):
        rows = [(k, k % 1000) for k in keys]
        spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
        return str(tmp_path)

    return make


def same_as_sql(spark, name, folder):
    con = duck("/nowhere")
    con.sql(f"create view orders as select * from read_parquet('{folder}/orders.parquet/*.parquet')")
    return compare(__spark_entry__.queries()[name](spark, folder), con, __spark_entry__.oracle_sql()[name])


def test_blank_symbol_counts_in_a_stored_audit(spark, few):
    """The only symbol of these labels has a format and no value; it is linear evidence (EP-LIN-01)."""
    ok, message, n = same_as_sql(spark, "stored_audit", few(31746, 63492, 7))
    assert ok and n == 3, message


def test_decoded_scans_are_gathered_in_the_order_of_the_raw_ones(spark):
    """Neither gathering nor the join sorts decoded rows or facts: the sorts lie right above the exchanges of raw rows."""
    df = __spark_entry__.queries()["startrack_evidence"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("ObjectHashAggregate" in line for line in plan)
    after = [below for line, below in zip(plan, plan[1:], strict=False) if " Sort [" in line]
    assert after and all("Exchange" in below for below in after), after
