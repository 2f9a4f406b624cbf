"""Every query against its SQL on the given tables, and what no plan may contain."""

import os
import re

import pytest

from checks.compare import differences, views
from checks.oracle import oracle_sql
from ledgerlens.plans.queries import queries

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return views(PATH)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_equal_to_sql(spark, connection, name):
    df = QUERIES[name](spark, PATH)
    assert plan_faults(df) == []
    assert differences(df, connection, SQL[name]) == []


def plan_faults(df) -> list[str]:
    """Products of two tables, Python in the plan, and windows over a whole table. The
    one window without a partition allowed is that over the sizes of sorted ranges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|EvalPython|InPandas|InArrow", plan)
    first = re.findall(r"windowspecdefinition\(([^,)]+)", plan)
    return found + [f"window by {f}" for f in first if re.search(" (ASC|DESC) ", f) and not f.startswith("_range")]


def test_plan_faults_are_seen(spark):
    df = spark.range(5)
    assert len(plan_faults(df.selectExpr("row_number() over (order by id) AS n"))) == 1
    assert plan_faults(df.crossJoin(spark.range(3).withColumnRenamed("id", "other")))
    assert plan_faults(df.selectExpr("sum(id) over (partition by id % 2 order by id) AS n")) == []
