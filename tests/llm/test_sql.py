import pytest

from sessionlake.llm import queries
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_native_queries_run_no_python(spark):
    for name in ("op3_quality", "op7_urls"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
