import random

from pyspark.sql import functions as F

from sessionlake.operators.asof import last_before


def test_last_mark_before_each_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-40, 400)]), rng.random() < 0.2) for _ in range(3_000)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "i int, key int, at int, marks boolean")
    got = {r.i: r.before for r in last_before(df, "key", "at", F.when(F.col("marks"), F.col("at")), 16, "before").collect()}
    assert len(got) == len(rows)
    for i, key, at, _ in rows:
        earlier = [t for _, k, t, m in rows if m and key is not None and k == key and None not in (t, at) and t <= at]
        assert got[i] == (max(earlier) if earlier else None)


def test_rows_are_dealt_by_key_and_slot(spark):
    df = spark.createDataFrame([(1, 1)], "key int, at int")
    plan = last_before(df, "key", "at", F.col("at"), 16, "before")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in plan and "__slot" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_empty(spark):
    assert last_before(spark.createDataFrame([], "key int, at int"), "key", "at", F.col("at"), 16, "before").count() == 0
