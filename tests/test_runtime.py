import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.runtime import broadcast_limit, number_rows, plan_bytes, skew_join, top_k


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed_facts(spark):
    values = [("hot", i) for i in range(40)] + [("a", 1), ("b", 2), ("b", 3), (None, 4), ("none", 5)]
    return spark.createDataFrame(values, "k STRING, v INT")


def test_skew_join_equals_plain_join(skewed):
    facts = skewed_facts(skewed)
    dim = skewed.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("z", 9)], "k STRING, d INT")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew_join(facts, dim, "k", how)) == rows(facts.join(dim, "k", how)), how
    assert rows(skew_join(facts, dim, "k", sliced=True)) == rows(facts.join(dim, "k"))


def test_many_null_keys_pass_by_the_join(skewed):
    facts = skewed.createDataFrame([(None, i) for i in range(50)] + [("a", 1), ("b", 2)], "k STRING, v INT")
    dim = skewed.createDataFrame([("a", 3), (None, 4)], "k STRING, d INT")
    for how in ("inner", "left", "left_anti"):
        assert rows(skew_join(facts, dim, "k", how)) == rows(facts.join(dim, "k", how)), how
    plan = skew_join(facts, dim, "k", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(k" in plan and "isnull(k" in plan


def test_hot_facts_are_not_shuffled_with_the_rest(skewed):
    facts = skewed_facts(skewed)
    dim = skewed.createDataFrame([("hot", 1)], "k STRING, d INT")
    plan = skew_join(facts, dim, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_small_dimension_needs_nothing_special(spark):
    facts, dim = skewed_facts(spark), spark.createDataFrame([("hot", 1)], "k STRING, d INT").coalesce(1)
    assert broadcast_limit(spark) == 10 * 1024 * 1024
    assert plan_bytes(dim) > 0
    assert rows(skew_join(facts, dim, "k", fact_rows=45)) == rows(facts.join(dim, "k"))


def test_number_rows_equals_row_number(spark):
    rng = random.Random(3)
    data = [("big", rng.randrange(50), i) for i in range(400)] + [("small", rng.randrange(5), i) for i in range(7)]
    df = spark.createDataFrame(data, "k STRING, x INT, y INT")
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("x", "y")).cast("long"))
    assert rows(number_rows(df, ["k"], ["x", "y"], "n")) == rows(expected)


def test_top_k_with_and_without_slices(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 101, i) for i in range(300)], "k INT, x INT, y INT")
    order = [F.desc("x"), F.asc("y")]
    expected = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("r <= 5")
    assert rows(top_k(df, ["k"], order, 5, "r")) == rows(expected)
    assert rows(top_k(df, ["k"], order, 5, "r", spread=8)) == rows(expected)
    assert "WindowGroupLimit" in top_k(df, ["k"], order, 5, "r")._jdf.queryExecution().executedPlan().toString()
