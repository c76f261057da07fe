import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import ranking


def _random_counts(spark, n=500, seed=7):
    rnd = random.Random(seed)
    rows = [(f"k{i:04d}", rnd.randint(0, 30)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, n long")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_global_ranks_equal_window_version(spark, parts):
    df = _random_counts(spark)
    a = ranking.global_ranks(df, [("n", False)], [("key", True)], num_partitions=parts)
    b = ranking.window_ranks(df, [("n", False)], [("key", True)])
    cols = ["key", "n", "rank", "dense_rank", "row_number"]
    ga = sorted(tuple(r) for r in a.select(*cols).collect())
    gb = sorted(tuple(r) for r in b.select(*cols).collect())
    assert ga == gb
    pa = {r.key: r.percent_rank for r in a.collect()}
    pb = {r.key: r.percent_rank for r in b.collect()}
    assert all(abs(pa[k] - pb[k]) < 1e-12 for k in pa)


def test_global_row_number_skewed_key(spark):
    # a third of the rows share one value: ranks stay exact
    rows = [(f"a{i}", 5) for i in range(100)] + [(f"b{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, n long")
    out = ranking.global_ranks(df, [("n", False)], [("key", True)], num_partitions=4)
    fives = out.filter(F.col("n") == 5).select("rank").distinct().collect()
    assert len(fives) == 1
    rn = sorted(r.row_number for r in out.select("row_number").collect())
    assert rn == list(range(1, 301))


def test_top_n_per_group_and_top_n(spark):
    df = spark.createDataFrame([("S1", "a", 3.0), ("S1", "b", 2.0), ("S1", "c", 1.0), ("S2", "d", 1.0)],
                               "State string, City string, score double")
    out = ranking.top_n_per_group(df, ["State"], [("score", False), ("City", True)], 2).collect()
    assert sorted((r.State, r.City) for r in out) == [("S1", "a"), ("S1", "b"), ("S2", "d")]
    top = ranking.top_n(df, [("score", False), ("City", True)], 2, where=F.col("score") < 3).collect()
    assert [r.City for r in top] == ["b", "c"]


def test_top_k_plans_as_take_ordered(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    plan = ranking.top_n(df, [("v", False), ("id", True)], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_rank_change_and_sequential(spark):
    df = spark.createDataFrame([("a", 0.9, 2), ("b", 0.5, 1)], "k string, s double, old int")
    out = ranking.rank_change(ranking.sequential_rank(df, "s", "k", "new", distributed=True), "old", "new")
    got = {r.k: r.rank_change for r in out.collect()}
    assert got == {"a": 1, "b": -1}


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_grouped_ranks_equal_partitioned_window(spark, parts):
    import random as _r
    rnd = _r.Random(3)
    # one group holds a third of the rows
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", f"k{i:04d}", rnd.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, key string, n long")
    a = ranking.global_ranks(df, [("n", False)], [("key", True)], group=["grp"], num_partitions=parts)
    b = ranking.window_ranks(df, [("n", False)], [("key", True)], partition=["grp"])
    cols = ["grp", "key", "n", "rank", "dense_rank", "row_number"]
    assert sorted(tuple(r) for r in a.select(*cols).collect()) == sorted(tuple(r) for r in b.select(*cols).collect())
    pa = {r.key: r.percent_rank for r in a.collect()}
    pb = {r.key: r.percent_rank for r in b.collect()}
    assert all(abs(pa[k] - pb[k]) < 1e-12 for k in pa)


def test_sequential_rank_equals_the_window(spark):
    df = _random_counts(spark, 300)
    wide = {r.key: r.rk for r in ranking.sequential_rank(df, "n", "key", "rk").collect()}
    alone = {r.key: r.rk for r in ranking.sequential_rank(df, "n", "key", "rk", distributed=False).collect()}
    assert wide == alone and sorted(wide.values()) == list(range(1, 301))
