"""Samples, heads and quantiles by counts, against the plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import selection as sel


def _rows(kind, n=3000):
    rng = random.Random(4)
    if kind == "equal":
        return [("same", 1.0)] * n
    if kind == "mixed":
        return [("same", 1.0)] * (n // 3) + [(f"k{rng.randrange(40)}", float(rng.randrange(9))) for _ in range(n)]
    return [(f"k{i}", rng.random()) for i in range(n)] + [(None, None), (None, 2.0), ("x", None), ("x", float("nan"))]


@pytest.mark.parametrize("kind", ["equal", "mixed", "distinct"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 2999, 10**6])
def test_sample_is_exact(spark, monkeypatch, kind, n):
    monkeypatch.setattr(sel, "SMALL", 5)  # the histogram goes through all its levels
    rows = _rows(kind)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = [tuple(r) for r in sel.sample_rows(df, n, ["k", "v"]).collect()]
    assert len(got) == min(n, len(rows))
    if n < 10**6 and kind != "distinct":
        have = {str(r): rows.count(r) for r in set(rows)}
        assert all(sum(str(x) == k for x in got) <= m for k, m in have.items())
    if n == 1000:
        other = spark.createDataFrame(rows[::-1], "k string, v double").coalesce(1)
        assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in sel.sample_rows(other, n, ["k", "v"]).collect())


@pytest.mark.parametrize("kind", ["equal", "mixed", "distinct"])
@pytest.mark.parametrize("n", [0, 1, 50, 1500, 10**6])
def test_head_equals_order_and_limit(spark, monkeypatch, kind, n):
    monkeypatch.setattr(sel, "SMALL", 20)
    monkeypatch.setattr(sel, "PIVOTS", 40)
    df = spark.createDataFrame(_rows(kind), "k string, v double").repartition(5)
    got = sorted(str(tuple(r)) for r in sel.head_rows(df, n, ["k", "v"]).collect())
    assert got == sorted(str(tuple(r)) for r in df.orderBy("k", "v").limit(n).collect())


def test_head_orders_few_rows(spark, monkeypatch):
    """What is ordered doesn't grow with the number of tasks."""
    monkeypatch.setattr(sel, "SMALL", 200)
    df = spark.range(0, 40_000, 1, 40).withColumn("k", (F.col("id") * 7919) % 40_009)
    head = sel.head_rows(df, 100, ["k", "id"])
    assert [r["k"] for r in head.collect()] == sorted((i * 7919) % 40_009 for i in range(40_000))[:100]
    plan = head._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalLimit 100" in plan and "Filter" in plan
    kept = df.filter(F.col("k") <= 4 * 100 + 200).count()
    assert kept <= 4 * 100 + 201


def test_quantiles_equal_percentile(spark, monkeypatch):
    monkeypatch.setattr(sel, "SMALL", 5)
    monkeypatch.setattr(sel, "CELLS", 8)
    rng = random.Random(9)
    for values in ([1.0], [1.0, 2.0], [5.0] * 50, [rng.choice([1, 2, 3, 4.5]) for _ in range(400)],
                   [rng.gauss(0, 1) * 10 ** rng.randrange(-3, 200) for _ in range(500)], [1e308, -1e308, 0.0, 3.0, 7.0, 9.0, 11.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        probs = [0.0, 0.25, 0.5, 0.9, 1.0]
        got = list(agg.exact_quantiles(df, "v", probs).head())
        valid = df.filter("v IS NOT NULL AND NOT isnan(v)")
        want = valid.agg(*[F.percentile("v", p) for p in probs]).head()
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b, rel=1e-12) or str(a) == str(b)
    empty = spark.createDataFrame([], "v double")
    assert list(agg.exact_quantiles(empty, "v", [0.5]).head()) == [None]


def test_profile_carries_no_row_twice(spark):
    df = spark.createDataFrame(_rows("mixed"), "k string, v double")
    profile = agg.dataset_profile(df, "v", text_cols=["k"])
    assert "Expand" not in profile._jdf.queryExecution().optimizedPlan().toString()
    row = profile.head()
    assert row["unique_k"] == df.select("k").distinct().count() and row["v_median"] == df.agg(F.round(F.median("v"), 4)).head()[0]
