import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import neighbours
from revlens.operators.neighbours import nearest_rows
from revlens.session import co_partitioned


def _brute(rows, n):
    out = {}
    for key, rank, *x in rows:
        if any(v is None or math.isnan(v) for v in x):
            continue
        near = []
        for other, r, *y in rows:
            if other != key and not any(v is None or math.isnan(v) for v in y):
                near.append((-round(1 / (1 + math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), 9), r, other))
        for p, (_, _, other) in enumerate(sorted(near)[:n]):
            out[key, p + 1] = other
    return out


def _rows(kind):
    rng = random.Random(7)
    if kind == "spread":
        pts = [[rng.random() for _ in range(3)] for _ in range(600)]
    elif kind == "clusters":  # most points in two tight spots, some far away
        pts = [[rng.gauss(c, 0.001) for _ in range(3)] for c in (0.1, 0.9) for _ in range(250)] + [[rng.random() for _ in range(3)] for _ in range(40)]
    elif kind == "copies":  # a third of the rows are one point, the others lie on a lattice with many ties
        pts = [[0.5, 0.5, 0.5]] * 150 + [[rng.randrange(6) / 5 for _ in range(3)] for _ in range(300)]
    else:  # fewer rows than neighbours asked for
        pts = [[0.0, 0.0, 1.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [None, 0.0, 0.0], [float("nan"), 0.0, 0.0]]
    ranks = list(range(len(pts)))
    rng.shuffle(ranks)
    return [(f"p{i:04d}", ranks[i] // 2, *p) for i, p in enumerate(pts)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "few"])
def test_nearest_rows_equal_brute_force(spark, kind):
    rows = _rows(kind)
    df = spark.createDataFrame(rows, "name string, rank int, a double, b double, c double")
    got = nearest_rows(df, "name", ["a", "b", "c"], 5, ["rank"]).collect()
    assert {(r["name"], r["position"]): r["neighbour"] for r in got} == _brute(rows, 5)
    assert len(got) == len({(r["name"], r["position"]) for r in got})


def test_nearest_rows_of_no_rows(spark):
    df = spark.createDataFrame([], "name string, rank int, a double, b double")
    assert nearest_rows(df, "name", ["a", "b"], 5, ["rank"]).count() == 0


def test_cells_split_few_distinct_and_far_values_alike(spark):
    rng = random.Random(3)
    # one feature of four values, one far point, one crowded spot: every cell stays small and holds its points
    pts = [(rng.choice((0.0, 0.1, 0.2, 1.0)), rng.random() * 1e-3, rng.random()) for _ in range(6000)] + [(1e3, 1e3, 1e3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "point long, x0 double, x1 double, x2 double")
    cells = neighbours._placed(df, ["x0", "x1", "x2"]).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) == 6001 and max(r["count"] for r in cells) <= 4 * neighbours.CELL_POINTS
    assert len(cells) >= 6001 / neighbours.CELL_POINTS / 2


def test_distances_are_compiled_and_blocks_stay_in_their_task(spark, monkeypatch):
    plans, stored = [], neighbours.materialize

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(neighbours, "materialize", kept)
    df = spark.createDataFrame(_rows("spread"), "name string, rank int, a double, b double, c double")
    out = nearest_rows(df, "name", ["a", "b", "c"], 5, ["rank"])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("lambdafunction" in p for p in plans)  # lambdas of array functions are interpreted, one element at a time
    lists = next(p for p in plans if "row_number" in p and "b_cell" in p)
    assert "REPARTITION_BY_NUM" in lists and "ENSURE_REQUIREMENTS" not in lists  # visits and found rows are never shuffled


def test_reach_holds_enough_rows_and_few_more(spark):
    # a dense core and sparse outskirts, from where a loose bound takes in the core
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.02, (3000, 3)), rng.normal(0, 0.5, (1000, 3))])
    xs = ["x0", "x1", "x2"]
    df = spark.createDataFrame([(i, f"p{i}", 1, *map(float, p)) for i, p in enumerate(x)], "point long, key string, r int, x0 double, x1 double, x2 double")
    placed = neighbours._placed(df, xs)
    parts = placed.agg(F.max("grp")).first()[0] + 1
    got = {r["point"]: r["reach"] for r in neighbours._reaches(placed, xs, 6, parts).collect()}
    assert sorted(got) == list(range(len(x)))
    held = [int((np.sqrt(((x - x[i]) ** 2).sum(1)) <= got[i]).sum()) for i in range(len(x))]
    assert min(held) >= 6 and sum(held) / len(held) <= 6 * 4


def test_walk_is_split_between_groups_and_cells():
    # about 20 steps in one piece are more code than the JVM compiles
    sample = np.random.default_rng(2).normal(size=(2**17, 2))
    tree, down, on = neighbours._split_tree(sample)
    assert down + on >= 15 and max(down, on) <= 11
    node = np.zeros(len(sample), dtype=int)
    cols = {c: np.array(v) for c, v in tree.items()}
    for steps, ends in ((down, cols["grp"] >= 0), (on, cols["cell"] >= 0)):
        for _ in range(steps):
            below = np.where(sample[np.arange(len(sample)), cols["dim"][node]] <= cols["cut"][node], cols["low"][node], cols["high"][node])
            node = np.where(ends[node], node, below)
        assert ends[node].all()  # all have arrived
    assert np.bincount(cols["cell"][node]).max() <= neighbours.SAMPLE_POINTS


def test_units_are_those_of_the_rounded_value(spark):
    halves = [(0.1234567885,), (0.1234567895,), (0.5,), (1.0,), (1 / 3,), (0.9999999995,), (0.99999999949,), (1e-12,), (0.7000000005,), (0.2500000015,)]
    df = spark.createDataFrame(halves + [(random.Random(i).random(),) for i in range(500)], "s double")
    rows = df.select(neighbours._units(F.col("s")).alias("u"), F.round("s", neighbours.TIE).alias("r")).collect()
    assert all(r["u"] == round(r["r"] * 10**neighbours.TIE) for r in rows)


def test_co_partitioned_puts_the_setting_back(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), co_partitioned(spark):
        assert spark.conf.get(name) == "false"
        raise ValueError
    assert spark.conf.get(name) == before
