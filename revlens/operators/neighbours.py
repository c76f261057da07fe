"""Exact nearest neighbours of every row (O-76 for all seeds).

A tree of median splits, fitted on a bounded sample, deals the rows into cells
of about CELL_POINTS points and these into blocks. The distances inside its own
cell bound how far a row has to look (a ladder of radii, counted by one
aggregate); it then visits the cells whose box lies nearer. Each block gets the
rows of the cells that its own visit, once, and pairs, distances and the best
rows of each seed are made inside the block by compiled joins. The sample decides
the cost only: every row is placed, and no bound drops a neighbour, so the result
is that of comparing all with all, ties included.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import co_partitioned, materialize

__all__ = ["nearest_rows"]

CELL_POINTS = 64       # points of a cell
SAMPLE_POINTS = 4      # sampled points of a cell
SAMPLE_LIMIT = 2**20   # sampled points of all cells; beyond 16 million points cells grow, results don't change
POOL_CELLS = 8         # cells that a row's distance bound is refined in
GROUP_CELLS = 256      # cells of a block: what one task searches, and whose common box is compared first
GROUPS = 64            # blocks at least, where there are cells for as many
RADII = 16             # radii that rows are counted at
STEPS = {"cell": 0.75, "pool": 0.9}  # each as a part of the next greater: coarse and far down first, then fine
TIE = 9                # similarities equal to this many decimals are ties


def _sum_squares(gaps: list[Column]) -> Column:
    return F.sqrt(reduce(add, [g * g for g in gaps]))


def _slack(d: Column) -> Column:
    """Distance beyond ``d`` that a tie may hide: similarities there differ by at most two units of the last decimal."""
    return F.lit(2.0 * 10**-TIE) * (F.lit(1.0) + d) * (F.lit(1.0) + d)


def _box_gaps(dims: range, a: str, b: str) -> Column:
    """Least distance of two boxes; ``a`` and ``b`` are prefixes of their lo / hi columns."""
    lo, hi = (lambda p, i: F.col(f"{p}lo{i}")), (lambda p, i: F.col(f"{p}hi{i}"))
    return _sum_squares([F.greatest(F.lit(0.0), lo(b, i) - hi(a, i), lo(a, i) - hi(b, i)) for i in dims])


def _units(similarity: Column) -> Column:
    """``round(similarity, TIE)`` in units of its last decimal; the decimal arithmetic is left to values near a half unit."""
    scaled = similarity * F.lit(10.0**TIE)
    near_half = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) < F.lit(1e-4)
    return F.floor(F.when(near_half, F.round(similarity, TIE) * F.lit(10.0**TIE)).otherwise(scaled) + F.lit(0.5))


def _split_tree(sample: np.ndarray) -> tuple[dict[str, list], int, int]:
    """Nodes of the tree over the sample (dim, cut, children; grp, pool and cell from where they begin), steps down to a group, and on to a cell."""
    tree: dict[str, list] = {"dim": [], "cut": [], "low": [], "high": [], "cell": [], "pool": [], "grp": [], "top": []}
    down, on, cells, pools, groups = 0, 0, 0, 0, 0
    pooled = SAMPLE_POINTS * POOL_CELLS
    block = max(pooled, min(SAMPLE_POINTS * GROUP_CELLS, len(sample) // GROUPS))
    todo = [(sample, 0, -1, "", -1, -1)]
    while todo:
        pts, level, parent, side, group, pool = todo.pop()
        node = len(tree["dim"])
        if parent >= 0:
            tree[side][parent] = node
        leaf = len(pts) <= SAMPLE_POINTS or bool((pts == pts[0]).all())
        top = group < 0
        if top and (leaf or len(pts) <= block):
            group, groups, down, level = groups, groups + 1, max(down, level), 0
        if pool < 0 and (leaf or len(pts) <= pooled):
            pool, pools = pools, pools + 1
        spread = pts.max(0) - pts.min(0) if len(pts) else np.zeros(sample.shape[1])
        dim, cut = int(spread.argmax()), 0.0
        if not leaf:
            x = pts[:, dim]
            cut = float(np.partition(x, len(x) // 2)[len(x) // 2])
            if not (x > cut).any():
                cut = float(x[x < cut].max())
        for name, value in {"dim": dim, "cut": cut, "low": node, "high": node, "cell": cells if leaf else -1, "pool": pool, "grp": group, "top": top}.items():
            tree[name].append(value)
        if leaf:
            cells, on = cells + 1, max(on, level)
        else:
            todo += [(pts[x <= cut], level + 1, node, "low", group, pool), (pts[x > cut], level + 1, node, "high", group, pool)]
    return tree, down, on


def _walked(at: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``_node`` after so many steps; outer joins, as inner ones would test each step for null, which makes the code too long to be compiled."""
    rest = [c for c in at.columns if c != "_node"]
    step = F.broadcast(nodes.select("_node", "dim", "cut", "low", "high"))  # fewer than 2 nodes for each sampled point
    for _ in range(steps):
        at = at.join(step, "_node", "left").select(*rest, F.when(F.get("_x", F.col("dim")) <= F.col("cut"), F.col("low")).otherwise(F.col("high")).alias("_node"))
    return at


def _placed(rows: DataFrame, xs: list[str], points: DataFrame | None = None) -> DataFrame:
    """Rows with their cell, pool and group, dealt by group and walked down a tree that a sample of ``points`` (the rows without copies) fixes."""
    points = rows if points is None else points
    n = points.count()
    share = min(1.0, SAMPLE_POINTS / CELL_POINTS, SAMPLE_LIMIT / max(n, 1))
    drawn = points.filter(F.pmod(F.xxhash64(*xs), F.lit(2**20)) < F.lit(int(np.ceil(share * 2**20)))).select(*xs)
    sample = drawn.toPandas().to_numpy(dtype="float64").reshape(-1, len(xs))
    tree, down, on = _split_tree(sample)
    nodes = pd.DataFrame({"_node": np.arange(len(tree["dim"])), **tree})
    nodes = materialize(rows.sparkSession.createDataFrame(nodes, "_node int, dim int, cut double, low int, high int, cell int, pool int, grp int, top boolean"))
    stay = lambda c: F.when(F.col("grp") < 0, F.col(c)).otherwise(F.col("_node")).alias(c)
    at = rows.select(*rows.columns, F.array(*xs).alias("_x"), F.lit(0).alias("_node"))
    at = _walked(at, nodes.filter("top").select("_node", "dim", "cut", stay("low"), stay("high")), down)
    at = at.join(F.broadcast(nodes.filter("top").select("_node", "grp")), "_node").repartition(max(tree["grp"]) + 1, "grp")
    at = _walked(at, nodes.filter("grp >= 0"), on).join(F.broadcast(nodes.filter("cell >= 0").select("_node", "cell", "pool")), "_node")
    return at.drop("_node", "_x").sortWithinPartitions("cell")  # rows that are compared lie together


def _cell_pairs(cells: DataFrame, dims: range, parts: int) -> DataFrame:
    """(grp, cell, b_cell): cells that a row of ``cell`` may have to visit; groups of cells are compared first."""
    sides = [f"{s}{i}" for s in ("lo", "hi") for i in dims]
    groups = cells.groupBy("grp").agg(*[F.min(f"lo{i}").alias(f"g_lo{i}") for i in dims], *[F.max(f"hi{i}").alias(f"g_hi{i}") for i in dims])
    mine = cells.repartition(parts, "cell").select("cell", F.col("grp").alias("home"), "reach", *[F.col(c).alias(f"a_{c}") for c in sides])
    theirs = cells.select(F.col("cell").alias("b_cell"), "grp", *[F.col(c).alias(f"b_{c}") for c in sides])
    met = mine.crossJoin(F.broadcast(groups)).filter(_box_gaps(dims, "a_", "g_") <= F.col("reach")).drop(*[f"g_{c}" for c in sides])
    met = met.join(F.broadcast(theirs), "grp").filter(_box_gaps(dims, "a_", "b_") <= F.col("reach"))
    return met.select(F.col("home").alias("grp"), "cell", "b_cell")


def _bounded(rows: DataFrame, near: DataFrame, by: str, xs: list[str], k: int) -> DataFrame:
    """``reach`` lowered to the least radius of a ladder below ``top`` that holds ``k`` rows of the same ``by``, if one does."""
    d = _sum_squares([F.col(x) - F.col(f"y{i}") for i, x in enumerate(xs)])
    near = near.select("grp", by, *[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)])
    met = rows.join(near.hint("shuffle_hash"), ["grp", by]).withColumn("_d", d).filter(F.col("_d") <= F.col("top"))  # every point meets its own rows
    radii = [F.lit(0.0), *[F.lit(STEPS[by] ** i) * F.col("top") for i in reversed(range(RADII))]]
    counted = met.groupBy(*rows.columns).agg(*[F.count_if(F.col("_d") <= r).alias(f"_n{j}") for j, r in enumerate(radii)])
    least = F.coalesce(*[F.when(F.col(f"_n{j}") >= k, r) for j, r in enumerate(radii)], F.col("reach"))
    return counted.select(*[c for c in rows.columns if c not in ("top", "reach")], least.alias("reach"))


def _reaches(placed: DataFrame, xs: list[str], k: int, parts: int) -> DataFrame:
    """Points (rows with ``r`` of 1) and their ``reach``, a distance within which lie ``k`` rows at least, and the ties of the last of them."""
    dims = range(len(xs))
    lows, highs = [F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)], [F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]
    cells = materialize(placed.groupBy("cell", "pool", "grp").agg(F.count(F.lit(1)).alias("rows"), *lows, *highs))
    across = _sum_squares([F.max(f"hi{i}") - F.min(f"lo{i}") for i in dims])
    bounds = cells.select("cell", "pool", "grp")
    for by in ("cell", "pool", "grp"):  # the whole box of the cell, pool or group that has k rows
        bounds = bounds.join(cells.groupBy(by).agg(F.when(F.sum("rows") >= k, across).alias(f"_{by}"), (F.lit(0.5) * across).alias(f"_top_{by}")), by)
    bounds = bounds.select("cell", F.col("_top_cell").alias("top"), F.coalesce("_cell", "_pool", "_grp", F.lit(float("inf"))).alias("reach"))
    dealt = placed.repartition(parts, "grp")
    seeds = dealt.filter(F.col("r") == 1).select("grp", "cell", "pool", "point", *xs)
    seeds = _bounded(seeds.join(F.broadcast(bounds), "cell"), dealt, "cell", xs, k)
    seeds = _bounded(seeds.withColumn("top", F.col("reach")), dealt, "pool", xs, k)
    return seeds.withColumn("reach", F.col("reach") + _slack(F.col("reach")))


def nearest_rows(rows: DataFrame, key: str, features: list[str], n: int, order: list[str]) -> DataFrame:
    """(key, position, neighbour, similarity): the ``n`` rows most similar to each row, itself left out.

    Similarity is 1 / (1 + Euclidean distance), ties (TIE decimals) go by
    ``order`` and the key. Keys are unique; rows with a null or NaN feature
    are left out; fewer than ``n`` other rows are all returned.
    """
    dims = range(len(features))
    k = n + 1  # a row is its own nearest
    xs, ys = [f"x{i}" for i in dims], [f"y{i}" for i in dims]
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in xs])
    base = materialize(rows.select(F.col(key).alias("key"), F.struct(*order).alias("ord"),
                                   *[(F.col(f).cast("double") + F.lit(0.0)).alias(x) for f, x in zip(features, xs, strict=True)]))
    base = materialize(base.filter(ok).orderBy("ord", "key").select(F.monotonically_increasing_id().alias("pos"), "key", *xs))  # pos: as ties go
    # of equal rows (a point) the first k stand for all: later ones come after k equal ones everywhere
    equal = Window.partitionBy(*xs).orderBy("pos")
    first = base.withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= k)
    first = materialize(first.withColumn("point", F.first("pos").over(equal)))
    placed = materialize(_placed(first, xs, first.filter(F.col("r") == 1)))
    parts = placed.agg(F.max("grp")).first()[0]
    parts = 1 if parts is None else parts + 1
    with co_partitioned(rows.sparkSession):  # a block's rows meet in one task for all of its joins
        seeds = materialize(_reaches(placed, xs, k, parts))
        cells = materialize(seeds.groupBy("cell", "grp").agg(F.max("reach").alias("reach"), *[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]))
        pairs = materialize(_cell_pairs(cells, dims, parts))
        boxes = F.broadcast(cells.select(F.col("cell").alias("b_cell"), *[F.col(f"{s}{i}") for s in ("lo", "hi") for i in dims]))
        near = pairs.repartition(parts, "grp").join(boxes, "b_cell")
        edge = _sum_squares([F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(x), F.col(x) - F.col(f"hi{i}")) for i, x in enumerate(xs)])
        visits = (seeds.repartition(parts, "grp").join(near.hint("shuffle_hash"), ["grp", "cell"]).filter(edge <= F.col("reach"))
                  .select("grp", "point", "reach", "b_cell", *xs))
        others = placed.select(F.col("cell").alias("b_cell"), F.col("pos").alias("b_pos"), F.col("key").alias("neighbour"), *[F.col(x).alias(y) for x, y in zip(xs, ys, strict=True)])
        others = materialize(visits.select("grp", "b_cell").distinct()).join(others, "b_cell").repartition(parts, "grp")
        dist = _sum_squares([F.col(x) - F.col(y) for x, y in zip(xs, ys, strict=True)])
        found = (visits.join(others.hint("shuffle_hash"), ["grp", "b_cell"]).withColumn("_d", dist).filter(F.col("_d") <= F.col("reach"))
                 .withColumn("similarity", F.lit(1.0) / (F.lit(1.0) + F.col("_d"))))
        found = found.select("point", "grp", "neighbour", "b_pos", "similarity", _units(F.col("similarity")).alias("_units"))
        best = [F.desc("_units"), "b_pos"]
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("point", "grp").orderBy(*best))).filter(F.col("_n") <= k).drop("_n")
        mine = placed.select("grp", "point", "pos", "key", "r").repartition(parts, "grp")
        found = found.join(mine.hint("shuffle_hash"), ["grp", "point"]).filter(F.col("b_pos") != F.col("pos"))
        found = found.withColumn("position", F.row_number().over(Window.partitionBy("pos", "grp").orderBy(*best))).filter(F.col("position") <= n)
        lists = materialize(found.select("pos", "key", "r", "position", "neighbour", "similarity"))
    # rows after the first k of a point have the list of its k-th one: n equal rows come before that
    last = base.join(first.filter(F.col("r") == k).select(F.col("pos").alias("_kth"), *xs), xs).filter(F.col("pos") > F.col("_kth"))
    later = last.select(F.col("key").alias("_key"), F.col("_kth").alias("pos")).join(lists.filter(F.col("r") == k).drop("key", "r"), "pos")
    cols = ["position", "neighbour", "similarity"]
    return lists.select(F.col("key").alias(key), *cols).unionByName(later.select(F.col("_key").alias(key), *cols))
