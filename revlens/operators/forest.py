"""The fitted forest as a table: one row per leaf with its bounds, scored by a range join.

A stored forest can so be read, checked and applied with plain DataFrame (or
SQL) operators. A leaf is a box, lower < x <= upper in each feature. All bounds
come from the forest's thresholds, at most ``maxBins`` - 1 for each feature, so
boxes and rows are compared by the numbers of thresholds below them. Boxes are
listed under the cells of the features that split most, and rows meet only the
boxes of their own cell. The list is many times the forest, which its estimated
size doesn't show: both sides are dealt by cell and neither is broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["forest_nodes", "forest_leaves", "forest_thresholds", "score_forest"]

CELL_FEATURES = 4  # features whose intervals make up a cell
CELL_PARTS = 8     # intervals of each: at most CELL_PARTS ** CELL_FEATURES cells


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, prediction, left, right, feature, threshold) of a forest that ``save_model`` wrote; left is -1 in leaves."""
    n = spark.read.parquet(f"{path.rstrip('/')}/data")
    return n.select(F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.prediction").alias("prediction"),
                    F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                    F.col("nodeData.split.featureIndex").alias("feature"),
                    F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))


def _bounded(bounds: str, feature: Column, value: Column, pick) -> Column:
    return F.transform(bounds, lambda x, i: F.when(i == feature, pick(x, value)).otherwise(x))


def forest_leaves(nodes: DataFrame, n_features: int, max_depth: int) -> DataFrame:
    """(tree, node, prediction, lower, upper): each leaf with its bounds per feature.

    The boxes of a level come from those of the level above by one join with
    the nodes, from the roots down; a leaf stays as it is.
    """
    open_ = F.array(*[F.lit(float("-inf"))] * n_features), F.array(*[F.lit(float("inf"))] * n_features)
    level = nodes.filter(F.col("node") == 0).select("tree", "node", open_[0].alias("lower"), open_[1].alias("upper"))
    splits = nodes.drop("prediction")
    below = F.array(F.struct(F.col("left").alias("node"), "lower", _bounded("upper", F.col("feature"), F.col("threshold"), F.least).alias("upper")),
                    F.struct(F.col("right").alias("node"), _bounded("lower", F.col("feature"), F.col("threshold"), F.greatest).alias("lower"), "upper"))
    for _ in range(max_depth):
        at = level.join(splits, ["tree", "node"])
        level = at.select("tree", F.inline(F.when(F.col("left") < 0, F.array(F.struct("node", "lower", "upper"))).otherwise(below)))
    leaves = nodes.filter(F.col("left") < 0).select("tree", "node", "prediction")
    return level.join(leaves, ["tree", "node"]).select("tree", "node", "prediction", "lower", "upper")


def forest_thresholds(nodes: DataFrame, n_features: int) -> tuple[list[list[float]], list[int]]:
    """The thresholds of each feature in order (fewer than ``maxBins``), and the features by falling number of splits."""
    rows = (nodes.filter(F.col("left") >= 0).groupBy("feature")
            .agg(F.array_sort(F.collect_set("threshold")).alias("t"), F.count(F.lit(1)).alias("n")).collect())
    cuts: list[list[float]] = [[] for _ in range(n_features)]
    splits = [0] * n_features
    for r in rows:
        cuts[r["feature"]], splits[r["feature"]] = list(r["t"]), r["n"]
    return cuts, sorted(range(n_features), key=lambda f: (-splits[f], f))


def _below(cuts: list[float], value: Column, inclusive: bool = False) -> Column:
    """How many thresholds lie below a value (or at it)."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= value if inclusive else t < value))


def score_forest(rows: DataFrame, key: str, features: list[str], leaves: DataFrame, cuts: list[list[float]], order: list[int],
                 prediction: str = "prediction") -> DataFrame:
    """(key, prediction, n_trees): the mean over the trees of the one leaf that holds a row.

    Range join of rows and leaves: equality on the cell, bounds on the
    features. A row's leaves meet in one task, so the mean is formed before
    the shuffle. Rows with a null feature are in no leaf and have no result;
    NaN lies above every threshold.
    """
    used = [f for f in order if cuts[f]]
    cell = used[:CELL_FEATURES]

    def part(f: int, code: Column) -> Column:  # neighbouring intervals of a feature with more than CELL_PARTS go together
        return code if len(cuts[f]) < CELL_PARTS else F.floor(code * CELL_PARTS / (len(cuts[f]) + 1)).cast("int")

    x = rows.dropna(subset=features).select(F.col(key).alias("row_key"), *[_below(cuts[f], F.col(features[f]).cast("double")).alias(f"b{f}") for f in used])
    x = x.select("*", *[part(f, F.col(f"b{f}")).alias(f"c{f}") for f in cell])
    span = {f: (_below(cuts[f], F.col("lower")[f], inclusive=True), _below(cuts[f], F.col("upper")[f])) for f in used}
    boxes = leaves.select("tree", F.col("prediction").alias("leaf"), *[c.alias(f"{side}{f}") for f, pair in span.items() for side, c in zip(("lo", "hi"), pair, strict=True)])
    for f in cell:
        boxes = boxes.select("*", F.explode(F.sequence(part(f, F.col(f"lo{f}")), part(f, F.col(f"hi{f}")))).alias(f"c{f}"))
    inside = [x[f"b{f}"].between(boxes[f"lo{f}"], boxes[f"hi{f}"]) for f in used]
    same = [x[f"c{f}"] == boxes[f"c{f}"] for f in cell]
    met = x.join(boxes.hint("shuffle_hash"), reduce(and_, same + inside)) if used else x.crossJoin(boxes)  # without a split each tree is one leaf
    return met.groupBy(F.col("row_key").alias(key)).agg(F.avg("leaf").alias(prediction), F.count(F.lit(1)).alias("n_trees"))
