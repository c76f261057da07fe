"""Popularity model (O-79..O-86) on Spark ML.

The forest is Spark's distributed RandomForestRegressor (binned split
search over partitions); the split, folds and metrics are column
expressions and aggregates, so nothing is collected to the driver except the
fitted trees and a handful of metric values.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from revlens import constants as K
from revlens.functions.columns import expm1_long

__all__ = [
    "FEATURE_COLS", "TARGET", "engineer_features", "hash_split", "train_forest", "regression_metrics",
    "cross_validate", "feature_importances", "test_predictions", "all_predictions", "save_model",
]

# the leakage-safe feature set
FEATURE_COLS = ["avg_rating", "rating_std", "avg_polarity", "avg_subjectivity", "city_avg_rating",
                "city_place_count", "city_avg_polarity", "city_five_star_rate"]
TARGET = "log_popularity"
FOREST = K.FOREST
CV_TREES = K.CV_TREES
PART_ROWS = 250_000   # rows of a training partition, which is kept with a count and a node of each tree for every row
AT_ONCE_ROWS = 500_000  # training rows up to which the folds are fitted at the same time


def engineer_features(df: DataFrame) -> DataFrame:
    """O-79: target log1p(review_count), rows with a NULL feature dropped, vector column."""
    out = df.withColumn(TARGET, F.log1p(F.col("review_count").cast("double"))).dropna(subset=FEATURE_COLS + [TARGET])
    return VectorAssembler(inputCols=FEATURE_COLS, outputCol="features").transform(
        out.withColumns({c: F.col(c).cast("double") for c in FEATURE_COLS}))


def hash_split(df: DataFrame, key: str, test_pct: int = K.TEST_PERCENT, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """O-80: deterministic split on a seeded key hash (independent of partitioning)."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return df.filter(bucket >= test_pct), df.filter(bucket < test_pct)


def _dealt(train: DataFrame, n: int) -> DataFrame:
    """Features and target in even partitions: as many as cores, or a multiple of it where they would pass PART_ROWS rows.

    Every partition sends the statistics of all nodes of a level, so their
    number follows the cores and not the files of the input. Rows are dealt and
    ordered by their hash: the forest depends on the rows and the cores only.
    """
    cores = max(1, train.sparkSession.sparkContext.defaultParallelism)
    turns = max(1, -(-n // (PART_ROWS * cores)))
    hashed = train.select("features", TARGET, F.xxhash64(*train.columns).alias("_hash"))
    return hashed.repartition(cores * turns, "_hash").sortWithinPartitions("_hash").select("features", TARGET)


def train_forest(train: DataFrame, num_trees: int = FOREST["numTrees"]) -> RandomForestRegressionModel:
    """O-81: 200 trees, depth 10, min leaf 8, every feature considered at each split.

    The node that a row has reached is kept for each tree, so a level doesn't
    walk the trees from their roots; all levels of a forest are few enough to
    need no checkpoint between them.
    """
    rf = RandomForestRegressor(featuresCol="features", labelCol=TARGET, numTrees=num_trees,
                               maxDepth=FOREST["maxDepth"], minInstancesPerNode=FOREST["minInstancesPerNode"],
                               featureSubsetStrategy="all", seed=FOREST["seed"], cacheNodeIds=True, checkpointInterval=-1)
    return rf.fit(_dealt(train, train.count()))


def regression_metrics(pred: DataFrame, label: str = TARGET, prediction: str = "prediction",
                       prefix: str = "") -> DataFrame:
    """O-82: MAE, RMSE, R^2 (4 dp) as one aggregate row."""
    err = F.col(label) - F.col(prediction)
    g = pred.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 F.sum(err * err).alias("ss_res"),
                 (F.var_pop(label) * F.count(label)).alias("ss_tot"))
    return g.select(F.round("mae", 4).alias(f"{prefix}mae"), F.round("rmse", 4).alias(f"{prefix}rmse"),
                    F.round(F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("ss_tot")), 4).alias(f"{prefix}r2"))


def cross_validate(train: DataFrame, key: str, folds: int = K.CV_FOLDS, seed: int = 42,
                   num_trees: int = CV_TREES) -> DataFrame:
    """O-83: k-fold R^2 on the training part: mean and population std (4 dp).

    Folds of up to AT_ONCE_ROWS training rows are fitted at the same time: each
    fit is a chain of jobs that leaves cores idle at its narrow steps. More rows
    fill the cores by themselves, and one fold after the other keeps one copy of them.
    """
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(folds))
    t = train.withColumn("_fold", fold)

    def score(k: int) -> DataFrame:
        model = train_forest(t.filter(F.col("_fold") != k), num_trees)
        return regression_metrics(model.transform(t.filter(F.col("_fold") == k))).select(F.lit(k).alias("fold"), F.col("r2"))

    with ThreadPoolExecutor(folds if t.count() <= AT_ONCE_ROWS else 1) as pool:
        scores = list(pool.map(inheritable_thread_target(train.sparkSession)(score), range(folds)))
    allf = reduce(DataFrame.unionByName, scores)
    return allf.agg(F.round(F.avg("r2"), 4).alias("cv_r2_mean"), F.round(F.stddev_pop("r2"), 4).alias("cv_r2_std"))


def feature_importances(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """O-84: importances sorted descending with their share of the total."""
    imp = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(FEATURE_COLS, [float(x) for x in imp])), "feature string, importance double")
    total = df.select(F.sum("importance")).scalar()
    # one row per feature, a table bounded by the feature list
    return df.select("feature", F.round("importance", 6).alias("importance"),
                     F.round(F.try_divide(F.col("importance"), total), 6).alias("share")
                     ).orderBy(F.desc("importance"), "feature")


def test_predictions(model: RandomForestRegressionModel, test: DataFrame, key: str) -> DataFrame:
    """O-85: actual, predicted (4 dp), residual and both back-transformed counts."""
    p = model.transform(test)
    return p.select(key, F.round(TARGET, 4).alias("actual"), F.round("prediction", 4).alias("predicted"),
                    F.round(F.col(TARGET) - F.col("prediction"), 4).alias("residual"),
                    expm1_long(TARGET).alias("actual_review_count"),
                    expm1_long("prediction").alias("predicted_review_count"))


def all_predictions(model: RandomForestRegressionModel, features: DataFrame, key: str) -> DataFrame:
    """O-86 + O-69b: predictions for every place and a min-method popularity rank.

    The rank is computed distributed (range partition + offsets)."""
    from revlens.operators.ranking import global_ranks
    p = model.transform(features).select(key, "review_count", "avg_rating", F.round("prediction", 4).alias("predicted_log_popularity"))
    p = p.withColumn("predicted_review_count", expm1_long("predicted_log_popularity"))
    r = global_ranks(p, [("predicted_log_popularity", False)], [(key, True)],
                     names={"rank": "popularity_rank", "dense_rank": "_d", "row_number": "_r", "percent_rank": None})
    return r.drop("_d", "_r")


def save_model(model: RandomForestRegressionModel, path: str) -> None:
    """O-86: Spark ML persistence (readable from any executor/driver)."""
    model.write().overwrite().save(path)
