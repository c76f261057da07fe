"""Popularity prediction plans (O-62, O-79..O-86)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.columns import five_star_proxy
from revlens.operators import aggregates as agg
from revlens.operators import forest, joins, ml
from revlens.session import materialize, stored_path
from revlens.sources import files
from revlens.sources import testdata as td

_MODELS: dict = {}


def place_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-62 + O-28 + O-51/52: leakage-safe feature frame per place."""
    base = agg.place_city_base(td.reviews_num(spark, sf_dir), scores=True, store=True)
    place = agg.roll_up(base, ["Place"], agg.base_mode()).select(
        "Place", "primary_city", F.col("n").alias("review_count"), agg.mean_of("s", "n").alias("avg_rating"),
        agg.std_of().alias("rating_std"), agg.mean_of("ps", "pn").alias("avg_polarity"),
        agg.mean_of("us", "un").alias("avg_subjectivity"))
    city = agg.roll_up(base, ["City"]).select(
        F.col("City").alias("primary_city"), agg.mean_of("s", "n").alias("city_avg_rating"),
        agg.mean_of("ps", "pn").alias("city_avg_polarity"))
    city = city.withColumn("city_five_star_rate", five_star_proxy("city_avg_rating"))
    counts = agg.places_per_city(place).withColumnRenamed("place_count", "city_place_count")
    f = joins.place_feature_frame(place, None, city, counts, None, None)
    f = f.withColumn("primary_city", F.coalesce(F.col("primary_city"), F.lit("Unknown")))
    return f.select("Place", "primary_city", "review_count", *ml.FEATURE_COLS)


def _fitted(spark: SparkSession, sf_dir: str):
    """Fit once per session and input files (the queries below share the forest); new or changed files are fitted anew."""
    identity = files.input_identity(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    hit = _MODELS.get(sf_dir)
    if hit is None or hit[0] != (spark, identity) or spark.sparkContext._jsc.sc().isStopped():
        feats = materialize(ml.engineer_features(place_features(spark, sf_dir)))
        train, test = ml.hash_split(feats, "Place")
        hit = _MODELS[sf_dir] = ((spark, identity), ml.train_forest(train), train, test, feats)
    return hit[1:]


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-82 + O-83: train/test MAE, RMSE, R^2 and 5-fold CV R^2."""
    model, train, test, _ = _fitted(spark, sf_dir)
    tr = ml.regression_metrics(model.transform(train), prefix="train_")
    te = ml.regression_metrics(model.transform(test), prefix="test_")
    cv = ml.cross_validate(train, "Place")
    # three one-row aggregates side by side: the other two enter as scalar subqueries
    row = tr.withColumns({"_te": te.select(F.struct("*")).scalar(), "_cv": cv.select(F.struct("*")).scalar()})
    return row.select("train_mae", F.col("_te.test_mae").alias("test_mae"), "train_rmse",
                      F.col("_te.test_rmse").alias("test_rmse"), "train_r2", F.col("_te.test_r2").alias("test_r2"),
                      F.col("_cv.cv_r2_mean").alias("cv_r2_mean"), F.col("_cv.cv_r2_std").alias("cv_r2_std"))


def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-84."""
    model, *_ = _fitted(spark, sf_dir)
    return ml.feature_importances(spark, model)


def test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-85."""
    model, _, test, _ = _fitted(spark, sf_dir)
    return ml.test_predictions(model, test, "Place")


def place_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-86 + O-69b."""
    model, _, _, feats = _fitted(spark, sf_dir)
    return ml.all_predictions(model, feats, "Place")


def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53 on prediction residuals."""
    return agg.histogram(test_predictions(spark, sf_dir), "residual", 50)


def forest_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-81 + O-86: places whose score from the stored leaf table is the model's own, by primary city.

    The forest is saved, its leaves become a table, and every place is scored
    by the range join with it.
    """
    model, _, _, feats = _fitted(spark, sf_dir)
    path = stored_path(spark, "forest")
    ml.save_model(model, path)
    nodes = forest.forest_nodes(spark, path)
    n = len(ml.FEATURE_COLS)
    leaves = materialize(forest.forest_leaves(nodes, n, ml.FOREST["maxDepth"]))
    scored = forest.score_forest(feats, "Place", ml.FEATURE_COLS, leaves, *forest.forest_thresholds(nodes, n), prediction="from_table")
    own = model.transform(feats).select("Place", "primary_city", "prediction")
    same = (F.abs(F.col("from_table") - F.col("prediction")) <= F.lit(1e-9)) & (F.col("n_trees") == ml.FOREST["numTrees"])
    return (own.join(scored, "Place", "left").groupBy("primary_city")
            .agg(F.count(F.lit(1)).alias("n_places"), F.count_if(same).alias("n_equal")))
