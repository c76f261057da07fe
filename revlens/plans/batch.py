"""Batch run over a review CSV: every output table of the analysis, in one session.

    python -m revlens.plans.batch reviews.csv out_dir [city_state.csv]

The CSV (quoted multi-line fields) is parsed once into Parquet with a review
id (multi-line CSV cannot be split, Parquet can); every table below reads
that copy. Tables are written by the executors (Parquet, or CSV with
``fmt="csv"``), none passes through the driver.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import joins, ranking, scores, text
from revlens import constants as K
from revlens.session import get_session, materialize
from revlens.sources import dimensions as dims
from revlens.sources import files

CITY_STATE_SCHEMA = "City string, State string"


def clean_input(spark: SparkSession, csv_path: str, out_dir: str) -> DataFrame:
    """O-01 + O-11..O-14 once, stored as Parquet with a stable review id."""
    def build():
        raw = files.read_reviews_csv(spark, csv_path, multiline=None)
        return files.clean_reviews(raw).withColumn("review_id", F.monotonically_increasing_id())
    return files.build_once(spark, f"{out_dir}/_reviews_clean", build, files.input_identity(spark, csv_path))


def _hotspot_table(ratings: DataFrame, sentiment: DataFrame, key: str) -> DataFrame:
    merged = materialize(joins.ratings_with_sentiment(ratings, sentiment, key))
    scored = scores.hotspot_score(merged)
    return ranking.sequential_rank(scored, "hotspot_score", key, "rank")


def output_tables(spark: SparkSession, reviews: DataFrame, city_state: DataFrame | None = None,
                  lexicon: DataFrame | None = None, with_model: bool = False) -> dict[str, DataFrame]:
    """All output tables as lazy frames (name -> DataFrame)."""
    lexicon = lexicon if lexicon is not None else dims.lexicon_frame(spark)
    out: dict[str, DataFrame] = {}
    # analytics
    out["top_cities"] = agg.top_cities(reviews, 20)
    out["top_places"] = agg.top_places(reviews, 20)
    out["rating_distribution"] = agg.rating_distribution(reviews)
    city_r = materialize(agg.average_ratings(reviews, "City"))
    place_r = materialize(agg.average_ratings(reviews, "Place"))
    out["city_ratings"], out["place_ratings"] = city_r, place_r
    # sentiment (whole texts, lexicon joined as a table)
    txt = text.review_text(reviews).select("review_id", "City", "Place", "Rating", "review_text")
    sent = materialize(text.lexicon_sentiment(txt, lexicon, "review_id", F.col("review_text"),
                                              carry=["City", "Place", "Rating"]))
    out["sentiment_results"] = sent.drop("review_id")
    sent_city = agg.sentiment_by(sent, "City", input_scale=4)
    sent_place = agg.sentiment_by(sent, "Place", input_scale=4)
    out["sentiment_by_city"], out["sentiment_by_place"] = sent_city, sent_place
    # hotspots
    out["hotspots_city"] = _hotspot_table(city_r, sent_city, "City")
    out["hotspots_place"] = _hotspot_table(place_r, sent_place, "Place")
    out["place_city_mapping"] = agg.place_primary_city(reviews)
    # batch-engine tables
    out["spark_dataset_summary"] = agg.dataset_summary(spark, reviews)
    cm = materialize(agg.city_metrics(reviews, exact=False))
    ranked = ranking.global_ranks(cm, [("review_count", False)], [("City", True)],
                                  names={"row_number": "row_num", "percent_rank": "pct_rank"})
    out["spark_city_metrics"] = ranked.withColumns({
        "pct_rank": F.round("pct_rank", 4), "review_pct": agg.share_of_total("review_count", 2, cm)})
    out["spark_place_metrics"] = ranking.ranks_within(agg.place_metrics_enriched(reviews), ["City"],
                                                      [("review_count", False)], [("Place", True)])
    out["spark_top_cities"] = ranking.top_n(out["spark_city_metrics"], [("review_count", False), ("City", True)],
                                            K.TOP_N, where=F.col("review_count") > K.CITY_MIN_REVIEWS)
    out["spark_top_places"] = ranking.top_n(out["spark_place_metrics"],
                                            [("review_count", False), ("Place", True), ("City", True)],
                                            K.TOP_N, where=F.col("review_count") > K.PLACE_MIN_REVIEWS)
    out["spark_rating_dist"] = agg.rating_distribution_int(spark, reviews)
    if city_state is not None:
        out["spark_state_metrics"] = agg.state_metrics(cm, city_state)
        out["state_metrics"] = agg.state_hotspot_metrics(out["hotspots_city"], city_state, sent_city)
    if with_model:
        out.update(model_tables(spark, place_r, city_r, out["place_city_mapping"], sent_place, sent_city))
    return out


def model_tables(spark: SparkSession, place_r: DataFrame, city_r: DataFrame, mapping: DataFrame,
                 sent_place: DataFrame, sent_city: DataFrame) -> dict[str, DataFrame]:
    """O-62, O-79..O-86: feature frame, forest, metrics, importances, predictions."""
    from revlens.functions.columns import five_star_proxy
    from revlens.operators import ml
    city = city_r.select(F.col("City").alias("primary_city"), F.col("avg_rating").alias("city_avg_rating"),
                         five_star_proxy("avg_rating").alias("city_five_star_rate"))
    counts = agg.places_per_city(mapping).withColumnRenamed("place_count", "city_place_count")
    feats = joins.place_feature_frame(
        place_r, mapping, city, counts, sent_place.select("Place", "avg_polarity", "avg_subjectivity"),
        sent_city.select(F.col("City").alias("primary_city"), F.col("avg_polarity").alias("city_avg_polarity")))
    feats = materialize(ml.engineer_features(feats.withColumn(
        "primary_city", F.coalesce(F.col("primary_city"), F.lit("Unknown")))))
    train, test = ml.hash_split(feats, "Place")
    model = ml.train_forest(train)
    tr = ml.regression_metrics(model.transform(train), prefix="train_")
    te = ml.regression_metrics(model.transform(test), prefix="test_")
    cv = ml.cross_validate(train, "Place").select(F.struct("*")).scalar()
    metrics = tr.withColumns({"_te": te.select(F.struct("*")).scalar(), "_cv": cv}).select(
        "train_mae", F.col("_te.test_mae").alias("test_mae"), "train_rmse", F.col("_te.test_rmse").alias("test_rmse"),
        "train_r2", F.col("_te.test_r2").alias("test_r2"), F.col("_cv.cv_r2_mean").alias("cv_r2_mean"),
        F.col("_cv.cv_r2_std").alias("cv_r2_std"))
    return {"model_metrics": metrics, "feature_importances": ml.feature_importances(spark, model),
            "prediction_results": ml.test_predictions(model, test, "Place"),
            "all_place_predictions": ml.all_predictions(model, feats, "Place")}


def build_outputs(spark: SparkSession, csv_path: str, out_dir: str, city_state_csv: str | None = None,
                  fmt: str = "parquet", with_model: bool = False) -> list[str]:
    """Write every output table under ``out_dir``; returns the table names."""
    reviews = clean_input(spark, csv_path, out_dir)
    cs = (spark.read.schema(CITY_STATE_SCHEMA).option("header", True).csv(city_state_csv)
          if city_state_csv else None)
    tables = output_tables(spark, reviews, cs, with_model=with_model)
    for name, df in tables.items():
        files.write_table(df, f"{out_dir}/{name}", fmt=fmt)
    return list(tables)


if __name__ == "__main__":
    if len(sys.argv) < 3:
        raise SystemExit(__doc__)
    session = get_session()
    print(build_outputs(session, sys.argv[1], sys.argv[2], sys.argv[3] if len(sys.argv) > 3 else None))
