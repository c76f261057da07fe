import os

from pyspark.sql import functions as F

from revlens.plans import batch
from revlens.sources import testdata as td

from paths import SF_SMALL


def test_batch_outputs_from_csv(spark, tmp_dir):
    # a review CSV made from the text view of the smallest data set
    src = td.reviews_text_raw(spark, SF_SMALL).select(
        "City", "Place", "Review", F.col("Rating").cast("float").alias("Rating"),
        F.lit(None).cast("string").alias("Name"), F.lit(None).cast("string").alias("Date"), "Raw_Review")
    csv_dir = os.path.join(tmp_dir, "reviews_csv")
    src.coalesce(1).write.option("header", True).option("escape", '"').csv(csv_dir)
    cs_dir = os.path.join(tmp_dir, "city_state")
    spark.createDataFrame([("en", "S1"), ("fr", "S1"), ("de", "S2")], "City string, State string") \
        .coalesce(1).write.option("header", True).csv(cs_dir)
    out = os.path.join(tmp_dir, "out")
    names = batch.build_outputs(spark, csv_dir, out, cs_dir, with_model=True)
    assert "hotspots_city" in names and "spark_state_metrics" in names and "model_metrics" in names
    rated = src.filter(F.col("Rating").isNotNull()).count()
    assert spark.read.parquet(f"{out}/sentiment_results").count() == rated
    hs = spark.read.parquet(f"{out}/hotspots_city").collect()
    assert sorted(r["rank"] for r in hs) == list(range(1, len(hs) + 1))
    assert all(0.0 <= r.hotspot_score <= 1.0 for r in hs)
    states = {r.State for r in spark.read.parquet(f"{out}/state_metrics").collect()}
    assert states == {"S1", "S2"}
    ranked = "review_count avg_rating rating_std min_rating max_rating unique_places unique_reviewers five_star_rate " \
             "rank dense_rank row_num pct_rank review_pct"
    headers = {
        "spark_top_cities": f"City {ranked}", "spark_city_metrics": f"City {ranked}",
        "spark_top_places": "City Place review_count avg_rating rating_std city_review_count city_avg_rating "
                            "city_place_count city_rank city_dense_rank city_row_number",
        "model_metrics": "train_mae test_mae train_rmse test_rmse train_r2 test_r2 cv_r2_mean cv_r2_std",
        "top_cities": "City review_count avg_rating unique_places", "top_places": "Place review_count avg_rating city",
        "state_metrics": "State ReviewCount AverageRating HotspotScore NumCities SentimentScore",
    }
    for table, header in headers.items():
        assert set(spark.read.parquet(f"{out}/{table}").columns) == set(header.split()), table
    # another input into the same folder gives its own result
    half = os.path.join(tmp_dir, "half_csv")
    src.filter("Rating >= 4").coalesce(1).write.option("header", True).option("escape", '"').csv(half)
    batch.build_outputs(spark, half, out)
    assert spark.read.parquet(f"{out}/sentiment_results").count() == src.filter("Rating >= 4").count() < rated
