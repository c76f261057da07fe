"""Destination scoring plans: hotspot tables, state rollups, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import constants as K
from revlens.functions.columns import polarity_label
from revlens.operators import aggregates as agg
from revlens.operators import joins, ranking, scores
from revlens.sources import dimensions as dims
from revlens.sources import files
from revlens.session import materialize
from revlens.sources import testdata as td

HOTSPOT_COLS = ["rank", "avg_rating", "review_count", "rating_std", "avg_polarity",
                "rating_score", "volume_score", "sentiment_score", "hotspot_score"]


def rating_sentiment_inputs(reviews: DataFrame, key: str, with_city: bool = False) -> DataFrame:
    """O-39 + O-44 in one pass when ratings and sentiment share the review frame.

    Two separate group-bys would scan the reviews twice; one aggregate gives
    the same columns (the O-61 join is used when sentiment is its own table).
    ``with_city`` (places) goes through the (Place, City) base and adds the
    most frequent city (O-51, ties -> smallest) as ``primary_city``, so the
    mapping needs no scan of its own.
    """
    if with_city:
        rolled = agg.roll_up(agg.place_city_base(reviews, scores=True), [key], agg.base_mode())
        return rolled.select(key, agg.mean_of("s", "n").alias("avg_rating"), F.col("n").alias("review_count"),
                             agg.std_of().alias("rating_std"), agg.mean_of("ps", "pn").alias("avg_polarity"),
                             agg.mean_of("us", "un").alias("avg_subjectivity"), "primary_city")
    return reviews.groupBy(key).agg(
        F.round(F.avg("Rating"), 4).alias("avg_rating"), F.count("Rating").alias("review_count"),
        F.round(F.stddev_samp("Rating"), 4).alias("rating_std"),
        F.round(F.avg("polarity"), 4).alias("avg_polarity"),
        F.round(F.avg("subjectivity"), 4).alias("avg_subjectivity"))


def hotspots(reviews: DataFrame, key: str, with_city: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """O-39/O-44 -> O-61 -> O-70/71/72 -> O-69a for one key (City or Place).

    ``extra`` keeps further columns of :func:`rating_sentiment_inputs`.
    """
    # one aggregate feeds the bounds subquery and the scores: store it once
    base = materialize(rating_sentiment_inputs(reviews, key, with_city))
    base = base.withColumn("avg_polarity", F.coalesce(F.col("avg_polarity"), F.lit(0.0)))
    scored = scores.hotspot_score(base)
    ranked = ranking.sequential_rank(scored, "hotspot_score", key, "rank")
    return ranked.select(key, *HOTSPOT_COLS, *(["primary_city"] if with_city else []), *extra)


def hotspot_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: rank cities by hotspot score."""
    return hotspots(td.reviews_num(spark, sf_dir), "City")


def hotspot_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by hotspot score."""
    return hotspots(td.reviews_num(spark, sf_dir), "Place")


def state_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43: State, ReviewCount, AverageRating, HotspotScore, NumCities, SentimentScore."""
    return agg.state_hotspot_metrics(hotspot_city(spark, sf_dir), dims.city_state_from_regions(spark, sf_dir))


def reweighted_city_ranks(spark: SparkSession, sf_dir: str, weights=(0.2, 0.5, 0.3)) -> DataFrame:
    """O-73 + O-69a/c: user weights, new rank, rank change (old - new)."""
    hs = hotspot_city(spark, sf_dir)
    rw = scores.reweighted_score(hs, *weights)
    rw = ranking.sequential_rank(rw, "custom_hotspot_score", "City", "new_rank")
    rw = ranking.rank_change(rw, "rank", "new_rank")
    return rw.select("City", "hotspot_score", "custom_hotspot_score", F.col("rank").alias("old_rank"),
                     "new_rank", "rank_change")


def zero_weight_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-73 with all weights 0: the default weights in one variant, scores of 0 in the other."""
    hs = hotspot_city(spark, sf_dir)
    both = scores.reweighted_score(hs, 0.0, 0.0, 0.0).withColumnRenamed("custom_hotspot_score", "default_score")
    both = scores.reweighted_score(both, 0.0, 0.0, 0.0, zero_total="zero").withColumnRenamed("custom_hotspot_score", "zero_score")
    return both.select("City", "default_score", "zero_score")


def comparison_chosen(spark: SparkSession, sf_dir: str, names=("NATION_3", "NATION_7", "NATION_11", "nowhere")) -> DataFrame:
    """O-23 + O-77d: the destinations of a list compared; names that don't occur add nothing."""
    return scores.comparison_frame(hotspot_city(spark, sf_dir), "City", F.col("City").isin(*names))


def place_insights_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63a: the insight rows with the predicted review count and popularity rank of the forest."""
    from revlens.plans import ml
    frame = joins.place_insight_frame(place_insights(spark, sf_dir), predictions=ml.place_predictions(spark, sf_dir))
    return frame.select("Place", "City", "review_count", "hotspot_score", "hidden_gem_score", "risk_score",
                        "predicted_review_count", "popularity_rank")


def place_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63a + O-74/O-75: hotspot places with city, hidden-gem, risk, confidence."""
    hs = hotspots(td.reviews_num(spark, sf_dir), "Place", with_city=True)
    frame = materialize(hs.withColumn("City", F.coalesce(F.col("primary_city"), F.lit("Unknown"))))
    return scores.place_insights(frame).select(
        "Place", "City", "review_count", "avg_rating", "rating_std", "hotspot_score",
        "hidden_gem_score", "risk_score", "confidence_score")


def place_insights_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63a: the insight frame with subjectivity and dominant sentiment of the place."""
    hs = hotspots(td.reviews_num(spark, sf_dir), "Place", with_city=True, extra=("avg_subjectivity",))
    sentiment = hs.select("Place", "avg_subjectivity", polarity_label("avg_polarity").alias("dominant_sentiment"))
    mapping = hs.select("Place", F.col("primary_city").alias("city"))
    frame = joins.place_insight_frame(hs.drop("avg_subjectivity", "primary_city"), mapping, sentiment)
    return scores.place_insights(materialize(frame)).select(
        "Place", "City", "review_count", "avg_rating", "avg_polarity", "avg_subjectivity", "dominant_sentiment",
        "hotspot_score", "hidden_gem_score", "risk_score", "confidence_score")


def hidden_gems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-74 list: 30..1200 reviews, top 25 hidden gems."""
    return scores.hidden_gems(place_insights(spark, sf_dir))


def risk_places(spark: SparkSession, sf_dir: str, min_reviews: int = 800) -> DataFrame:
    """O-75 list: at least ``min_reviews`` reviews, top 25 by risk."""
    return scores.risk_places(place_insights(spark, sf_dir), min_reviews=min_reviews)


def risk_places_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-75 list with a threshold that places of the test tables reach (20 reviews)."""
    return risk_places(spark, sf_dir, min_reviews=20)


def lowest_polarity_places(spark: SparkSession, sf_dir: str, n: int = K.TOP_N) -> DataFrame:
    """O-69d: the n places with the lowest mean polarity."""
    sentiment = agg.sentiment_by(td.reviews_num(spark, sf_dir), "Place")
    return ranking.top_n(sentiment, [("avg_polarity", True), ("Place", True)], n)


def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-58: the distinct cities and places offered as filters, each with its position in order."""
    base = agg.place_city_base(td.reviews_num(spark, sf_dir)).select("City", "Place")
    values = base.select(F.explode(F.array(
        F.struct(F.lit("City").alias("field"), F.col("City").alias("value")),
        F.struct(F.lit("Place").alias("field"), F.col("Place").alias("value")))).alias("v"))
    values = values.select("v.field", "v.value").distinct()
    return ranking.global_row_number(values, [("value", True)], "position", group=["field"])


def state_places(spark: SparkSession, sf_dir: str, state: str = "EUROPE") -> DataFrame:
    """O-63e: the hotspot places of one state (semi join through the primary city)."""
    hs = hotspots(td.reviews_num(spark, sf_dir), "Place", with_city=True)
    inside = joins.places_in_state(hs.drop("primary_city"), hs.select("Place", "primary_city"),
                                   dims.city_state_from_regions(spark, sf_dir), state)
    return inside.select("Place", "rank", "avg_rating", "review_count", "avg_polarity", "hotspot_score")


def state_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-31: state rollup under the map's column names."""
    return files.conform(state_hotspots(spark, sf_dir), K.STATE_MAP_COLUMNS, {"avg_polarity": 0.0})


def comparison_raw(spark: SparkSession, sf_dir: str, state: str = "EUROPE") -> DataFrame:
    """O-77d, browser variant: raw volume, 0.5 for a metric without a range."""
    hs = joins.map_city_state(hotspot_city(spark, sf_dir), dims.city_state_from_regions(spark, sf_dir))
    return scores.comparison_frame(hs, "City", F.col("State") == state, log_volume=False, zero_range=K.LIVE_ZERO_RANGE)


def similar_places(spark: SparkSession, sf_dir: str, seed: str = "part#1", top_n: int = 10) -> DataFrame:
    """O-25 + O-76: places most similar to a seed place."""
    return scores.similar_places(materialize(hotspot_place(spark, sf_dir)), seed, top_n)


def similar_to_each_place(spark: SparkSession, sf_dir: str, top_n: int = K.SIMILAR_DEFAULT) -> DataFrame:
    """O-76 for every place: its most similar places."""
    return scores.similar_to_each(materialize(hotspot_place(spark, sf_dir)), top_n)


def state_top_cities(spark: SparkSession, sf_dir: str, n: int = K.STATE_TOP_DEFAULT) -> DataFrame:
    """O-66: top-n cities by hotspot score inside every state (n is the caller's)."""
    hs = joins.map_city_state(hotspot_city(spark, sf_dir), dims.city_state_from_regions(spark, sf_dir))
    top = ranking.top_n_per_group(hs, ["State"], [("hotspot_score", False), ("City", True)], n, "state_rank")
    return top.select("State", "City", "avg_rating", "review_count", "avg_polarity", "hotspot_score",
                      "state_rank")


def state_top_places(spark: SparkSession, sf_dir: str, n: int = K.STATE_TOP_DEFAULT) -> DataFrame:
    """O-63e + O-66: top-n places per state via place -> primary city -> state."""
    hs = hotspots(td.reviews_num(spark, sf_dir), "Place", with_city=True)
    mapping = hs.select("Place", "primary_city")
    inside = joins.places_in_state(hs.drop("primary_city"), mapping, dims.city_state_from_regions(spark, sf_dir))
    top = ranking.top_n_per_group(inside, ["State"], [("hotspot_score", False), ("Place", True)], n, "state_rank")
    return top.select("State", "Place", "avg_rating", "review_count", "avg_polarity", "hotspot_score", "state_rank")


def state_detail_summary(spark: SparkSession, sf_dir: str, n: int = K.STATE_TOP_DEFAULT) -> DataFrame:
    """O-57: per state, totals over only its top-n cities; 0/NULL values skipped."""
    top = state_top_cities(spark, sf_dir, n)
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    return top.groupBy("State").agg(
        F.sum("review_count").alias("total_reviews"),
        agg.exact_avg(nz("avg_rating"), 4, 3).alias("avg_rating"),
        agg.exact_avg(nz("avg_polarity"), 4, 4).alias("avg_polarity"),
        agg.exact_avg(nz("hotspot_score"), 6, 4).alias("avg_hotspot_score"))


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-77c: weighted components of the 20 leading cities, long form."""
    return scores.score_breakdown(hotspot_city(spark, sf_dir), "City", K.TOP_N)


def comparison(spark: SparkSession, sf_dir: str, state: str = "EUROPE") -> DataFrame:
    """O-77d: the cities of one state compared on min-max metrics (long form)."""
    hs = joins.map_city_state(hotspot_city(spark, sf_dir), dims.city_state_from_regions(spark, sf_dir))
    return scores.comparison_frame(hs, "City", F.col("State") == state)


def city_coords(spark: SparkSession, sf_dir: str, cities: DataFrame | None = None) -> DataFrame:
    """O-63f: fuzzy city -> coordinates look-up of every reviewed city (or of the given ones)."""
    if cities is None:
        cities = td.reviews_num(spark, sf_dir).select("City")
    return joins.fuzzy_city_coords(cities, dims.coords_from_nations(spark, sf_dir))


def map_points(spark: SparkSession, sf_dir: str, top_n: int | None = None) -> DataFrame:
    """O-77e: map markers for all cities (or the top n) that have coordinates."""
    hs = hotspot_city(spark, sf_dir)
    return scores.map_points(hs, city_coords(spark, sf_dir, hs), top_n=top_n)


def map_coverage(spark: SparkSession, sf_dir: str, top_n: int | None = None) -> DataFrame:
    """O-58: mapped / unmapped cities of the selection and the score range."""
    sel = hotspot_city(spark, sf_dir)
    if top_n is not None:
        sel = sel.orderBy(F.desc("hotspot_score"), "City").limit(top_n)
    coords = city_coords(spark, sf_dir, sel).select("City", F.lit(True).alias("_m"))
    j = sel.join(coords, "City", "left").withColumn("mapped", F.coalesce(F.col("_m"), F.lit(False)))
    return agg.coverage_kpis(j, "mapped", "hotspot_score")


def state_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-58 (m): cities with and without a state and the hotspot range of the mapped."""
    hs = joins.map_city_state(hotspot_city(spark, sf_dir), dims.city_state_from_regions(spark, sf_dir),
                              keep_unmapped=True)
    return agg.coverage_kpis(hs.withColumn("mapped", F.col("State").isNotNull()), "mapped", "hotspot_score")


def compare_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63b: hotspot cities with the sentiment columns they lack, from the same stored aggregate."""
    hs = hotspots(td.reviews_num(spark, sf_dir), "City", extra=("avg_subjectivity",))
    sentiment = hs.select("City", "avg_subjectivity", polarity_label("avg_polarity").alias("dominant_sentiment"))
    return joins.enrich_missing_columns(hs.drop("avg_subjectivity"), sentiment, "City")


def similar_places_dashboard(spark: SparkSession, sf_dir: str, seed: str = "Part#1", top_n: int = 12) -> DataFrame:
    """O-76 dashboard variant: NULL features -> 0, exact seed, seed name excluded."""
    return scores.similar_places_dashboard(materialize(hotspot_place(spark, sf_dir)), seed, top_n)


def place_search(spark: SparkSession, sf_dir: str, query: str = "part#1", n: int = K.NAME_SEARCH_LIMIT) -> DataFrame:
    """O-25 search box: place names containing the text, first 40."""
    return agg.name_search(td.reviews_num(spark, sf_dir), "Place", query, n)


def frequent_places(spark: SparkSession, sf_dir: str, n: int = K.FREQUENT_VALUES) -> DataFrame:
    """O-58: the 80 most reviewed places."""
    return agg.frequent_values(td.reviews_num(spark, sf_dir), "Place", n)


def top_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-49: state with the highest hotspot score (ties -> the later name, as a reduce keeps)."""
    return agg.arg_max(state_hotspots(spark, sf_dir), "State", "HotspotScore", first_wins=False, out="top_state")
