"""Batch analysis plans: profile, distributions, per-key metrics, ranks, state rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import constants as K
from revlens.functions.columns import coerce_number
from revlens.operators import aggregates as agg
from revlens.operators import ranking
from revlens.session import materialize, stored_path
from revlens.sources import dimensions as dims
from revlens.sources import files, incremental
from revlens.sources import testdata as td


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-32 (+ O-08 view): SQL summary of the cleaned reviews."""
    return agg.dataset_summary(spark, td.reviews_num(spark, sf_dir), td.reviews_num(spark, sf_dir, with_name=True))


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-33: profile of the raw (uncleaned) review rows."""
    raw = td.reviews_num_raw(spark, sf_dir, with_name=True)
    narrow = td.reviews_num_raw(spark, sf_dir)  # every review has a name, so the other columns need no join to it
    return agg.dataset_profile(raw, "Rating", text_cols=["City", "Place", "Name"],
                               sources=dict.fromkeys(["City", "Place", "Rating"], narrow))


def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-34."""
    return agg.rating_distribution(td.reviews_num(spark, sf_dir))


def rating_distribution_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-29 + O-35."""
    return agg.rating_distribution_int(spark, td.reviews_num(spark, sf_dir))


def city_weighted_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-36: review-weighted mean rating per city from its rating distribution."""
    r = td.reviews_num(spark, sf_dir)
    dist = r.groupBy("City", F.col("Rating").alias("rating")).agg(F.count(F.lit(1)).alias("count"))
    return agg.weighted_mean(dist, ["City"], "rating", "count", 3, "avg_rating")


def top_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-37."""
    return agg.top_cities(td.reviews_num(spark, sf_dir), K.TOP_N)


def top_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-38."""
    return agg.top_places(td.reviews_num(spark, sf_dir), K.TOP_N)


def city_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-39 per city."""
    return agg.average_ratings(td.reviews_num(spark, sf_dir), "City")


def place_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-39 per place."""
    return agg.average_ratings(td.reviews_num(spark, sf_dir), "Place")


def city_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40 with HLL++ distinct counts (as the reviewed batch job)."""
    return agg.city_metrics(td.reviews_num(spark, sf_dir), exact=False,
                            reviewers=td.reviews_num(spark, sf_dir, with_name=True))


def city_metrics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40 with exact distinct counts."""
    return agg.city_metrics(td.reviews_num(spark, sf_dir), exact=True,
                            reviewers=td.reviews_num(spark, sf_dir, with_name=True))


def place_metrics_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41 + O-60 (exact distinct for the city place count)."""
    return agg.place_metrics_enriched(td.reviews_num(spark, sf_dir))


def city_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-65 + O-67: global ranks of cities by review count and share of reviews."""
    cm = materialize(agg.city_metrics(td.reviews_num(spark, sf_dir), exact=True, with_reviewers=False, with_places=False))
    ranked = ranking.global_ranks(cm, [("review_count", False)], [("City", True)],
                                  names={"row_number": "row_num", "percent_rank": "pct_rank"})
    return ranked.withColumns({
        "pct_rank": F.round("pct_rank", 4),
        "review_pct": agg.share_of_total("review_count", 2, cm),
    }).select("City", "review_count", "avg_rating", "five_star_rate", "rank", "dense_rank", "row_num",
              "pct_rank", "review_pct")


def place_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-65 at place scale: the distributed global ranks over (Place, City) rows."""
    pm = agg.place_metrics(td.reviews_num(spark, sf_dir))
    ranked = ranking.global_ranks(pm, [("review_count", False)], [("Place", True), ("City", True)])
    return ranked.withColumn("percent_rank", F.round("percent_rank", 4)).select(
        "Place", "City", "review_count", "rank", "dense_rank", "row_number", "percent_rank")


def place_ranks_in_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-68: rank, dense_rank, row_number of places inside each city.

    Always the distributed per-group form (a city holding a large share of
    the places is spread over several tasks), whatever the table size.
    """
    pm = agg.place_metrics_enriched(td.reviews_num(spark, sf_dir))
    return ranking.ranks_within(pm, ["City"], [("review_count", False)], [("Place", True)])


def top_ranked_cities(spark: SparkSession, sf_dir: str, n: int = K.TOP_N) -> DataFrame:
    """O-64: cities with more than 100 reviews, top n by count."""
    return ranking.top_n(city_ranks(spark, sf_dir), [("review_count", False), ("City", True)], n,
                         where=F.col("review_count") > K.CITY_MIN_REVIEWS)


def top_ranked_places(spark: SparkSession, sf_dir: str, n: int = K.TOP_N) -> DataFrame:
    """O-64: (place, city) rows with more than 10 reviews, top n by count."""
    return ranking.top_n(place_ranks_in_city(spark, sf_dir),
                         [("review_count", False), ("Place", True), ("City", True)], n,
                         where=F.col("review_count") > K.PLACE_MIN_REVIEWS)


def state_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42 + O-59: state rollup of exact city metrics."""
    cm = agg.city_metrics(td.reviews_num(spark, sf_dir), exact=True, with_reviewers=False, with_places=False)
    return agg.state_metrics(cm, dims.city_state_from_regions(spark, sf_dir))


def place_primary_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-51: primary (modal) city of every place."""
    return agg.place_primary_city(td.reviews_num(spark, sf_dir))


def places_per_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-52."""
    return agg.places_per_city(agg.place_primary_city(td.reviews_num(spark, sf_dir)))


def place_rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53: 50-bin histogram of per-place mean ratings."""
    pr = agg.average_ratings(td.reviews_num(spark, sf_dir), "Place")
    return agg.histogram(pr, "avg_rating", K.HISTOGRAM_BINS)


def place_rating_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-54: five-number summary of per-place mean ratings."""
    return agg.five_number_summary(agg.average_ratings(td.reviews_num(spark, sf_dir), "Place"), "avg_rating")


def city_place_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-56: City -> Place totals with review-weighted mean rating."""
    pm = agg.place_metrics(td.reviews_num(spark, sf_dir))
    return agg.hierarchy_totals(pm, "City", "Place")


def first_reviews(spark: SparkSession, sf_dir: str, n: int = 5000) -> DataFrame:
    """O-03: first n reviews in key order."""
    return files.first_rows(td.reviews_num(spark, sf_dir), n, ["City", "Place", "Rating", "polarity", "subjectivity"])


SAMPLE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def review_sample(spark: SparkSession, sf_dir: str, n: int = 5000) -> DataFrame:
    """O-04: exact-n seeded sample of review rows.

    The order number and line do not tell rows apart in the test tables, so
    the hash takes all columns of the sample.
    """
    li = td.read_table(spark, sf_dir, "lineitem").select(*SAMPLE_COLUMNS)
    return files.exact_sample(li, n, SAMPLE_COLUMNS, seed=42)


def review_sample_properties(spark: SparkSession, sf_dir: str, n: int = 5000) -> DataFrame:
    """O-04, what holds for any exact sample without replacement.

    Its size, and the rows it has more often than the table does.
    """
    drawn = materialize(review_sample(spark, sf_dir, n)).groupBy(*SAMPLE_COLUMNS).agg(F.count(F.lit(1)).alias("_drawn"))
    there = td.read_table(spark, sf_dir, "lineitem").groupBy(*SAMPLE_COLUMNS).agg(F.count(F.lit(1)).alias("_there"))
    both = drawn.join(there, SAMPLE_COLUMNS, "left")
    excess = F.greatest(F.col("_drawn") - F.coalesce(F.col("_there"), F.lit(0)), F.lit(0))
    return both.agg(F.sum("_drawn").alias("rows"), F.sum(excess).alias("excess_rows"))


def reviewer_sketch_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40: per city, whether the HLL++ reviewers are within 15 % (three standard errors) of the exact ones."""
    people = materialize(td.reviews_num(spark, sf_dir, with_name=True).select("City", "Name").distinct())
    both = people.groupBy("City").agg(F.count("Name").alias("unique_reviewers"),
                                      F.approx_count_distinct("Name").alias("_sketch"))
    off = F.abs(F.col("_sketch") - F.col("unique_reviewers"))
    return both.select("City", "unique_reviewers", (off <= 0.15 * F.col("unique_reviewers")).alias("within_bound"))


def reviewer_sketch_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40: reviewers of places, cities and states from one table of stored sketches, against the exact counts.

    The sketches are made once per (City, Place) and merged upwards; a level's
    error must stay within five standard errors (8.2 %), or one reviewer.
    """
    people = td.reviews_num(spark, sf_dir, with_name=True).select("City", "Place", "Name")
    fine = materialize(agg.distinct_sketches(people, ["City", "Place"], "Name"))
    mapped = dims.city_state_from_regions(spark, sf_dir)
    out = None
    for level, keys, join in (("place", ["City", "Place"], False), ("city", ["City"], False), ("state", ["State"], True)):
        part = fine.join(mapped, "City") if join else fine
        raw = people.join(mapped, "City") if join else people
        found = agg.merge_sketches(part, keys).select(*keys, F.hll_sketch_estimate("sketch").alias("_found"))
        exact = raw.select(*keys, "Name").distinct().groupBy(*keys).agg(F.count("Name").alias("unique_reviewers"))
        off = F.abs(F.col("_found") - F.col("unique_reviewers"))
        rows = exact.join(found, keys).select(F.lit(level).alias("level"), F.concat_ws("/", *keys).alias("key"), "unique_reviewers",
                                              (off <= F.greatest(F.lit(1.0), 0.0815 * F.col("unique_reviewers"))).alias("within_bound"))
        out = rows if out is None else out.unionByName(rows)
    return out


def coerced_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-15: ratings that arrive as text, some of them no number, with a default and a floor; mean per city."""
    text = F.coalesce(F.concat(F.lit(" "), F.col("Rating").cast("string")), F.lit("n/a"))
    rows = td.reviews_num_raw(spark, sf_dir).select("City", coerce_number(text, default=3.0, lower=1.0).alias("rating"))
    return rows.groupBy("City").agg(F.count("rating").alias("rows"), F.round(F.avg("rating"), 4).alias("avg_rating"), F.min("rating").alias("min_rating"))


def _csv_folder(spark: SparkSession, rows: DataFrame, tag: str) -> str:
    """Rows as CSV files in a folder of their own in the shared checkpoint folder."""
    path = stored_path(spark, tag)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01 + O-02: reviews written as CSV, some with a rating that is no number, and read back: good rows per city and rejects."""
    raw = td.reviews_num_raw(spark, sf_dir)
    rows = raw.select("City", "Place", F.lit("fine, \"really\"").alias("Review"), F.coalesce(F.col("Rating").cast("string"), F.lit("n/a")).alias("Rating"),
                      F.lit("x").alias("Name"), F.lit("2024-01-01").alias("Date"), F.lit("raw").alias("Raw_Review"))
    good, bad = files.read_reviews_checked(spark, _csv_folder(spark, rows, "csv"))
    kept = good.groupBy("City").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col("Rating").cast("double")), 4).alias("avg_rating"))
    lost = bad.agg(F.count(F.lit(1)).alias("rows"))
    return (kept.select(F.lit("good").alias("kind"), "City", "rows", "avg_rating")
            .unionByName(lost.select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("City"), "rows", F.lit(None).cast("double").alias("avg_rating"))))


def incremental_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: city figures kept up to date: the reviews arrive in two lots of files, and each lot is read once."""
    inputs, store = stored_path(spark, "lots"), stored_path(spark, "rollup")
    reviews = td.reviews_num(spark, sf_dir, with_key=True).select("City", "Place", "Rating", "l_linenumber")
    schema = reviews.drop("l_linenumber").schema
    out = None
    for lot in (F.col("l_linenumber") <= 3, F.col("l_linenumber") > 3):
        reviews.filter(lot).drop("l_linenumber").write.mode("append").parquet(inputs)
        out = incremental.update_rollup(
            spark, inputs, store, lambda paths: spark.read.schema(schema).parquet(*paths), agg.place_city_base,
            lambda parts: agg.roll_up(parts, ["City"], F.count_distinct("Place").alias("unique_places")), suffix=".parquet")
    return out.select("City", F.col("n").alias("review_count"), agg.mean_of("s", "n").alias("avg_rating"), agg.std_of().alias("rating_std"), "unique_places")


def record_export(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """O-10: JSON records of all hotspot cities (or the leading n) (non-finite -> null)."""
    from revlens.plans.destinations import hotspot_city
    hs = hotspot_city(spark, sf_dir).select("rank", "City", "hotspot_score")
    return files.export_records(hs, n, ["rank"])
