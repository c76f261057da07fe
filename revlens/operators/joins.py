"""Dimension and enrichment joins (O-59..O-63f).

No join is hinted: every one is left to Catalyst/AQE, which broadcasts only below ``spark.sql.autoBroadcastJoinThreshold`` at runtime
and otherwise shuffles both sides on the key (AQE splits skewed keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = [
    "map_city_state", "ratings_with_sentiment", "place_feature_frame", "place_insight_frame",
    "enrich_missing_columns", "reviews_with_place_sentiment", "places_in_state", "fuzzy_city_coords",
]


def map_city_state(df: DataFrame, city_state: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """O-59: City -> State look-up; unmapped rows dropped (or kept with NULL)."""
    return df.join(city_state, "City", "left" if keep_unmapped else "inner")


def ratings_with_sentiment(ratings: DataFrame, sentiment: DataFrame | None, key: str) -> DataFrame:
    """O-61: ratings left-joined to sentiment; missing polarity -> 0."""
    if sentiment is None:
        return ratings.withColumn("avg_polarity", F.lit(0.0))
    s = sentiment.select(key, "avg_polarity")
    return (ratings.join(s, key, "left")
            .withColumn("avg_polarity", F.coalesce(F.col("avg_polarity"), F.lit(0.0))))


def place_feature_frame(place: DataFrame, mapping: DataFrame | None, city_quality: DataFrame,
                        place_count: DataFrame, place_sent: DataFrame | None,
                        city_sent: DataFrame | None) -> DataFrame:
    """O-62: five-way left-join feature assembly with the documented defaults.

    A table that is None is not joined: its columns are already in ``place``
    (mapping, place sentiment) or in ``city_quality`` (city sentiment).

    place (Place, avg_rating, review_count, rating_std) ⟕ mapping (Place,
    primary_city) ⟕ city quality (primary_city, city_avg_rating,
    city_five_star_rate) ⟕ place count (primary_city, city_place_count) ⟕
    place sentiment (Place, avg_polarity, avg_subjectivity) ⟕ city sentiment
    (primary_city, city_avg_polarity). The city-side tables have one row per
    city; AQE broadcasts them when they are small.
    """
    j = place
    for table, key in ((mapping, "Place"), (city_quality, "primary_city"), (place_count, "primary_city"),
                       (place_sent, "Place"), (city_sent, "primary_city")):
        if table is not None:
            j = j.join(table, key, "left")
    return j.withColumns({
        "city_avg_rating": F.coalesce(F.col("city_avg_rating"), F.col("avg_rating")),
        "city_place_count": F.coalesce(F.col("city_place_count"), F.lit(1)).cast("bigint"),
        "city_five_star_rate": F.coalesce(F.col("city_five_star_rate"), F.lit(0.5)),
        "avg_polarity": F.coalesce(F.col("avg_polarity"), F.lit(0.0)),
        "avg_subjectivity": F.coalesce(F.col("avg_subjectivity"), F.lit(0.0)),
        "city_avg_polarity": F.coalesce(F.col("city_avg_polarity"), F.lit(0.0)),
        "rating_std": F.coalesce(F.col("rating_std"), F.lit(0.0)),
    })


def place_insight_frame(hotspots: DataFrame, top_places: DataFrame | None = None,
                        sentiment: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """O-63a: hotspot places ⟕ city of the place ⟕ sentiment extras ⟕ predictions."""
    out = hotspots
    if top_places is not None:
        out = out.join(top_places.select("Place", F.col("city").alias("City")), "Place", "left")
    if "City" not in out.columns:
        out = out.withColumn("City", F.lit("Unknown"))
    out = out.withColumn("City", F.coalesce(F.col("City"), F.lit("Unknown")))
    if sentiment is not None:
        extra = [c for c in ("avg_subjectivity", "dominant_sentiment") if c in sentiment.columns]
        if extra:
            out = out.join(sentiment.select("Place", *extra), "Place", "left")
    if predictions is not None:
        extra = [c for c in ("predicted_review_count", "popularity_rank") if c in predictions.columns]
        if extra:
            out = out.join(predictions.select("Place", *extra), "Place", "left")
    return out


def enrich_missing_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-63b: add the right table's columns the left one lacks (left join)."""
    extra = [c for c in right.columns if c not in left.columns]
    if not extra:
        return left
    return left.join(right.select(key, *extra), key, "left")


def reviews_with_place_sentiment(reviews: DataFrame, place_sent: DataFrame) -> DataFrame:
    """O-63c: composite-key (City, Place) left join of reviews to their sentiment."""
    return reviews.join(place_sent, ["City", "Place"], "left")


def places_in_state(places: DataFrame, mapping: DataFrame, city_state: DataFrame, state: str | None = None) -> DataFrame:
    """O-63e: places whose primary city lies in the state (left-semi join)."""
    cities = city_state if state is None else city_state.filter(F.col("State") == state)
    m = mapping.join(cities.select(F.col("City").alias("primary_city"), "State"),
                     "primary_city", "inner")
    if state is None:
        return places.join(m.select("Place", "primary_city", "State"), "Place", "inner")
    return places.join(m.select("Place"), "Place", "left_semi")


def _collapse(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _bracket_free(c):
    return F.lower(F.regexp_replace(c, r"\s*\([^)]*\)", ""))


def _prefixes(c):
    """All non-empty prefixes of a string as an array (length-bounded)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, 1, i))


def fuzzy_city_coords(cities: DataFrame, coords: DataFrame) -> DataFrame:
    """O-63f: prioritised fuzzy look-up city -> (lat, lon).

    Priority 1: white-space-collapsed exact name; 2: equal after removing
    '(...)' and lower-casing; 3: one bracket-free lower-case name is a prefix
    of the other. Within a pass the first dictionary entry (``ordinal``) wins.
    City and entry each yield a few typed look-up keys (exact name, cleaned
    name, prefixes), so all passes are one equi-join: each side is read once
    and nothing pairs every city with every entry. Empty cleaned names match
    nothing; a city without a match is absent.
    """
    keyed = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    whole = lambda kind, c: F.array(keyed(kind, c))
    heads = lambda kind, c: F.transform(_prefixes(c), lambda p: keyed(kind, p))
    names = cities.select("City").distinct().withColumn("_exact", _collapse(F.col("City")))
    names = names.withColumn("_clean", _bracket_free(F.col("_exact")))
    entries = coords.withColumn("_exact", _collapse(F.col("city")))
    entries = entries.withColumn("_clean", _bracket_free(F.col("_exact")))
    # a key of kind n belongs to pass n; kind 4 is pass 3 with the roles swapped
    left = names.select("City", F.explode(F.concat(
        whole(1, F.col("_exact")), whole(2, F.col("_clean")), heads(3, F.col("_clean")),
        whole(4, F.col("_clean")))).alias("_k"))
    right = entries.select("lat", "lon", "ordinal", F.explode(F.concat(
        whole(1, F.col("_exact")), whole(2, F.col("_clean")), whole(3, F.col("_clean")),
        heads(4, F.col("_clean")))).alias("_d"))
    right = right.select("lat", "lon", "ordinal", F.col("_d.kind").alias("kind"), F.col("_d.key").alias("key"))
    left = left.select("City", F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"))
    hits = left.join(right.filter((F.col("kind") <= 2) | (F.col("key") != "")), ["kind", "key"])
    best = hits.groupBy("City").agg(F.min_by(
        F.struct("lat", "lon"), F.struct(F.least(F.col("kind"), F.lit(3)), F.col("ordinal"))).alias("_c"))
    return best.select("City", F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"))
