"""Text plans over the review-text view: cleaning, sentiment, aspects, review search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import constants as K
from revlens.functions.columns import at_least, ci_equals, contains_literal, normalise_text, truncate_text
from revlens.operators import aggregates as agg, search
from revlens.operators import joins, text
from revlens.session import materialize
from revlens.sources import dimensions as dims
from revlens.sources import testdata as td

SEARCH = {"city": "EN", "min_rating": "3", "keyword": "the"}


def review_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-17 + O-18: chosen review text and its normalised form, whole texts."""
    r = text.review_text(td.reviews_text_docs(spark, sf_dir))
    return r.select("doc_id", "review_text", normalise_text("review_text").alias("clean_text"))


def review_scores(spark: SparkSession, sf_dir: str, where=None, lexicon: DataFrame | None = None) -> DataFrame:
    """O-78 + O-19: doc_id, City, Place, polarity, subjectivity and label per review.

    ``where`` restricts the reviews before tokenising (a predicate on the
    grouping keys of the consumer, e.g. one city).
    """
    r = td.reviews_text_docs(spark, sf_dir)
    if where is not None:
        r = r.filter(where)
    txt = text.review_text(r).select("doc_id", "City", "Place", "review_text")
    return text.lexicon_sentiment(txt, dims.lexicon_frame(spark) if lexicon is None else lexicon, "doc_id",
                                  F.col("review_text"), carry=["City", "Place"])


def sentiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-78 + O-19 with the rating; it joins the scores, not the texts."""
    return td.with_rating(review_scores(spark, sf_dir), spark, sf_dir)


def sentiment_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-78 + O-19 with a lexicon of frequent words of the data (all labels, modifier chains, clipping)."""
    return review_scores(spark, sf_dir, lexicon=dims.lexicon_frame(spark, dims.COMMON_WORD_LEXICON, dims.COMMON_NEGATORS))


def sentiment_common_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-45 over :func:`sentiment_common`."""
    return agg.label_distribution(sentiment_common(spark, sf_dir), "sentiment")


def sentiment_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44 per City (language)."""
    return agg.sentiment_by(review_scores(spark, sf_dir), "City", input_scale=4)


def sentiment_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44 per Place (source)."""
    return agg.sentiment_by(review_scores(spark, sf_dir), "Place", input_scale=4)


def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-45: label distribution with percent."""
    return agg.label_distribution(review_scores(spark, sf_dir), "sentiment")


def place_sentiment(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """O-46: mean polarity and modal label per (City, Place)."""
    return agg.place_sentiment(review_scores(spark, sf_dir, where))


def polarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53: 50-bin histogram of review polarity."""
    return agg.histogram(review_scores(spark, sf_dir), "polarity", 50)


def _search_rows(spark: SparkSession, sf_dir: str, city=None, place=None, sentiment=None, min_rating=None,
                 keyword=None, derive: dict | None = None, with_sentiment: bool = True) -> DataFrame:
    """O-20/O-21/O-22/O-63c: doc_id, City, Place, Rating, polarity, sentiment of the matching reviews.

    Case-insensitive equality, minimum rating, literal keyword. The text is
    tested, and the ``derive`` columns are made from ``Review``, before any
    join, so no text is shuffled. City and place also restrict the sentiment
    side: a (City, Place) group only depends on its own reviews.
    ``with_sentiment=False`` leaves polarity and label out.
    """
    keys = {"City": F.coalesce("City", F.lit("Unknown")), "Place": F.coalesce("Place", F.lit("Unknown"))}
    cond = F.lit(True)
    if city:
        cond = cond & ci_equals(keys["City"], city)
    if place:
        cond = cond & ci_equals(keys["Place"], place)
    r = td.reviews_text_docs(spark, sf_dir).filter(cond).select(
        "doc_id", *[c.alias(k) for k, c in keys.items()], F.coalesce("Raw_Review", F.lit("")).alias("Review"))
    if keyword:
        r = r.filter(contains_literal("Review", keyword))
    derive = derive or {}
    r = r.withColumns(derive).drop(*({"Review"} - set(derive)))
    r = td.with_rating(r, spark, sf_dir)
    if min_rating:
        r = r.filter(at_least("Rating", min_rating))
    if with_sentiment or sentiment:
        r = joins.reviews_with_place_sentiment(r, place_sentiment(spark, sf_dir, cond))
    if sentiment:
        r = r.filter(ci_equals("sentiment", sentiment))
    return r


def _hits(aspects: dict) -> dict:
    """The keywords found in a text as a derived column of the search rows (substring rule)."""
    return {"_found": text.found_keywords(F.col("Review"), aspects, "substring")}


def reviews_with_place_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63c: every review with its (City, Place) polarity and label."""
    return _search_rows(spark, sf_dir).select("doc_id", "City", "Place", "Rating", "polarity", "sentiment")


def review_search_aspects(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    """O-47 on the filtered reviews: mentions and mean rating per aspect."""
    f = _search_rows(spark, sf_dir, **(params or SEARCH), derive=_hits(dims.SEARCH_ASPECTS), with_sentiment=False)
    return text.aspect_mentions(f, dims.SEARCH_ASPECTS)


def review_search_summary(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    """O-50 + O-49: count, mean rating, mean polarity and top aspect of a search."""
    f = _search_rows(spark, sf_dir, **(params or SEARCH), derive=_hits(dims.SEARCH_ASPECTS))
    return text.search_summary(f, dims.SEARCH_ASPECTS)


def review_search_rows(spark: SparkSession, sf_dir: str, limit: int = K.SEARCH_LIMIT, **params) -> DataFrame:
    """O-26 + O-69e: the first ``limit`` matches, text cut to 400 characters."""
    f = _search_rows(spark, sf_dir, **(params or SEARCH),
                     derive={"Review": truncate_text("Review", K.TEXT_PREVIEW_CHARS)})
    return (f.orderBy("doc_id").limit(int(limit))
            .select("doc_id", "City", "Place", "Review", "Rating", "polarity", "sentiment"))


def aspect_mentions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-47 over every review (substring rule)."""
    f = _search_rows(spark, sf_dir, derive=_hits(dims.SEARCH_ASPECTS), with_sentiment=False)
    return text.aspect_mentions(f, dims.SEARCH_ASPECTS)


def aspect_mentions_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-47 with a dictionary of frequent words of the data (substring rule)."""
    f = _search_rows(spark, sf_dir, derive=_hits(dims.COMMON_WORD_ASPECTS), with_sentiment=False)
    return text.aspect_mentions(f, dims.COMMON_WORD_ASPECTS)


def _boundary_summary(spark: SparkSession, sf_dir: str, aspects: dict) -> DataFrame:
    """O-48 over every rated review with text; the hits are found before the rating is joined."""
    r = text.review_text(td.reviews_text_docs(spark, sf_dir), drop_blank=True)
    rated = td.with_rating(text.aspect_hits(r, aspects, "review_text", "regex", ["doc_id"]), spark, sf_dir)
    return text.aspect_summary(rated.filter(F.col("Rating").isNotNull()), aspects)


def aspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48 with the dashboard's dictionary (word-boundary rule)."""
    return _boundary_summary(spark, sf_dir, dims.SUMMARY_ASPECTS)


def aspect_summary_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48 with a dictionary of frequent words of the data (word-boundary rule)."""
    return _boundary_summary(spark, sf_dir, dims.COMMON_WORD_ASPECTS)


def hotspot_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-39 -> O-61 -> O-70/71/72 -> O-69a with sentiment as its own table.

    Ratings come from the rated reviews of each source; polarity from the
    lexicon sentiment of all its reviews (a separate table), left-joined
    with missing polarity -> 0.
    """
    from revlens.functions.columns import clamp, is_valid_number
    from revlens.operators import ranking, scores
    from revlens.plans.destinations import HOTSPOT_COLS
    raw = td.reviews_text_raw(spark, sf_dir)
    rated = (raw.filter(is_valid_number("Rating") & F.col("City").isNotNull() & F.col("Place").isNotNull())
             .withColumns({"Rating": clamp("Rating"), "Place": F.trim("Place")}))
    ratings = agg.average_ratings(rated, "Place")
    sent = agg.sentiment_by(review_scores(spark, sf_dir), "Place", input_scale=4)
    merged = materialize(joins.ratings_with_sentiment(ratings, sent, "Place"))
    scored = scores.hotspot_score(merged)
    return ranking.sequential_rank(scored, "hotspot_score", "Place", "rank").select(
        "Place", *HOTSPOT_COLS)


def indexed_search(spark: SparkSession, sf_dir: str, keywords=("tionment", "Er", "zzzq", "es de")) -> DataFrame:
    """O-22 + O-25: reviews that hold each keyword, found through a trigram index of the texts (short keywords scan)."""
    rows = td.reviews_text_docs(spark, sf_dir).select("doc_id", "City", "Place", F.col("Raw_Review").alias("Review"))
    index = search.build_index(rows, "doc_id", "Review")
    out = None
    for word in keywords:
        hits = search.search(index, word).select(F.lit(word).alias("keyword"), "doc_id", "City", "Place")
        out = hits if out is None else out.unionByName(hits)
    return out
