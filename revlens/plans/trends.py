"""Trend plans (O-77a/b, O-55, O-63d): keyword interest over time, live-only scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import ranking, scores
from revlens.session import materialize
from revlens.sources import testdata as td


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events are read once; everything below reads this stored table."""
    return materialize(scores.daily_interest(td.interest_events(spark, sf_dir)))


def base_popularity(daily: DataFrame, n: int | None = None) -> DataFrame:
    """Keywords with their number of records (Place, BasePopularity); the top n if asked for."""
    counts = daily.groupBy(F.col("keyword").alias("Place")).agg(F.sum("rows").alias("BasePopularity"))
    return counts if n is None else ranking.top_n(counts, [("BasePopularity", False), ("Place", True)], n)


def _trends(daily: DataFrame) -> DataFrame:
    names = daily.select("keyword").distinct()
    return scores.trend_scores(daily, td.trend_status(names), names.select(F.col("keyword").alias("Place")))


def trend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-77a: mean interest in the last 3 months, min-max among live keywords."""
    return _trends(_daily(spark, sf_dir))


def realtime_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-77b + O-63d: base popularity joined to trend scores with defaults."""
    daily = _daily(spark, sf_dir)
    return scores.realtime_scores(base_popularity(daily), _trends(daily))


def trend_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-55: live / not live / total over the trend table."""
    return agg.status_counts(trend_scores(spark, sf_dir))


def trend_status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-55: records per status."""
    return trend_scores(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def trend_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: trends stored by one run and reused by the next, which labels them 'cached'."""
    first = materialize(trend_scores(spark, sf_dir))
    again = scores.cached_trends(first)
    return trend_scores(spark, sf_dir) if again is None else again
