import pytest
from pyspark.sql import functions as F

from revlens.operators import scores

H = "City string, avg_rating double, review_count long, avg_polarity double, rating_std double"


def _cities(spark):
    return spark.createDataFrame([("A", 4.5, 100, 0.3, 0.5), ("B", 3.0, 10, -0.2, 1.0), ("C", 4.0, 1000, None, None)], H)


def test_minmax_zero_range_rules(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    z0 = scores.minmax_columns(df, {"n": F.col("x")}, zero_range=0.0).collect()
    z5 = scores.minmax_columns(df, {"n": F.col("x")}, zero_range=0.5).collect()
    assert [r.n for r in z0] == [0.0, 0.0] and [r.n for r in z5] == [0.5, 0.5]


def test_hotspot_bounds_and_weights(spark):
    hs = scores.hotspot_score(_cities(spark)).collect()
    for r in hs:
        for c in ("rating_score", "volume_score", "sentiment_score", "hotspot_score"):
            assert 0.0 <= r[c] <= 1.0
    a = [r for r in hs if r.City == "A"][0]
    assert a.rating_score == 1.0


def test_reweight_with_default_weights_matches(spark):
    hs = scores.hotspot_score(_cities(spark))
    rw = scores.reweighted_score(hs, 0.5, 0.3, 0.2).collect()
    assert all(abs(r.custom_hotspot_score - r.hotspot_score) <= 2e-6 for r in rw)
    zero = scores.reweighted_score(hs, 0, 0, 0).collect()
    assert all(abs(r.custom_hotspot_score - r.hotspot_score) <= 2e-6 for r in zero)


def test_similar_places_duplicate_and_seed_excluded(spark):
    rows = [("Alpha", 4.0, 10, 0.1, 0.9, 0.5, 1), ("Alpha Two", 4.0, 10, 0.1, 0.9, 0.5, 2),
            ("Beta", 2.0, 100, -0.1, 0.1, 1.0, 3), ("Gamma", 3.0, 50, None, 0.5, 0.7, 4)]
    df = spark.createDataFrame(rows, "Place string, avg_rating double, review_count long, avg_polarity double, "
                                     "hotspot_score double, rating_std double, rank int")
    out = scores.similar_places(df, "alpha", 10).collect()
    assert [r.Place for r in out] == ["Alpha Two", "Beta"]  # NULL-feature row dropped, seed excluded
    assert out[0].similarity == 1.0
    assert scores.similar_places(df, "nowhere", 10).count() == 0


def test_trend_scores_live_only(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 10)
    interest = spark.createDataFrame([("a", t, 10.0), ("b", t, 30.0), ("c", t, 50.0)],
                                     "keyword string, ts timestamp, interest double")
    status = spark.createDataFrame([("a", "live", None), ("b", "live", None), ("c", "fallback", "x")],
                                   "keyword string, status string, notes string")
    kws = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "Place string")
    got = {r.Place: (r.TrendScore, r.status) for r in scores.trend_scores(interest, status, kws).collect()}
    assert got == {"a": (0.0, "live"), "b": (1.0, "live"), "c": (0.0, "fallback"), "d": (0.0, "fallback")}
    one = spark.createDataFrame([("a", "live", None)], "keyword string, status string, notes string")
    got1 = {r.Place: r.TrendScore for r in scores.trend_scores(interest, one, kws.limit(1)).collect()}
    assert got1 == {"a": 0.5}


def test_place_insights_columns(spark):
    hs = scores.hotspot_score(_cities(spark)).withColumnRenamed("City", "Place")
    out = scores.place_insights(hs).collect()
    for r in out:
        assert 0.0 <= r.hidden_gem_score <= 1.0 and 0.0 <= r.risk_score <= 1.0
