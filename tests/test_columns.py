import math

from pyspark.sql import functions as F

from revlens.functions import columns as C
from revlens.sources.files import clean_reviews

REVIEW_SCHEMA = "City string, Place string, Review string, Rating double, Raw_Review string"


def test_clean_drops_null_and_nan_before_clamp(spark):
    rows = [("A", "p", None, None, None), ("A", "p", None, float("nan"), None), ("A", "p", None, 0.0, None),
            ("A", "p", None, 7.5, None), ("A", "p", None, 4.7, None), (None, "p", None, 3.0, None),
            ("A", None, None, 3.0, None), ("  Agra ", "p", None, 3.0, None)]
    df = spark.createDataFrame(rows, REVIEW_SCHEMA)
    out = clean_reviews(df).orderBy("Rating", "City").collect()
    assert [r.Rating for r in out] == [1.0, 3.0, 4.7, 5.0]
    assert "Agra" in [r.City for r in out]


def test_least_skips_null_so_filter_first(spark):
    # the reason for the filter-before-clamp order
    v = spark.range(1).select(F.least(F.lit(5.0), F.lit(None).cast("double")).alias("x")).first().x
    assert v == 5.0


def test_choose_review_text(spark):
    rows = [(1, None, "raw"), (2, "   ", "raw"), (3, "!!!", "raw"), (4, None, None), (5, "own", "raw")]
    df = spark.createDataFrame(rows, "id int, Review string, Raw_Review string")
    got = {r.id: r.t for r in df.select("id", C.choose_review_text().alias("t")).collect()}
    assert got == {1: "raw", 2: "raw", 3: "!!!", 4: "", 5: "own"}


def test_normalise_text(spark):
    df = spark.createDataFrame([("Café, GREAT!!  food",), (None,), ("  a\tb\nc  ",)], "t string")
    got = [r.x for r in df.select(C.normalise_text("t").alias("x")).collect()]
    assert got == ["caf great food", "", "a b c"]


def test_polarity_label_bounds_strict(spark):
    vals = [0.05, -0.05, 0.0501, -0.0501, -1.0, 1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r.l for r in df.select(C.polarity_label("p").alias("l")).collect()]
    assert got == ["Neutral", "Neutral", "Positive", "Negative", "Negative", "Positive", "Neutral"]


def test_predicates(spark):
    df = spark.createDataFrame([("Agra", "a.b+c", 3.0), ("agra", "xyz", 4.5), ("Delhi", None, 5.0)],
                               "City string, Review string, Rating double")
    assert df.filter(C.ci_equals("City", "AGRA")).count() == 2
    assert df.filter(C.at_least("Rating", "4")).count() == 2
    assert df.filter(C.at_least("Rating", "not a number")).count() == 3
    # literal, not regex; NULL text never matches
    assert df.filter(C.contains_literal("Review", "A.B+")).count() == 1
    assert df.filter(C.contains_literal("Review", ".")).count() == 1


def test_numeric_helpers(spark):
    df = spark.createDataFrame([(-3.0, 2.0, "x"), (0.0, 9.0, "1.5"), (3.0, 0.5, None)],
                               "n double, avg double, s string")
    out = df.select(C.log1p_nonneg("n").alias("l"), C.expm1_long(F.col("avg") - 2.0).alias("e"),
                    C.five_star_proxy("avg").alias("f"), C.coerce_number("s", 0.0).alias("c"),
                    C.rating_bucket(F.lit(4.7)).alias("b")).collect()
    assert out[0].l == 0.0 and abs(out[2].l - math.log1p(3.0)) < 1e-12
    # expm1 of 0, 7, -1.5 truncated toward zero
    assert [r.e for r in out] == [0, 1095, 0]
    assert [r.f for r in out] == [0.25, 1.0, 0.0]
    assert [r.c for r in out] == [0.0, 1.5, 0.0]
    assert out[0].b == 4


def test_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (0.33,), (0.66,)], "x double")
    got = df.select(C.scaled_band("x").alias("s"), C.trend_band("x").alias("t"),
                    C.rating_band(F.col("x") * 5).alias("r")).collect()
    assert [r.s for r in got] == ["low", "mid", "high", "mid", "high"]
    assert [r.t for r in got] == ["Low", "Medium", "High", "Low", "Medium"]
    assert [r.r for r in got] == ["low", "low", "high", "low", "mid"]
