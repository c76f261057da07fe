from revlens.operators import joins


def test_fuzzy_coords_priority(spark):
    coords = spark.createDataFrame([
        ("Kochi (Cochin)", 9.9, 76.2, 0), ("Agra", 27.1, 78.0, 1), ("New  Delhi", 28.6, 77.2, 2),
        ("Mumbai", 19.0, 72.8, 3), ("Mumbai Suburban", 19.1, 72.9, 4)], "city string, lat double, lon double, ordinal int")
    cities = spark.createDataFrame([("Kochi",), ("agra",), ("New Delhi",), ("Mumbai City",), ("Mum",), ("Nowhere",)],
                                   "City string")
    got = {r.City: (r.lat, r.lon) for r in joins.fuzzy_city_coords(cities, coords).collect()}
    assert got["Kochi"] == (9.9, 76.2)          # bracket removed, lower-cased
    assert got["agra"] == (27.1, 78.0)          # case-insensitive pass
    assert got["New Delhi"] == (28.6, 77.2)     # white space collapsed
    assert got["Mumbai City"] == (19.0, 72.8)   # entry is a prefix of the city
    assert got["Mum"] == (19.0, 72.8)           # city is a prefix: first entry wins
    assert "Nowhere" not in got


def test_city_state_inner_drops_unmapped(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "City string, v int")
    dim = spark.createDataFrame([("A", "S")], "City string, State string")
    assert joins.map_city_state(df, dim).count() == 1
    assert joins.map_city_state(df, dim, keep_unmapped=True).count() == 2


def test_ratings_with_sentiment_default(spark):
    r = spark.createDataFrame([("A", 4.0), ("B", 3.0)], "City string, avg_rating double")
    s = spark.createDataFrame([("A", 0.4)], "City string, avg_polarity double")
    got = {x.City: x.avg_polarity for x in joins.ratings_with_sentiment(r, s, "City").collect()}
    assert got == {"A": 0.4, "B": 0.0}


def test_feature_frame_defaults(spark):
    place = spark.createDataFrame([("P1", 4.0, 10, None), ("P2", 3.0, 5, 0.5)],
                                  "Place string, avg_rating double, review_count long, rating_std double")
    mapping = spark.createDataFrame([("P1", "C1")], "Place string, primary_city string")
    cq = spark.createDataFrame([("C9", 4.1, 0.8)], "primary_city string, city_avg_rating double, city_five_star_rate double")
    pc = spark.createDataFrame([("C9", 3)], "primary_city string, city_place_count long")
    ps = spark.createDataFrame([("P9", 0.1, 0.2)], "Place string, avg_polarity double, avg_subjectivity double")
    cs = spark.createDataFrame([("C9", 0.3)], "primary_city string, city_avg_polarity double")
    out = {r.Place: r for r in joins.place_feature_frame(place, mapping, cq, pc, ps, cs).collect()}
    p1 = out["P1"]
    assert (p1.city_avg_rating, p1.city_place_count, p1.city_five_star_rate, p1.rating_std) == (4.0, 1, 0.5, 0.0)


def test_places_in_state_semi(spark):
    places = spark.createDataFrame([("P1",), ("P2",)], "Place string")
    mapping = spark.createDataFrame([("P1", "C1"), ("P2", "C2")], "Place string, primary_city string")
    dim = spark.createDataFrame([("C1", "S1"), ("C2", "S2")], "City string, State string")
    assert [r.Place for r in joins.places_in_state(places, mapping, dim, "S1").collect()] == ["P1"]


def test_place_insight_frame_optional_joins(spark):
    hs = spark.createDataFrame([("P1", 0.9), ("P2", 0.1)], "Place string, hotspot_score double")
    top = spark.createDataFrame([("P1", "C1")], "Place string, city string")
    sent = spark.createDataFrame([("P1", 0.4, "Positive", 9.9)],
                                 "Place string, avg_subjectivity double, dominant_sentiment string, other double")
    pred = spark.createDataFrame([("P2", 12, 1)], "Place string, predicted_review_count long, popularity_rank int")
    out = {r.Place: r for r in joins.place_insight_frame(hs, top, sent, pred).collect()}
    assert out["P1"].City == "C1" and out["P2"].City == "Unknown"
    assert out["P1"].dominant_sentiment == "Positive" and "other" not in out["P1"].asDict()
    assert out["P2"].popularity_rank == 1 and out["P1"].predicted_review_count is None


def test_enrich_missing_columns_only_adds_new(spark):
    left = spark.createDataFrame([("A", 1.0)], "City string, avg_polarity double")
    right = spark.createDataFrame([("A", 5.0, 0.3)], "City string, avg_polarity double, avg_subjectivity double")
    out = joins.enrich_missing_columns(left, right, "City").first()
    assert out.avg_polarity == 1.0 and out.avg_subjectivity == 0.3
