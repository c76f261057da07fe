import re

from pyspark.sql import functions as F

from revlens.operators import text
from revlens.sources import dimensions as dims

ASPECTS = {"food": ["eat", "entry fee"], "view": ["view"]}


def _reviews(spark):
    rows = [(1, "The weather was fine", 4.0), (2, "Paid the ENTRY FEE, ok", 2.0), (3, "Nice view, will eat here", None),
            (4, "", 5.0), (5, "preview only", float("nan"))]
    return spark.createDataFrame(rows, "id int, Review string, Rating double")


def test_substring_vs_word_boundary(spark):
    df = _reviews(spark)
    sub = {r.aspect: (r.mentions, r.avg_rating) for r in text.aspect_mentions(df, ASPECTS).collect()}
    # 'eat' inside 'weather' counts as a substring hit; 'view' inside 'preview' too
    assert sub["food"] == (3, 3.0) and sub["view"] == (2, None)
    wb = {r.aspect: r.mentions for r in text.aspect_summary(df.withColumnRenamed("Review", "review_text"), ASPECTS)
          .collect()}
    assert wb == {"food": 2, "view": 1}


def test_all_aspects_listed_and_top(spark):
    df = spark.createDataFrame([(1, "nothing here", 3.0)], "id int, Review string, Rating double")
    m = text.aspect_mentions(df, ASPECTS)
    assert m.count() == 2
    assert text.top_aspect(m).first().top_aspect == "food"  # tie -> first in dictionary order


def test_lexicon_sentiment_modifiers(spark):
    lex = dims.lexicon_frame(spark)
    rows = [(1, "good"), (2, "not good"), (3, "very good"), (4, "nothing to score"), (5, None), (6, "good bad"),
            (7, "not very good"), (8, "never really worst")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = {r.id: (r.polarity, r.subjectivity, r.sentiment)
           for r in text.lexicon_sentiment(df, lex, "id", F.col("t")).collect()}
    assert out[1] == (0.5, 0.75, "Positive")
    assert out[2][0] == -0.25 and out[2][2] == "Negative"
    assert out[3][0] == 0.75
    assert out[7][0] == -0.375  # both modifiers act
    assert out[8][0] == 0.75
    assert out[4] == (0.0, 0.0, "Neutral") and out[5] == (0.0, 0.0, "Neutral")
    assert out[6][0] == 0.0


def test_lexicon_sentiment_scores_in_range(spark):
    lex = dims.lexicon_frame(spark)
    df = spark.createDataFrame([(1, "extremely best best"), (2, "extremely worst")], "id int, t string")
    for r in text.lexicon_sentiment(df, lex, "id", F.col("t")).collect():
        assert -1.0 <= r.polarity <= 1.0 and 0.0 <= r.subjectivity <= 1.0


def test_lexicon_sentiment_counts_a_repeated_word_once(spark):
    lex = spark.createDataFrame([("good", 0.5, 0.5, None), ("good", 1.0, 0.5, None)], dims.schemas.LEXICON)
    df = spark.createDataFrame([(1, "good thing"), (2, "")], "id int, t string")
    out = {r.id: r.polarity for r in text.lexicon_sentiment(df, lex, "id", F.col("t")).collect()}
    assert out == {1: 0.75, 2: 0.0}


def test_one_pass_equals_one_test_per_keyword(spark):
    """Keywords that overlap, begin alike or hold others are all found, in both modes."""
    aspects = {"a": ["view", "review", "park"], "b": ["parking", "entry", "entry fee"], "c": ["fee", "rev", "iew", "in.g"]}
    texts = ["a review of parking", "entry feed", "entry fee", "Viewpark", "the ENTRY", "rev-iew", "in.g ing", "", None, "park entry fees view", "reviewer parkinging fee"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for mode in ("substring", "regex"):
        got = {r["id"]: [r["_a0"], r["_a1"], r["_a2"]] for r in text.aspect_hits(df, aspects, "t", mode, ["id"]).collect()}
        for i, t in enumerate(texts):
            low = (t or "").lower()
            has = (lambda k: k in low) if mode == "substring" else (lambda k: re.search(rf"(?<!\w){re.escape(k)}(?!\w)", low) is not None)  # noqa: B023
            assert got[i] == [any(map(has, kws)) for kws in aspects.values()], (mode, t)


def test_trigram_search_equals_a_scan(spark, monkeypatch):
    import random

    from revlens.operators import search
    rng = random.Random(6)
    words = ["station", "Stadion", "naïve", "tic", "a.b", "x\ny", "ÉTÉ", "%_%"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(300)] + [(900, None), (901, ""), (902, "ab")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    index = search.build_index(df, "id", "t")
    for listed in (1000, 3):
        monkeypatch.setattr(search, "LISTED", listed)
        for word in ("stat", "TION", "été", "a.b", "x\ny", "%_%", "ab", "", "t n", "missing", "tic stadion"):
            got = sorted(r["id"] for r in search.search(index, word).collect())
            assert got == [i for i, t in rows if t is not None and word.lower() in t.lower()], word


def test_trigram_search_reads_few_texts(spark):
    from revlens.operators import search
    df = spark.range(0, 50_000, 1, 8).select("id", F.concat(F.lit("some filler text "), F.md5(F.col("id").cast("string").cast("binary"))).alias("t"))
    index = search.build_index(df, "id", "t")
    word = df.filter("id = 31234").head()["t"][20:32]
    assert search.candidates(index, word).count() <= 3
    assert [r["id"] for r in search.search(index, word).collect()] == [31234]
    assert search.search(index, word)._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [In(id, [") + \
        search.search(index, word)._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [IsNotNull(id), EqualTo(id,") > 0


def test_trigrams_are_taken_once_and_never_shuffled(spark, monkeypatch):
    from revlens.operators import search
    stored, kept = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df: stored.append(df) or kept(df))
    rows = [(i, f"Text {i % 7} naïve 😀{i}\nend") for i in range(200)] + [(900, None), (901, ""), (902, "ab"), (903, "abc")]
    index = search.build_index(spark.createDataFrame(rows, "id long, t string").repartition(4), "id", "t")
    plan = stored[1]._jdf.queryExecution().executedPlan().toString()  # the rows of trigrams
    assert "Exchange" not in plan[:plan.index("Generate")]
    want = {(t.lower()[k:k + 3], i) for i, t in rows if t for k in range(len(t) - 2)}
    want = spark.createDataFrame(sorted(want), "g string, id long").select(F.xxhash64("g").alias("gram"), "id")
    assert want.exceptAll(index.grams).isEmpty()
    assert index.grams.exceptAll(want).join(want, "gram", "left_semi").isEmpty()  # nothing but halves of surrogate pairs


def test_trigrams_are_taken_in_parts_of_bounded_size(spark, monkeypatch):
    from revlens.operators import search
    monkeypatch.setattr(search, "PART_BYTES", 1000)
    df = spark.range(100).select("id", F.rpad(F.col("id").cast("string"), 100, "filler ").alias("t")).coalesce(1)
    index = search.build_index(df, "id", "t")
    assert len(index.grams.inputFiles()) == 10


def test_equal_hashes_of_trigrams_lose_no_text(spark):
    from revlens.operators import search
    index = search.build_index(spark.createDataFrame([(1, "abcd"), (2, "abc")], "id long, t string"), "id", "t")
    clash = index.grams.filter("id = 1").limit(1)  # as if another trigram of the text had the hash of one that is sought
    index = search.TrigramIndex(index.texts, index.grams.unionAll(clash), "id", "t")
    assert [r["id"] for r in search.search(index, "abcd").collect()] == [1]
