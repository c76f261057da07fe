import os

from pyspark.sql import functions as F

from revlens import schemas
from revlens.sources import files


def test_csv_multiline_and_doubled_quotes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "reviews.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("City,Place,Review,Rating,Name,Date,Raw_Review\n")
        f.write('Agra,Taj,"line one\nline ""two""",4.5,u1,,raw\n')
        f.write("Delhi,Fort,plain,3.0,u2,,raw2\n")
    df = files.read_reviews_csv(spark, path)
    rows = df.orderBy("City").collect()
    assert len(rows) == 2 and rows[0].Review == 'line one\nline "two"'
    pruned = files.read_reviews_columns(spark, path, ["City", "Rating"])
    assert pruned.columns == ["City", "Rating"] and pruned.count() == 2


def test_csv_files_without_line_breaks_are_split(spark, tmp_dir):
    path = os.path.join(tmp_dir, "review files")
    os.makedirs(path)
    head = "City,Place,Review,Rating,Name,Date,Raw_Review\n"
    for name, row in (("a", 'Agra,Taj,"line one\nline ""two""",4.5,u1,,raw\n'), ("b b", 'Delhi,Fort,"says ""hi"" twice",3.0,u2,,raw2\n')):
        with open(os.path.join(path, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write(head + row * 3)
    split, whole = files._by_line_breaks(spark, path)
    assert len(split) == len(whole) == 1 and whole[0].endswith("a.csv")
    every = files.read_reviews_csv(spark, path, multiline=None)
    assert sorted(map(tuple, every.collect()), key=str) == sorted(map(tuple, files.read_reviews_csv(spark, path).collect()), key=str)
    assert every.count() == 6


def test_optional_source_defaults(spark, tmp_dir):
    df = files.read_optional(spark, os.path.join(tmp_dir, "absent"), schemas.SENTIMENT_SCORES,
                             defaults={"extra": 0.0})
    assert df.count() == 0 and "extra" in df.columns


def test_build_once_and_sink(spark, tmp_dir):
    path = os.path.join(tmp_dir, "artefact")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert files.build_once(spark, path, build).count() == 5
    assert files.build_once(spark, path, build).count() == 5
    assert len(calls) == 1
    os.remove(os.path.join(path, "_SUCCESS"))  # a half-written table is built again
    assert files.build_once(spark, path, build).count() == 5 and len(calls) == 2
    a, b = (files.build_once(spark, os.path.join(tmp_dir, "by_input"), lambda n=n: spark.range(n), str(n)) for n in (2, 3))
    assert (a.count(), b.count()) == (2, 3)
    out = os.path.join(tmp_dir, "csv_out")
    files.write_table(spark.range(3), out, fmt="csv")
    assert spark.read.option("header", True).csv(out).count() == 3


def test_export_records_non_finite(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, x double")
    recs = [r.record for r in files.export_records(df, 2, ["id"]).collect()]
    assert recs == ['{"id":1,"x":null}', '{"id":2,"x":null}']


def test_exact_sample_size_and_determinism(spark):
    df = spark.range(1000).withColumn("k2", F.col("id") % 3)
    a = sorted(r.id for r in files.exact_sample(df, 100, ["id"]).collect())
    b = sorted(r.id for r in files.exact_sample(df.repartition(7), 100, ["id"]).collect())
    assert len(a) == 100 and a == b


def test_exact_sample_is_a_prefix_of_a_larger_one(spark):
    df = spark.range(3000)
    small = {r.id for r in files.exact_sample(df, 70, ["id"]).collect()}
    large = {r.id for r in files.exact_sample(df, 700, ["id"]).collect()}
    assert small < large and len(large) == 700
    assert files.exact_sample(df, 5000, ["id"]).count() == 3000


def test_read_optional_present(spark, tmp_dir):
    path = os.path.join(tmp_dir, "present")
    spark.createDataFrame([("A", "P", 4.0, 0.1, 0.2, "Positive")], schemas.SENTIMENT_SCORES).write.parquet(path)
    df = files.read_optional(spark, path, schemas.SENTIMENT_SCORES, defaults={"extra": 1.0})
    assert df.count() == 1 and df.first().extra == 1.0


def test_materialize_goes_to_checkpoint_dir(spark):
    from revlens.session import ensure_checkpoint_dir, materialize
    df = materialize(spark.range(10))
    assert df.count() == 10
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    assert any(base.rstrip("/") in f.replace("file:", "") for f in df.inputFiles())


def test_input_identity_follows_the_files(spark, tmp_dir):
    path = os.path.join(tmp_dir, "in")
    spark.range(3).write.parquet(path)
    one = files.input_identity(spark, path)
    assert one == files.input_identity(spark, path)
    spark.range(3).write.mode("append").parquet(path)
    assert one != files.input_identity(spark, path)


def test_conform_renames_and_fills(spark):
    df = spark.createDataFrame([(1, 2.0)], "ReviewCount int, AverageRating double")
    out = files.conform(df, {"ReviewCount": "total_reviews", "SentimentScore": "avg_polarity"}, {"avg_polarity": 0.0})
    assert out.columns == ["total_reviews", "AverageRating", "avg_polarity"] and out.first().avg_polarity == 0.0


def test_rejects_and_good_rows_add_up(spark, tmp_dir):
    import os
    head = "City,Place,Review,Rating,Name,Date,Raw_Review\n"
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/plain.csv", "w", encoding="utf-8") as f:
        f.write(head + 'A,P,ok,4.5,n,d,r\nA,P,bad,four,n,d,r\nB,Q,"say ""hi""",3,n,d,r\n')
    with open(f"{tmp_dir}/in/broken.csv", "w", encoding="utf-8") as f:
        f.write(head + 'C,P,"two\nlines",2,n,d,r\nC,P,x,y,n,d,r\nC,P,z,5,n,d,"last\n\none"\n')
    assert [p.rsplit("/", 1)[1] for p in files.files_with_line_breaks(spark, f"{tmp_dir}/in")] == ["broken.csv"]
    good, bad = files.read_reviews_checked(spark, f"{tmp_dir}/in")
    assert sorted((r["City"], r["Review"], r["Rating"]) for r in good.collect()) == [("A", "ok", 4.5), ("B", 'say "hi"', 3.0), ("C", "two\nlines", 2.0), ("C", "z", 5.0)]
    assert sorted((r["file"].rsplit("/", 1)[1], r["record"].split(",")[3]) for r in bad.collect()) == [("broken.csv", "y"), ("plain.csv", "four")]


def test_incremental_rollup_equals_a_full_one(spark, tmp_dir):
    from pyspark.sql import functions as F

    from revlens.sources import incremental
    seen = []

    def read(paths):
        seen.append(len(paths))
        return spark.read.parquet(*paths)

    def update():
        df = incremental.update_rollup(spark, f"{tmp_dir}/in", f"{tmp_dir}/store", read, lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n")),
                                       lambda d: d.groupBy("k").agg(F.sum("n").alias("n")))
        return sorted(map(tuple, df.collect()))

    def full():
        return sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/in").groupBy("k").count().collect()))
    rows = spark.range(100).select((F.col("id") % 7).alias("k")).coalesce(1)
    for _ in range(3):
        rows.write.mode("append").parquet(f"{tmp_dir}/in")
        assert update() == full()
    assert update() == full() and seen == [1, 1, 1], "a file is read once; without new files nothing is read"
    rows.limit(10).write.mode("overwrite").parquet(f"{tmp_dir}/in")
    assert update() == full() and seen == [1, 1, 1, 1], "files that vanished start the store anew"


def test_shared_copy_ends_with_its_users(spark):
    import os

    from revlens.session import shared
    with shared(spark.range(5)) as t:
        folder = t.inputFiles()[0].split("file:", 1)[1].replace("///", "/").rsplit("/", 1)[0]
        assert t.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_cached_trends(spark):
    from revlens.operators.scores import cached_trends
    cols = "Place string, status string, source string"
    live = spark.createDataFrame([("a", "live", "s"), ("b", "fallback", "t")], cols)
    assert {(r["status"], r["source"]) for r in cached_trends(live).collect()} == {("cached", "cached")}
    assert cached_trends(live.filter("Place = 'b'")) is None and cached_trends(None) is None
