import os

from revlens.operators import aggregates as agg
from revlens.sources import testdata as td
from revlens.streaming import current_city_ratings, start_city_ratings

from paths import SF_SMALL


def _table(df):
    return {r.City: (r.avg_rating, r.review_count, r.rating_std) for r in df.collect()}


def test_incremental_city_ratings_match_batch_and_resume(spark, tmp_dir):
    lines_dir, out, progress = (os.path.join(tmp_dir, d) for d in ("lines", "out", "progress"))
    li = td.read_table(spark, SF_SMALL, "lineitem")
    first, second = li.filter("l_orderkey % 3 > 0"), li.filter("l_orderkey % 3 = 0")
    first.repartition(3, "l_orderkey").write.parquet(lines_dir)
    start_city_ratings(spark, lines_dir, SF_SMALL, out, progress, max_files=1).awaitTermination(300)
    assert sum(r.review_count for r in current_city_ratings(spark, out).collect()) == \
        first.filter("l_linenumber <> 7").count()
    # a new session finds the progress and reads only the new file
    second.coalesce(1).write.mode("append").parquet(lines_dir)
    q = start_city_ratings(spark.newSession(), lines_dir, SF_SMALL, out, progress)
    q.awaitTermination(300)
    assert len([p for p in q.recentProgress if p["sources"][0]["numInputRows"]]) == 1
    assert _table(current_city_ratings(spark, out)) == _table(agg.average_ratings(td.reviews_num(spark, SF_SMALL), "City"))
