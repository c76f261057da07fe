"""Load curve (O-87): one fixed aggregation timed on growing exact samples."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import constants as K
from revlens import schemas
from revlens.sources import files
from revlens.sources import testdata as td


def city_load_query(df: DataFrame) -> DataFrame:
    """The timed aggregation: per city count, mean, std, approximate distinct places.

    Output order is presentation only (the reviewed benchmark's ``count()``
    action let Catalyst drop its sort as well), so no global sort is timed.
    """
    return df.groupBy("City").agg(
        F.count("Rating").alias("review_count"),
        F.round(F.avg("Rating"), 4).alias("avg_rating"),
        F.round(F.stddev("Rating"), 4).alias("rating_std"),
        F.approx_count_distinct("Place").alias("unique_places"))


def run_timed(df: DataFrame) -> float:
    """Force full evaluation (noop sink: every column and the sort are computed)."""
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def load_curve(spark: SparkSession, sf_dir: str, sizes=K.LOAD_SAMPLE_SIZES, repeats: int = 2) -> DataFrame:
    """Median elapsed time and rows/s per sample size, then the full table;
    each size is capped at the table size (repeats dropped); failures are
    recorded with NULL timings.

    Samples are exact-n seeded hash samples (O-04), so every size is a
    subset of the next and the curve is reproducible.
    """
    reviews = td.reviews_num(spark, sf_dir, with_key=True)
    total = reviews.count()
    wanted = sorted({min(int(n), total) for n in sizes} | {total})
    rows = []
    for n in wanted:
        sample = reviews if n == total else files.exact_sample(reviews, n, ["l_orderkey", "l_linenumber"])
        try:
            times = [run_timed(city_load_query(sample)) for _ in range(repeats)]
            med = statistics.median(times)
            rows.append(("spark", int(n), float(med), float(n / med) if med > 0 else None,
                         f"median of {repeats}, scan included, noop sink"))
        except Exception as e:  # noqa: BLE001 - a failed size is reported, not raised
            rows.append(("spark", int(n), None, None, f"failed: {str(e)[:80]}"))
    return spark.createDataFrame(rows, schemas.LOAD_CURVE)
