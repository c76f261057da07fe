"""Per-city ratings maintained incrementally as new review files land.

The batch rollup (O-39 per city) re-expressed as a Structured Streaming
query: new line files are read as a stream, joined to the static supplier
and nation dimensions (stream-static joins), cleaned with the same column
functions, and aggregated with Spark's state store. Each micro-batch writes
its whole result to a folder of its own (idempotent per epoch), and readers
take the newest complete one, so no result changes under them. Progress and
state live under a folder that the caller names, split by source: a restarted
or relocated driver resumes where it stopped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.columns import clamp, is_valid_number
from revlens.sources.testdata import read_table


def city_ratings_stream(spark: SparkSession, lines_dir: str, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Streaming frame: City, avg_rating, review_count, rating_std (4 dp).

    ``max_files`` bounds a micro-batch; by default it takes all new files.
    """
    schema = read_table(spark, sf_dir, "lineitem").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = (reader.parquet(lines_dir).select("l_suppkey", "l_linenumber", "l_quantity"))
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rated = (lines.join(sup, lines.l_suppkey == sup.s_suppkey)
                  .join(F.broadcast(nat), F.col("s_nationkey") == nat.n_nationkey)
                  .select(F.trim("n_name").alias("City"),
                          F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
                           .otherwise(F.col("l_quantity") / F.lit(8.0)).alias("Rating")))
    clean = rated.filter(is_valid_number("Rating") & F.col("City").isNotNull()).withColumn("Rating", clamp("Rating"))
    return clean.groupBy("City").agg(
        F.round(F.avg("Rating"), 4).alias("avg_rating"),
        F.count("Rating").alias("review_count"),
        F.round(F.stddev_samp("Rating"), 4).alias("rating_std"))


def start_city_ratings(spark: SparkSession, lines_dir: str, sf_dir: str, out_path: str, checkpoint: str,
                       available_now: bool = True, max_files: int | None = None):
    """Start the query; epoch n writes the full current result to ``out_path/epoch=n``.

    ``checkpoint`` is a shared folder that stays the same over restarts; each
    source folder has its own progress there.
    """
    source = hashlib.md5(lines_dir.rstrip("/").encode(), usedforsecurity=False).hexdigest()

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}")

    w = (city_ratings_stream(spark, lines_dir, sf_dir, max_files).writeStream.outputMode("complete")
         .foreachBatch(write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{source}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def current_city_ratings(spark: SparkSession, out_path: str) -> DataFrame:
    """The result of the newest epoch whose write is complete."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_path.rstrip('/')}/epoch=*/_SUCCESS")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(fs_path)]
    if not done:
        raise FileNotFoundError(f"no complete result under {out_path}")
    return spark.read.parquet(f"{out_path.rstrip('/')}/epoch={max(done)}")
