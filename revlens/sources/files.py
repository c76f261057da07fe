"""Scans, optional sources, build-once artefacts, sinks (O-01..O-10)."""

from __future__ import annotations

import hashlib
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas
from revlens.functions.columns import clamp, is_valid_number, nan_to_null
from revlens.operators.selection import head_rows, sample_rows
from revlens.session import materialize

__all__ = [
    "read_reviews_csv", "read_reviews_columns", "read_reviews_checked", "files_with_line_breaks", "clean_reviews", "first_rows", "exact_sample",
    "read_optional", "build_once", "write_table", "input_identity", "conform",
    "export_records", "path_exists",
]


def read_reviews_csv(spark: SparkSession, path: str, multiline: bool | None = True) -> DataFrame:
    """O-01: typed CSV scan, header, UTF-8, PERMISSIVE.

    Quoted fields may hold newlines and doubled quotes, so ``multiLine`` and
    ``escape='"'`` are on by default. multiLine files are not splittable: with
    ``multiline=None`` the lines are looked through once, and only files in
    which a quoted field runs over a line's end are read as a whole.
    """
    def scan(paths: str | list[str], whole: bool) -> DataFrame:
        return (spark.read.schema(schemas.REVIEWS)
                .option("header", True).option("encoding", "UTF-8")
                .option("multiLine", whole).option("escape", '"')
                .option("mode", "PERMISSIVE")
                .csv(paths))
    if multiline is not None:
        return scan(path, multiline)
    split, whole = _by_line_breaks(spark, path)
    parts = [scan(files, multi) for files, multi in ((split, False), (whole, True)) if files]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.REVIEWS)


def read_reviews_columns(spark: SparkSession, path: str, columns: list[str],
                         multiline: bool = True) -> DataFrame:
    """O-02: column-pruned scan that drops malformed lines.

    Chunked reading and concatenation become Spark's file splits.
    """
    return (spark.read.schema(schemas.REVIEWS)
            .option("header", True).option("multiLine", multiline).option("escape", '"')
            .option("mode", "DROPMALFORMED")
            .csv(path)
            .select(*columns))


def files_with_line_breaks(spark: SparkSession, path: str) -> list[str]:
    """CSV files in which a quoted field runs over a line's end: a line has an odd number of quotes."""
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), odd.alias("odd"))
    return [r["file"] for r in lines.filter("odd").select("file").distinct().collect()]


def _by_line_breaks(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Paths of CSV files that can be split, and of those that are read as a whole."""
    whole = set(files_with_line_breaks(spark, path))
    every = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect()
    names = [r["file"] for r in every]  # as URIs: blanks are escaped
    return [unquote(x) for x in names if x not in whole], [unquote(x) for x in names if x in whole]


def read_reviews_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """O-01/O-02 with nothing lost: (good rows, rejected rows as (file, record)).

    A record that doesn't parse by the schema goes to the rejects with its
    text, so good and bad add up to the records of the input. Only files with
    quoted line breaks are read as a whole (``multiLine``); the others are
    split. The input is parsed once and stored.
    """
    split, whole = _by_line_breaks(spark, path)
    schema = T.StructType([*schemas.REVIEWS.fields, T.StructField("_bad", T.StringType(), True)])

    def scan(files: list[str], multiline: bool) -> DataFrame:
        return (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("escape", '"')
                .option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
                .csv(files).withColumn("_file", F.col("_metadata.file_path")))
    parts = [scan(files, multi) for files, multi in ((split, False), (whole, True)) if files]
    if not parts:
        empty = spark.createDataFrame([], schemas.REVIEWS)
        return empty, spark.createDataFrame([], "file string, record string")
    rows = materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    good = rows.filter("_bad IS NULL").select(*schemas.REVIEWS.fieldNames())
    return good, rows.filter("_bad IS NOT NULL").select(F.col("_file").alias("file"), F.col("_bad").alias("record"))


def clean_reviews(df: DataFrame, rating: str = "Rating", keys: tuple[str, ...] = ("City", "Place"),
                  trim_keys: bool = True) -> DataFrame:
    """O-11..O-14: drop NULL/NaN ratings, clamp to [1, 5], drop NULL keys, trim keys.

    The filter comes before the clamp (``least(5, NULL)`` is 5). Filters are
    plain predicates, so Catalyst pushes the NULL tests into the scan.
    """
    out = df.filter(is_valid_number(rating))
    for k in keys:
        out = out.filter(F.col(k).isNotNull())
    out = out.withColumn(rating, clamp(rating))
    if trim_keys:
        out = out.withColumns({k: F.trim(F.col(k)) for k in keys})
    return out


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """O-03: first n rows in a stated order (a bare limit is not deterministic)."""
    return head_rows(df, n, order_by)


def exact_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """O-04: exactly min(n, rows) rows without replacement, fixed seed, repeated rows included."""
    return sample_rows(df, n, key_cols, seed)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem (works for any cluster FS)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType,
                  defaults: dict | None = None, fmt: str = "parquet") -> DataFrame:
    """O-05: table if present, else an empty frame with the declared schema.

    ``defaults`` adds missing columns as literals, so callers can rely on them.
    """
    if path_exists(spark, path):
        df = spark.read.format(fmt).schema(schema).load(path) if fmt != "parquet" else spark.read.parquet(path)
    else:
        df = spark.createDataFrame([], schema)
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def input_identity(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files under a path (metadata only)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    digest = hashlib.md5(usedforsecurity=False)
    seen = []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    digest.update("\n".join(sorted(seen)).encode())
    return digest.hexdigest()


def build_once(spark: SparkSession, path: str, build, identity: str | None = None) -> DataFrame:
    """O-06: read the artefact if it is complete, otherwise compute, store, re-read.

    Complete means that the writer left its ``_SUCCESS`` mark; a half-written
    folder is overwritten. ``identity`` (see :func:`input_identity`) names
    what it was built from: another input gets a folder of its own.
    """
    target = f"{path.rstrip('/')}/{identity}" if identity else path
    if not path_exists(spark, f"{target.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def conform(df: DataFrame, names: dict[str, str], missing: dict[str, float] | None = None) -> DataFrame:
    """O-31: rename columns to an output schema; listed columns that are absent become a literal (0.0)."""
    out = df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})
    absent = {c: F.lit(v) for c, v in (missing or {}).items() if c not in out.columns}
    return out.withColumns(absent) if absent else out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                header: bool = True) -> None:
    """O-07: table sink. Executors write in parallel; nothing goes through the driver."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def export_records(df: DataFrame, n: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """O-10: one JSON record per row, non-finite doubles as null, optional head n."""
    fixed = df.select(*[
        nan_to_null(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
    if n is not None:
        fixed = fixed.orderBy(*(order_by or df.columns)).limit(n)
    return fixed.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
