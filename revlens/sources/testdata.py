"""Review-shaped views over the driver's TPC-H-like tables.

``reviews_num``  (C1) — ratings, keys and a reviewer name from lineitem's
star: City = nation, Place = 'Part#' || partkey, Name = customer name,
Rating = quantity / 8 (NULL on line 7), plus sentiment stand-ins.
``reviews_text`` (C2) — documents left-joined to labels.
``interest``     (C3) — events as keyword interest over time.

Each view has an SQL twin (``*_SQL``) used by the DuckDB oracle, so the two
engines read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas
from revlens.functions.columns import clamp, is_valid_number

__all__ = [
    "read_table", "reviews_num_raw", "reviews_num", "reviews_text_docs", "with_rating", "reviews_text_raw", "interest_events",
    "trend_status", "reviews_num_sql", "REVIEWS_TEXT_SQL", "INTEREST_SQL", "TREND_STATUS_SQL",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one table, with its declared schema if it has one; the files are listed at each call."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    declared = schemas.GIVEN_TABLES.get(name)
    return (spark.read.schema(declared) if declared else spark.read).parquet(path)


def reviews_num_raw(spark: SparkSession, sf_dir: str, with_name: bool = False,
                    with_key: bool = False) -> DataFrame:
    """C1 before cleaning. ``with_name`` adds the orders/customer joins.

    nation is 25 rows (fixed by the schema), so it is broadcast; supplier,
    orders and customer grow with the data and are left to AQE, which turns a
    join into a broadcast only when the runtime size is under the threshold.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .join(F.broadcast(nat), F.col("s_nationkey") == nat.n_nationkey))
    cols = [
        F.col("n_name").alias("City"),
        F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("Place"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") / F.lit(8.0)).alias("Rating"),
        ((F.round(F.col("l_tax") * 100) - F.lit(4.0)) / F.lit(4.0)).alias("polarity"),
        (F.round(F.col("l_discount") * 100) / F.lit(16.0)).alias("subjectivity"),
    ]
    if with_name:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        df = (df.join(orders, F.col("l_orderkey") == orders.o_orderkey)
                .join(cust, F.col("o_custkey") == cust.c_custkey))
        cols.insert(2, F.col("c_name").alias("Name"))
    if with_key:
        cols += [F.col("l_orderkey"), F.col("l_linenumber")]
    return df.select(*cols)


def reviews_num(spark: SparkSession, sf_dir: str, with_name: bool = False, with_key: bool = False) -> DataFrame:
    """C1 cleaned: O-11 NULL/NaN drop, O-12 clamp, O-13 key drop, O-14 trim."""
    raw = reviews_num_raw(spark, sf_dir, with_name, with_key)
    return (raw.filter(is_valid_number("Rating") & F.col("City").isNotNull() & F.col("Place").isNotNull())
               .withColumns({"Rating": clamp("Rating"), "City": F.trim("City"), "Place": F.trim("Place")}))


def reviews_num_sql(with_name: bool = False, cleaned: bool = True) -> str:
    """SQL twin of :func:`reviews_num` as CTE text (``reviews_raw`` and ``reviews``)."""
    name_col = "c.c_name AS Name," if with_name else ""
    name_join = ("JOIN orders o ON l.l_orderkey = o.o_orderkey "
                 "JOIN customer c ON o.o_custkey = c.c_custkey") if with_name else ""
    name_sel = "Name," if with_name else ""
    raw = f"""reviews_raw AS (
  SELECT n.n_name AS City, 'Part#' || CAST(l.l_partkey AS VARCHAR) AS Place, {name_col}
         CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_quantity / 8.0 END AS Rating,
         (round(l.l_tax * 100) - 4.0) / 4.0 AS polarity,
         round(l.l_discount * 100) / 16.0 AS subjectivity
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey {name_join})"""
    if not cleaned:
        return raw
    return raw + f""",
reviews AS (
  SELECT trim(City) AS City, trim(Place) AS Place, {name_sel}
         greatest(1.0, least(5.0, CAST(Rating AS DOUBLE))) AS Rating, polarity, subjectivity
  FROM reviews_raw
  WHERE Rating IS NOT NULL AND NOT isnan(Rating) AND City IS NOT NULL AND Place IS NOT NULL)"""


def reviews_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 without ratings: doc_id, City, Place, Review, Raw_Review from documents alone."""
    d = F.col("doc_id")
    review = F.when((d % 5 != 0) & (d % 7 == 0), F.lit("   ")).when(d % 5 != 0, F.col("text"))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("City"), F.col("source").alias("Place"),
        review.alias("Review"), F.col("text").alias("Raw_Review"))


def with_rating(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the Rating of each doc_id (labels cover a subset, the rest is NULL).

    Call it on narrow rows: whatever is joined here is shuffled on doc_id.
    """
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.lit(2.0) + F.lit(3.0) * F.col("quality") - F.col("toxic")).cast("double").alias("Rating"))
    return df.join(labels, "doc_id", "left")


def reviews_text_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: documents left-joined to labels."""
    return with_rating(reviews_text_docs(spark, sf_dir), spark, sf_dir)


REVIEWS_TEXT_SQL = """reviews_text AS (
  SELECT d.doc_id, d.lang AS City, d.source AS Place,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN '   ' ELSE d.text END AS Review,
         d.text AS Raw_Review,
         CAST(1.0 + 3.0 * lb.quality + (1.0 - lb.toxic) AS DOUBLE) AS Rating
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id)"""


def interest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: keyword interest over time (keyword = event_type)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("keyword"), "ts", F.col("value").alias("interest"))


INTEREST_SQL = """interest AS (
  SELECT event_type AS keyword, ts, value AS interest FROM events)"""


def trend_status(keywords: DataFrame, fallback_keyword: str = "error") -> DataFrame:
    """Fetch status per keyword, derived from the data: one keyword is a fallback."""
    fb = F.col("keyword") == F.lit(fallback_keyword)
    return keywords.select(
        "keyword",
        F.when(fb, F.lit("fallback")).otherwise(F.lit("live")).alias("status"),
        F.when(fb, F.lit("No data fetched")).otherwise(F.lit("Fetched")).alias("notes"),
    )


TREND_STATUS_SQL = """trend_status AS (
  SELECT keyword,
         CASE WHEN keyword = 'error' THEN 'fallback' ELSE 'live' END AS status,
         CASE WHEN keyword = 'error' THEN 'No data fetched' ELSE 'Fetched' END AS notes
  FROM (SELECT DISTINCT keyword FROM interest))"""
