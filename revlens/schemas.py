"""Declared schemas: one StructType per table, no inference."""

from pyspark.sql import types as T

# Raw review rows as they arrive (CSV or Parquet).
REVIEWS = T.StructType([
    T.StructField("City", T.StringType(), True),
    T.StructField("Place", T.StringType(), True),
    T.StructField("Review", T.StringType(), True),
    T.StructField("Rating", T.FloatType(), True),
    T.StructField("Name", T.StringType(), True),
    T.StructField("Date", T.StringType(), True),
    T.StructField("Raw_Review", T.StringType(), True),
])

SENTIMENT_SCORES = T.StructType([
    T.StructField("City", T.StringType(), True),
    T.StructField("Place", T.StringType(), True),
    T.StructField("Rating", T.DoubleType(), True),
    T.StructField("polarity", T.DoubleType(), True),
    T.StructField("subjectivity", T.DoubleType(), True),
    T.StructField("sentiment", T.StringType(), True),
])

LEXICON = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("polarity", T.DoubleType(), True),
    T.StructField("subjectivity", T.DoubleType(), True),
    T.StructField("intensity", T.DoubleType(), True),
])

CITY_STATE = T.StructType([
    T.StructField("City", T.StringType(), False),
    T.StructField("State", T.StringType(), False),
])

CITY_COORDS = T.StructType([
    T.StructField("city", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
])

ASPECTS = T.StructType([
    T.StructField("aspect", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
])

TREND_STATUS = T.StructType([
    T.StructField("keyword", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("notes", T.StringType(), True),
])

LOAD_CURVE = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("sample_size", T.LongType(), False),
    T.StructField("elapsed_seconds", T.DoubleType(), True),
    T.StructField("rows_per_second", T.DoubleType(), True),
    T.StructField("notes", T.StringType(), True),
])

# The given tables; with a declared schema no job reads file footers to infer one.
GIVEN_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
               "o_orderpriority string"),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}
