"""Dimension tables: fixed dictionaries and dimensions derived from the data.

Dimensions here are bounded by construction (a fixed list, or one row per
nation), which is what makes broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas
from revlens.sources.testdata import read_table

__all__ = [
    "SEARCH_ASPECTS", "SUMMARY_ASPECTS", "DEFAULT_LEXICON", "NEGATORS", "graded_lexicon",
    "lexicon_frame", "city_state_from_regions", "coords_from_nations", "values_sql",
    "COMMON_WORD_LEXICON", "COMMON_NEGATORS", "lexicon_values_sql", "CITY_STATE_SQL", "COORDS_SQL", "COMMON_WORD_ASPECTS",
]

# ── Fixed values (must equal the reviewed application's dictionaries) ─────
# Aspect keywords of the review search: matched as plain substrings,
# each aspect counted once per review.
SEARCH_ASPECTS = {
    "cleanliness": ["clean", "dirty", "hygiene", "hygienic", "filthy", "neat", "tidy",
                    "waste", "garbage", "littered", "spotless"],
    "crowd": ["crowd", "crowded", "rush", "busy", "packed", "tourists", "queue",
              "waiting", "jammed", "overrated", "overwhelming"],
    "food": ["food", "eat", "restaurant", "snack", "meal", "tasty", "delicious",
             "stall", "dhaba", "cuisine", "drink", "beverage", "biryani",
             "chai", "coffee"],
    "price": ["price", "cost", "expensive", "cheap", "affordable", "money",
              "worth", "value", "ticket", "entry fee", "overpriced", "budget"],
    "safety": ["safe", "safety", "dangerous", "unsafe", "secure", "security",
               "theft", "police", "guard", "harassment", "risk"],
    "family": ["family", "kids", "children", "child", "baby", "parents",
               "couple", "romantic", "picnic", "outing", "trip"],
    "scenery": ["beautiful", "scenic", "view", "nature", "landscape", "sunrise",
                "sunset", "hills", "mountains", "waterfall", "beach", "lake",
                "river", "greenery", "peaceful", "serene"],
    "transport": ["transport", "bus", "auto", "cab", "taxi", "parking", "road",
                  "accessible", "connectivity", "drive", "train", "metro",
                  "highway", "route"],
}

# Aspect keywords of the dashboard summary: matched on word boundaries.
SUMMARY_ASPECTS = {
    "Cleanliness": ["clean", "hygiene", "dirty", "maintained", "washroom", "toilet"],
    "Crowd": ["crowd", "queue", "rush", "busy", "packed", "waiting", "line"],
    "Food": ["food", "restaurant", "snack", "cafe", "meal", "taste", "dining"],
    "Price": ["price", "ticket", "cost", "expensive", "cheap", "value", "worth"],
    "Safety": ["safe", "security", "police", "danger", "risky", "guard"],
    "Family": ["family", "kids", "children", "child", "elderly", "parents"],
    "Scenery": ["view", "scenic", "beautiful", "sunset", "nature", "photo", "landscape"],
    "Transport": ["parking", "metro", "bus", "taxi", "traffic", "road", "access"],
}
# ── end of fixed values ────────────────────────────────────────────────────

# The default opinion lexicon. Its method: common English opinion words are
# sorted by hand into grades, and all scores follow from the grade: polarity
# is the grade, subjectivity 0.5 + |grade| / 2. It is taken from no published
# lexicon; pass a full lexicon table for production scoring.
GRADES = {
    1.0: ["best", "excellent", "perfect", "outstanding"],
    0.75: ["great", "amazing", "awesome", "wonderful", "fantastic", "superb"],
    0.5: ["good", "nice", "beautiful", "lovely", "pleasant", "happy", "enjoyable"],
    0.25: ["clean", "peaceful", "friendly", "worth", "fine", "calm", "helpful"],
    -0.25: ["crowded", "expensive", "noisy", "slow", "overrated"],
    -0.5: ["bad", "poor", "dirty", "boring", "rude", "unsafe", "waste"],
    -0.75: ["awful", "filthy", "disgusting"],
    -1.0: ["worst", "terrible", "horrible"],
}
INTENSIFIERS = {1.5: ["very", "really", "extremely", "so", "too"], 1.25: ["quite", "rather"],
                0.5: ["slightly", "somewhat"]}
NEGATORS = ["not", "no", "never", "nothing", "nor", "without"]


def graded_lexicon(grades: dict, intensifiers: dict) -> dict:
    """word -> (polarity, subjectivity, intensity); intensity only for modifiers."""
    scored = {w: (g, 0.5 + abs(g) / 2, None) for g, words in grades.items() for w in words}
    return {**scored, **{w: (None, None, f) for f, words in intensifiers.items() for w in words}}


DEFAULT_LEXICON = graded_lexicon(GRADES, INTENSIFIERS)

# Frequent words of the synthetic test prose graded the same way, so that the
# test data reach every label, chains of modifiers and the clipping.
COMMON_WORD_LEXICON = graded_lexicon(
    {1.0: ["was", "den", "les"], 0.5: ["it", "that", "von", "el"], -0.5: ["is", "la", "die", "by"],
     -1.0: ["on", "as", "des", "un"]},
    {1.5: ["the", "der", "de", "and"], 0.5: ["a", "und", "y"]})
COMMON_NEGATORS = ["of", "to", "que", "nicht"]


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v)) if isinstance(v, float) else str(v)


def values_sql(rows: list[tuple], columns: list[str], types: list[str]) -> str:
    """Inline VALUES relation for the SQL oracle (same rows as the Spark frame)."""
    body = ", ".join("(" + ", ".join(f"CAST({_sql_literal(v)} AS {t})" for v, t in zip(r, types)) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def _lexicon_rows(lexicon: dict, negators: list[str]) -> list[tuple]:
    rows = [(w, p, s, i) for w, (p, s, i) in lexicon.items()]
    rows += [(w, None, None, -0.5) for w in negators if w not in lexicon]
    return rows


def lexicon_frame(spark: SparkSession, lexicon: dict | None = None,
                  negators: list[str] | None = None) -> DataFrame:
    """Lexicon table: scored words, modifiers (intensity) and negators (-0.5).

    An inline relation, so Catalyst knows its size and picks the join by it.
    """
    rows = _lexicon_rows(lexicon or DEFAULT_LEXICON, NEGATORS if negators is None else negators)
    fields = schemas.LEXICON.fields
    return spark.sql("SELECT * FROM " + values_sql(rows, [f.name for f in fields],
                                                   [f.dataType.simpleString() for f in fields]))


def lexicon_values_sql(lexicon: dict | None = None, negators: list[str] | None = None) -> str:
    return values_sql(_lexicon_rows(lexicon or DEFAULT_LEXICON, NEGATORS if negators is None else negators),
                      ["word", "polarity", "subjectivity", "intensity"],
                      ["VARCHAR", "DOUBLE", "DOUBLE", "DOUBLE"])


def city_state_from_regions(spark: SparkSession, sf_dir: str, unmapped_region: str = "MIDDLE EAST") -> DataFrame:
    """City -> state dimension from nation/region; one region left unmapped.

    Bounded by the number of nations (25), so safe to broadcast.
    """
    nat = read_table(spark, sf_dir, "nation")
    reg = read_table(spark, sf_dir, "region")
    return (nat.join(reg, nat.n_regionkey == reg.r_regionkey)
               .filter(F.col("r_name") != F.lit(unmapped_region))
               .select(F.col("n_name").alias("City"), F.col("r_name").alias("State")))


CITY_STATE_SQL = """city_state AS (
  SELECT n.n_name AS City, r.r_name AS State
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE r.r_name <> 'MIDDLE EAST')"""


def coords_from_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate dictionary with spelling variants, derived from nation.

    key % 3 == 0: the exact name; == 1: 'Name (Nk)' (matches after removing
    the bracket and lower-casing); == 2: lower-case name + '-x' (the city is a
    prefix of the key).
    """
    nat = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    city = (F.when(k % 3 == 0, F.col("n_name"))
             .when(k % 3 == 1, F.concat(F.initcap("n_name"), F.lit(" (N"), k.cast("string"), F.lit(")")))
             .otherwise(F.concat(F.lower("n_name"), F.lit("-x"))))
    return nat.select(city.alias("city"), (k * 1.5 - 10.0).alias("lat"),
                      (k * 0.75 + 60.0).alias("lon"), k.cast("int").alias("ordinal"))


COORDS_SQL = """coords AS (
  SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name
              WHEN n_nationkey % 3 = 1 THEN
                   upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' (N' || CAST(n_nationkey AS VARCHAR) || ')'
              ELSE lower(n_name) || '-x' END AS city,
         n_nationkey * 1.5 - 10.0 AS lat, n_nationkey * 0.75 + 60.0 AS lon,
         CAST(n_nationkey AS INTEGER) AS ordinal
  FROM nation)"""


# Frequent words of the synthetic test prose, grouped as aspects, so the
# word-boundary and substring rules both find matches in the driver's data
# ('ion' only occurs inside words).
COMMON_WORD_ASPECTS = {
    "articles": ["the", "a", "an"],
    "linking": ["and", "or", "with"],
    "fragment": ["ion", "tion"],
    "romance": ["de", "la", "le", "en"],
    "german": ["der", "die", "und"],
}
