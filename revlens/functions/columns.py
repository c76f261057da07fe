"""Scalar column expressions (cleaning, predicates, bands).

All of these are Catalyst expressions: they stay inside whole-stage codegen
and push down where the scan supports it. No Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import constants as K

__all__ = [
    "as_col", "is_valid_number", "nan_to_null", "clamp", "coerce_number", "is_blank",
    "choose_review_text", "normalise_text", "polarity_label", "ci_equals", "at_least",
    "contains_literal", "log1p_nonneg", "expm1_long", "five_star_proxy", "rating_bucket",
    "scaled_band", "rating_band", "trend_band", "truncate_text",
]

# Characters Python's str.strip() treats as white space, written so both
# Java regex and RE2 read the class the same way.
BLANK_CLASS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_number(c) -> Column:
    """O-11: not NULL and not NaN (pandas has one 'missing', Spark two)."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c)


def nan_to_null(c) -> Column:
    """O-10: non-finite doubles become NULL."""
    c = as_col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def clamp(c, lo: float = K.RATING_MIN, hi: float = K.RATING_MAX) -> Column:
    """O-12: clip to [lo, hi]. Apply after the NULL filter: least(5, NULL) is 5."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), as_col(c).cast("double")))


def coerce_number(c, default: float | None = None, lower: float | None = None) -> Column:
    """O-15/O-16: parse to double, errors -> NULL, then default and floor."""
    out = as_col(c).try_cast("double")
    out = F.when(F.isnan(out), F.lit(None)).otherwise(out)
    if default is not None:
        out = F.coalesce(out, F.lit(float(default)))
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    return out


NON_BLANK_CLASS = r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def is_blank(c) -> Column:
    """NULL or only white space (stops at the first non-blank character)."""
    c = as_col(c)
    return F.coalesce(~c.rlike(NON_BLANK_CLASS), F.lit(True))


def choose_review_text(review="Review", raw="Raw_Review") -> Column:
    """O-17: Review if non-blank, else Raw_Review if non-blank, else ''.

    Blankness is tested before cleaning, so '!!!' does not fall back.
    """
    review, raw = as_col(review), as_col(raw)
    return (F.when(~is_blank(review), review)
            .when(~is_blank(raw), raw)
            .otherwise(F.lit("")))


def normalise_text(c) -> Column:
    """O-18: lower, non [a-z] runs -> one space, trim; NULL -> ''.

    Replacing every non-letter by a space and collapsing white space is the
    same as replacing each run of non-letters by one space.
    """
    return F.coalesce(F.trim(F.regexp_replace(F.lower(as_col(c)), "[^a-z]+", " ")), F.lit(""))


def polarity_label(c, pos: float = K.POLARITY_POSITIVE, neg: float = K.POLARITY_NEGATIVE) -> Column:
    """O-19: both bounds strict; NULL -> Neutral (NaN compares false in pandas)."""
    c = as_col(c)
    return (F.when(c > F.lit(pos), F.lit("Positive"))
            .when(c < F.lit(neg), F.lit("Negative"))
            .otherwise(F.lit("Neutral")))


def ci_equals(c, value: str) -> Column:
    """O-20: case-insensitive equality."""
    return F.lower(as_col(c)) == F.lit(value.lower())


def at_least(c, value) -> Column:
    """O-21: minimum predicate; an unparsable bound is ignored."""
    try:
        bound = float(value)
    except (TypeError, ValueError):
        return F.lit(True)
    return as_col(c) >= F.lit(bound)


def contains_literal(c, keyword: str) -> Column:
    """O-22: literal (non-regex) case-insensitive substring; NULL -> false."""
    return F.coalesce(F.contains(F.lower(as_col(c)), F.lit(keyword.lower())), F.lit(False))


def log1p_nonneg(c) -> Column:
    """O-27: log1p(max(0, x))."""
    return F.log1p(F.greatest(as_col(c).cast("double"), F.lit(0.0)))


def expm1_long(c) -> Column:
    """O-27: expm1 then truncation to an integer."""
    return F.expm1(as_col(c)).cast("long")


def five_star_proxy(avg) -> Column:
    """O-28: round(clip((avg - 1) / 4, 0, 1), 4)."""
    return F.round(clamp((as_col(avg) - F.lit(1.0)) / F.lit(4.0), 0.0, 1.0), 4)


def rating_bucket(c) -> Column:
    """O-29: integer bucket by truncation."""
    return as_col(c).cast("int")


def scaled_band(c) -> Column:
    """O-30: scaled metric band <0.33 low, <0.66 mid, else high."""
    c = as_col(c)
    lo, hi = K.SCALED_BANDS
    return F.when(c < lo, F.lit("low")).when(c < hi, F.lit("mid")).otherwise(F.lit("high"))


def rating_band(c) -> Column:
    """O-30: rating band >=4 high, >=3 mid, else low."""
    c = as_col(c)
    mid, high = K.RATING_BANDS
    return F.when(c >= high, F.lit("high")).when(c >= mid, F.lit("mid")).otherwise(F.lit("low"))


def trend_band(c) -> Column:
    """O-30: trend band >0.66 High, >0.33 Medium, else Low."""
    c = as_col(c)
    lo, hi = K.TREND_BANDS
    return F.when(c > hi, F.lit("High")).when(c > lo, F.lit("Medium")).otherwise(F.lit("Low"))


def truncate_text(c, n: int = K.TEXT_PREVIEW_CHARS) -> Column:
    """O-26: first n characters."""
    return F.substring(as_col(c), 1, n)
