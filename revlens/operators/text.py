"""Text operators: review text choice, aspects, lexicon sentiment (O-17..O-19, O-47, O-48, O-78).

Aspect dictionaries are small fixed mappings: one pattern, branched by letters,
names all their keywords that a text holds in one pass over it, and each
aspect is a flag over those names — a narrow projection per review, then a
partial+final aggregate over the matches.

Sentiment is a Spark job, not a per-row library call: tokens are exploded
inside each task and joined to a lexicon table once, with their positions. Only
tokens that the lexicon knows go on; modifiers (intensifiers, negators) act on
a token through its two predecessors, found by position in the review's list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import as_col, choose_review_text, is_blank, normalise_text, polarity_label

__all__ = [
    "review_text", "aspect_flags", "flag_columns", "found_keywords", "keyword_pattern", "implied_keywords", "aspect_hits", "aspect_mentions", "aspect_summary", "lexicon_sentiment",
    "word_boundary_pattern", "top_aspect", "search_summary",
]

WORD_CHAR = r"\p{L}\p{N}_"
SPECIAL = r"^-&[]\ "


def review_text(df: DataFrame, review: str = "Review", raw: str = "Raw_Review", drop_blank: bool = False,
                name: str = "review_text") -> DataFrame:
    """O-17: choose the review text; optionally drop rows blank in both."""
    out = df.withColumn(name, choose_review_text(review, raw))
    if drop_blank:
        out = out.filter(~is_blank(name))
    return out


def _quoted(text: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def word_boundary_pattern(keywords: list[str]) -> str:
    """Keywords as one alternation between word boundaries (Unicode word chars).

    Written without ``\\b`` so Java regex and RE2 agree on what a word is.
    """
    return f"(^|[^{WORD_CHAR}])({'|'.join(map(_quoted, keywords))})([^{WORD_CHAR}]|$)"


def _ahead(words: list[str]) -> str:
    """A look at the next letters, at most three, that some of the words may go on with."""
    sets = [sorted({w[i] for w in words}) for i in range(min(3, *map(len, words)))]
    return "(?=" + "".join(f"[{''.join(chr(92) + c if c in SPECIAL else c for c in part)}]" for part in sets) + ")"


def _branches(words: list[str]) -> str:
    """The words as nested alternatives by their first letters, longest first.

    Letters are halved, and each half begins with a look at the next three
    letters, so most places in a text are passed over after one look.
    """
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w)

    def one(c: str) -> str:
        rest = [w[1:] for w in by_first[c] if w != c]
        return _quoted(c) + (_branches(rest) + ("?" if c in by_first[c] else "") if rest else "")

    def pick(letters: list[str]) -> str:
        if len(letters) <= 3:
            return "|".join(one(c) for c in letters)
        half = len(letters) // 2
        return "|".join(f"{_ahead([w for c in part for w in by_first[c]])}(?:{pick(part)})" for part in (letters[:half], letters[half:]))
    letters = sorted(by_first)
    return f"(?:{_ahead(words) if len(letters) > 3 else ''}(?:{pick(letters)}))"


def keyword_pattern(keywords: list[str], mode: str) -> str:
    """One pattern whose group 1 is the longest keyword that starts at a position.

    It matches ahead without moving, so keywords that overlap are all seen;
    of those that start together the longest is named, and
    :func:`implied_keywords` tells the others.
    """
    tree = _branches(sorted(set(keywords)))
    if mode == "substring":
        return f"(?=({tree}))"
    return f"(?<![{WORD_CHAR}])(?=({tree})(?![{WORD_CHAR}]))"


def implied_keywords(keywords: list[str], found: str, mode: str) -> list[str]:
    """The keywords that a text has at the place where ``found`` is the longest."""
    ends = lambda k: mode == "substring" or len(k) == len(found) or re.match(r"\W", found[len(k)])
    return [k for k in keywords if found.startswith(k) and ends(k)]


def aspect_flags(found: Column, aspects: dict[str, list[str]], mode: str = "substring") -> list[Column]:
    """One boolean per aspect from the keywords found in a text (:func:`found_keywords`)."""
    every = sorted({k.lower() for kws in aspects.values() for k in kws})
    implied = {f: set(implied_keywords(every, f, mode)) for f in every}
    flags = []
    for aspect, kws in aspects.items():
        telling = [f for f in every if implied[f] & {k.lower() for k in kws}]
        flags.append(F.arrays_overlap(found, F.array(*map(F.lit, telling))).alias(aspect))
    return flags


def found_keywords(text: Column, aspects: dict[str, list[str]], mode: str) -> Column:
    """The keywords of all aspects that a text holds, each once; the text is read in one pass."""
    every = [k.lower() for kws in aspects.values() for k in kws]
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(keyword_pattern(every, mode)), F.lit(1)))


def flag_columns(aspects: dict[str, list[str]], found: str, mode: str) -> dict[str, Column]:
    """``_a0``, ``_a1``, ...: whether the found keywords mention each aspect, in dictionary order."""
    return {f"_a{i}": f for i, f in enumerate(aspect_flags(F.col(found), aspects, mode))}


def aspect_hits(df: DataFrame, aspects: dict[str, list[str]], text: str, mode: str,
                carry: list[str]) -> DataFrame:
    """``carry`` plus a flag per aspect: narrow enough to be joined or shuffled in place of the text."""
    found = df.select(*carry, F.col("_found") if "_found" in df.columns else found_keywords(F.col(text), aspects, mode).alias("_found"))
    return found.select(*carry, *[f.alias(c) for c, f in flag_columns(aspects, "_found", mode).items()])


def _mentioned(found: DataFrame, aspects: dict[str, list[str]], rating: str) -> DataFrame:
    """(rating, aspect) for each flag that is set."""
    named = F.array(*[F.when(F.col(f"_a{i}"), F.lit(a)) for i, a in enumerate(aspects)])
    return found.select(rating, F.explode(F.filter(named, lambda x: x.isNotNull())).alias("aspect"))


def aspect_mentions(df: DataFrame, aspects: dict[str, list[str]], text: str = "Review",
                    rating: str = "Rating") -> DataFrame:
    """O-47: mentions per aspect (substring, once per review) and mean rating of
    the matches ignoring NULL/NaN (2 dp); every aspect listed, ``ordinal`` is the
    dictionary order. A frame that has the flags (see :func:`aspect_hits`) or the
    keywords (``_found``, see :func:`found_keywords`) needs no text."""
    found = df if "_a0" in df.columns else aspect_hits(df, aspects, text, "substring", [rating])
    r = F.when(~F.isnan(F.col(rating)), F.col(rating))
    g = (_mentioned(found, aspects, rating).groupBy("aspect")
         .agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg(r), 2).alias("avg_rating")))
    spine = df.sparkSession.createDataFrame([(a, i) for i, a in enumerate(aspects)], "aspect string, ordinal int")
    return (spine.join(g, "aspect", "left")
            .select("aspect", "ordinal", F.coalesce(F.col("mentions"), F.lit(0)).cast("bigint").alias("mentions"),
                    "avg_rating"))


def top_aspect(mentions: DataFrame) -> DataFrame:
    """O-49: aspect with most mentions; ties -> first in dictionary order."""
    return mentions.agg(F.min_by("aspect", F.struct(-F.col("mentions"), F.col("ordinal"))).alias("top_aspect"))


def aspect_summary(df: DataFrame, aspects: dict[str, list[str]], text: str = "review_text",
                   rating: str = "Rating", decimals: int = 6) -> DataFrame:
    """O-48: word-boundary matches: mentions, mean rating, share >= 4, share <= 2,
    signal = (mean - 3) / 2; aspects without hits are absent. ``position`` is the
    order: signal, then mentions, descending (ties by name); it numbers one row
    per aspect, a table bounded by the dictionary. A frame that has the flags
    needs no text."""
    found = df if "_a0" in df.columns else aspect_hits(df, aspects, text, "regex", [rating])
    m = _mentioned(found, aspects, rating)
    r = F.col(rating)
    g = m.groupBy("aspect").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.avg(r).alias("_avg"),
        F.avg(F.when(r >= 4, 1.0).otherwise(0.0)).alias("_pos"),
        F.avg(F.when(r <= 2, 1.0).otherwise(0.0)).alias("_neg"))
    order = Window.orderBy(F.desc("signal"), F.desc("mentions"), "aspect")
    return g.select(
        "aspect", "mentions", F.round("_avg", decimals).alias("avg_rating"),
        F.round("_pos", decimals).alias("positive_share"), F.round("_neg", decimals).alias("negative_share"),
        F.round((F.col("_avg") - F.lit(3.0)) / F.lit(2.0), decimals).alias("signal")
        ).withColumn("position", F.row_number().over(order).cast("long"))


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, key: str, text: Column,
                      carry: list[str] | None = None, decimals: int = 4) -> DataFrame:
    """O-78: polarity in [-1, 1] and subjectivity in [0, 1] per review.

    text -> O-18 normalisation -> tokens; each token with a polarity is
    scored. A modifier right before it multiplies its polarity (intensifier
    > 0, negator < 0), and so does a second modifier before the first ("not
    very good"); positive modifiers also multiply the subjectivity. Scores
    are clipped, then averaged per review; a review without a scored token
    (null or empty text included) gets 0 / 0.

    ``lexicon``: word, polarity, subjectivity, intensity. A word listed more
    than once counts with its mean scores and largest intensity. Catalyst
    broadcasts it below ``autoBroadcastJoinThreshold``. The reviews are read
    once and only their key and ``carry`` columns leave the task.
    """
    carry = carry or []
    words = lexicon.groupBy("word").agg(F.avg("polarity").alias("_pol"), F.avg("subjectivity").alias("_sub"),
                                        F.max("intensity").alias("_int"))
    t = df.select(key, *carry, F.posexplode(F.split(normalise_text(text), " ")).alias("_at", "_w"))
    t = t.join(words.select(F.col("word").alias("_w"), F.struct("_pol", "_sub", "_int").alias("_hit")), "_w", "left")
    # a review's first token stays without a hit, so that each review has a row
    t = t.filter(F.col("_hit").isNotNull() | (F.col("_at") == 0))
    hit = F.when(F.col("_hit").isNotNull(), F.struct(F.col("_at").alias("at"), *[F.col(f"_hit._{c}").alias(c) for c in ("pol", "sub", "int")]))
    # carry depends on the key; grouping by it keeps it beside
    g = t.groupBy(key, *carry).agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    bounded = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))

    def factor(x: Column, i: Column, back: int) -> Column:
        """The intensity of the token ``back`` places before x, null if it has none: at most that many hits before it."""
        hits = [F.get(F.col("_hits"), i - j) for j in range(1, back + 1)]
        return F.coalesce(*[F.when((i >= j) & (h["at"] == x["at"] - back), h["int"]) for j, h in enumerate(hits, 1)])

    def scored(x: Column, i: Column) -> Column:
        one, two = factor(x, i, 1), factor(x, i, 2)
        chain = F.when(one.isNull(), F.lit(1.0)).otherwise(one * F.coalesce(two, F.lit(1.0)))
        return F.when(x["pol"].isNotNull(), F.struct(
            bounded(x["pol"] * chain, -1.0).alias("p"),
            F.when(x["sub"].isNotNull(), bounded(x["sub"] * F.when(chain > 0, chain).otherwise(F.lit(1.0)), 0.0)).alias("s")))
    g = g.select(key, *carry, F.transform("_hits", scored).alias("_scored"))

    def mean(name: str) -> Column:
        values = F.filter(F.transform("_scored", lambda x: x[name]), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    g = g.select(key, *carry, mean("p").alias("_p"), mean("s").alias("_s"))
    return g.select(key, *carry,
                    F.coalesce(F.round("_p", decimals), F.lit(0.0)).alias("polarity"),
                    F.coalesce(F.round("_s", decimals), F.lit(0.0)).alias("subjectivity")
                    ).withColumn("sentiment", polarity_label("polarity"))


def search_summary(df: DataFrame, aspects: dict[str, list[str]], text: str = "Review",
                   rating: str = "Rating") -> DataFrame:
    """O-50 + O-49 in one pass: count, mean rating (2 dp), mean polarity (4 dp)
    and the most mentioned aspect (ties -> first in dictionary order).

    The hits are counted in the same aggregate as the summary, so the
    filtered reviews are read once; a frame that has the flags needs no text.
    """
    found = df if "_a0" in df.columns else aspect_hits(df, aspects, text, "substring", [rating, "polarity"])
    r = F.col(rating)
    g = found.agg(F.count(F.lit(1)).alias("count"),
                  F.round(F.avg(F.when(~F.isnan(r), r)), 2).alias("avg_rating"),
                  F.round(F.avg(F.col("polarity").cast("decimal(30,4)")), 4).cast("double").alias("avg_polarity"),
                  *[F.count_if(F.col(f"_a{i}")).alias(f"_m{i}") for i in range(len(aspects))])
    best = F.array_max(F.array(*[F.struct(F.col(f"_m{i}").alias("n"), F.lit(-i).alias("o"), F.lit(a).alias("a"))
                                 for i, a in enumerate(aspects)]))
    return g.select("count", "avg_rating", "avg_polarity", best["a"].alias("top_aspect"))
