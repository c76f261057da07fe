"""Score operators (O-70..O-77e).

Min-max bounds are one scalar subquery per table (a struct of all bounds),
evaluated once and inlined as a literal: no one-row cross join, no window
over the whole table. Everything else is column arithmetic inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import constants as K
from revlens.functions.columns import as_col, log1p_nonneg, scaled_band, trend_band
from revlens.operators.neighbours import nearest_rows

__all__ = [
    "HOTSPOT_WEIGHTS", "minmax_columns", "hotspot_score", "reweighted_score", "place_insights",
    "hidden_gems", "risk_places", "similar_places", "similar_to_each", "similar_places_dashboard", "daily_interest",
    "trend_scores", "realtime_scores",
    "score_breakdown", "comparison_frame", "map_points",
]

HOTSPOT_WEIGHTS = K.HOTSPOT_WEIGHTS


def minmax_columns(df: DataFrame, exprs: dict[str, Column], zero_range: float = 0.0,
                   fill_null: float | None = None, where: Column | None = None) -> DataFrame:
    """O-70: add ``name = (x - min) / (max - min)`` for each expression.

    ``zero_range`` is the value when max == min (0 or 0.5 in the reviewed
    code); ``fill_null`` replaces NULL inputs first; ``where`` restricts the
    rows that define the bounds (rows outside still get a value).
    """
    vals = {n: (F.coalesce(e, F.lit(float(fill_null))) if fill_null is not None else e) for n, e in exprs.items()}
    src = df.filter(where) if where is not None else df
    bound_fields = []
    for n, e in vals.items():
        bound_fields += [F.min(e).alias(f"{n}_mn"), F.max(e).alias(f"{n}_mx")]
    # bind the subquery once as a column: every field reference then reads the
    # column instead of copying the subquery plan into the expression tree
    bcol = f"_mm_{'_'.join(vals)}"
    out_df = df.withColumn(bcol, src.select(F.struct(*bound_fields).alias("b")).scalar())
    out = {}
    for n, e in vals.items():
        mn, mx = F.col(f"{bcol}.{n}_mn"), F.col(f"{bcol}.{n}_mx")
        out[n] = F.when(mx == mn, F.lit(float(zero_range))).otherwise((e - mn) / (mx - mn))
    return out_df.withColumns(out).drop(bcol)


def hotspot_score(df: DataFrame, weights: tuple[float, float, float] = HOTSPOT_WEIGHTS,
                  decimals: int = 6) -> DataFrame:
    """O-71/O-72: rating, log-volume and shifted-sentiment scores, weighted.

    Input: avg_rating, review_count, avg_polarity (NULL polarity -> 0).
    """
    wr, wv, ws = weights
    base = df.withColumn("avg_polarity", F.coalesce(F.col("avg_polarity"), F.lit(0.0)))
    s = minmax_columns(base, {
        "rating_score": F.col("avg_rating"),
        "volume_score": F.log1p(F.col("review_count").cast("double")),
        "sentiment_score": (F.col("avg_polarity") + F.lit(1.0)) / F.lit(2.0),
    })
    hs = (F.lit(wr) * F.col("rating_score") + F.lit(wv) * F.col("volume_score")
          + F.lit(ws) * F.col("sentiment_score"))
    return s.withColumns({
        "hotspot_score": F.round(hs, decimals),
        "rating_score": F.round("rating_score", decimals),
        "volume_score": F.round("volume_score", decimals),
        "sentiment_score": F.round("sentiment_score", decimals),
    })


def reweighted_score(df: DataFrame, rating_w: float, volume_w: float, sentiment_w: float,
                     decimals: int = 6, zero_total: str = "default") -> DataFrame:
    """O-73: weights divided by their sum; NULL components -> 0.

    ``zero_total='default'`` falls back to (.5, .3, .2) when the sum is <= 0
    (dashboard); ``'zero'`` divides by 1 when the sum is 0 (browser).
    """
    total = rating_w + volume_w + sentiment_w
    if total <= 0 and zero_total == "default":
        (rating_w, volume_w, sentiment_w), total = HOTSPOT_WEIGHTS, 1.0
    elif total == 0:
        total = 1.0
    comp = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sc = (F.lit(rating_w / total) * comp("rating_score") + F.lit(volume_w / total) * comp("volume_score")
          + F.lit(sentiment_w / total) * comp("sentiment_score"))
    return df.withColumn("custom_hotspot_score", F.round(sc, decimals))


def place_insights(df: DataFrame, decimals: int = 6) -> DataFrame:
    """O-74/O-75: hidden-gem, risk and confidence scores of hotspot places.

    Uses the stored component scores (NULL -> 0) and a min-max of the rating
    standard deviation (NULL -> 0, zero range -> 0).
    """
    sig = df.withColumns({
        "_r": F.coalesce(F.col("rating_score"), F.lit(0.0)),
        "_v": F.coalesce(F.col("volume_score"), F.lit(0.0)),
        "_s": F.coalesce(F.col("sentiment_score"), F.lit(0.0)),
    })
    sig = minmax_columns(sig, {"_std": F.col("rating_std").cast("double")}, fill_null=0.0)
    g1, g2, g3, g4 = K.HIDDEN_GEM_WEIGHTS
    r1, r2, r3, r4 = K.RISK_WEIGHTS
    gem = (F.lit(g1) * F.col("_r") + F.lit(g2) * F.col("_s")
           + F.lit(g3) * (F.lit(1.0) - F.col("_std")) + F.lit(g4) * (F.lit(1.0) - F.col("_v")))
    risk = (F.lit(r1) * F.col("_v") + F.lit(r2) * (F.lit(1.0) - F.col("_r"))
            + F.lit(r3) * (F.lit(1.0) - F.col("_s")) + F.lit(r4) * F.col("_std"))
    return sig.withColumns({
        "hidden_gem_score": F.round(gem, decimals),
        "risk_score": F.round(risk, decimals),
        "confidence_score": F.round(F.col("_v"), decimals),
    }).drop("_r", "_v", "_s", "_std")


def hidden_gems(insights: DataFrame, lo: int = K.HIDDEN_GEM_REVIEWS[0], hi: int = K.HIDDEN_GEM_REVIEWS[1],
                n: int = K.INSIGHT_LIST_SIZE, key: str = "Place") -> DataFrame:
    """O-74 list: review count in [lo, hi], top n by hidden-gem score."""
    return (insights.filter(F.col("review_count").between(lo, hi))
            .orderBy(F.desc("hidden_gem_score"), key).limit(n))


def risk_places(insights: DataFrame, min_reviews: int = K.RISK_MIN_REVIEWS, n: int = K.INSIGHT_LIST_SIZE,
                key: str = "Place") -> DataFrame:
    """O-75 list: review count >= min_reviews, top n by risk score."""
    return (insights.filter(F.col("review_count") >= min_reviews)
            .orderBy(F.desc("risk_score"), key).limit(n))


SIMILARITY_FEATURES = ["avg_rating", "review_count", "avg_polarity", "hotspot_score", "rating_std"]


def similar_places(hotspot_places: DataFrame, seed: str, top_n: int = K.SIMILAR_DEFAULT, key: str = "Place",
                   order: str = "rank") -> DataFrame:
    """O-76 (web variant): five min-max features, Euclidean distance to a seed.

    Rows with a NULL feature are dropped; the seed is an exact
    case-insensitive name match, else the first containing match (first in
    ``order``). The seed vector is a one-row scalar subquery, so the scan
    over all places is a plain projection followed by a distributed top-k.
    The order is that of the exact similarity; it is rounded at the end.
    """
    df = hotspot_places.dropna(subset=SIMILARITY_FEATURES)
    feats = {f"_f{i}": (log1p_nonneg(c) if c == "review_count" else F.col(c).cast("double"))
             for i, c in enumerate(SIMILARITY_FEATURES)}
    df = minmax_columns(df, feats, zero_range=0.0)
    low = F.lower(F.col(key))
    s = seed.lower()
    prio = F.when(low == F.lit(s), 0).when(F.contains(low, F.lit(s)), 1)
    seed_row = (df.withColumn("_p", prio).filter(F.col("_p").isNotNull())
                  .orderBy("_p", order, key).limit(1))
    sv = seed_row.select(F.struct(F.col(key).alias("k"), *[F.col(f) for f in feats]).alias("s")).scalar()
    df = df.withColumn("_seed", sv)
    dist = F.sqrt(sum((F.col(f) - F.col(f"_seed.{f}")) * (F.col(f) - F.col(f"_seed.{f}")) for f in feats))
    out = (df.withColumn("similarity", F.lit(1.0) / (F.lit(1.0) + dist))
             .filter(F.col("similarity").isNotNull() & (F.col(key) != F.col("_seed.k"))))
    cols = [key, F.round("similarity", 4).alias("similarity"), "avg_rating", "review_count", "avg_polarity", "hotspot_score"]
    return out.orderBy(F.desc("similarity"), order, key).limit(int(top_n)).select(*cols)


def similar_to_each(hotspot_places: DataFrame, top_n: int = K.SIMILAR_DEFAULT, key: str = "Place", order: str = "rank") -> DataFrame:
    """O-76 for every place at once: the web variant's features and similarity, exact.

    One search through cells with distance bounds instead of a scan for each
    seed. Similarities equal to nine decimals go by ``order`` and the key.
    """
    df = hotspot_places.dropna(subset=SIMILARITY_FEATURES)
    feats = {f"_f{i}": (log1p_nonneg(c) if c == "review_count" else F.col(c).cast("double")) for i, c in enumerate(SIMILARITY_FEATURES)}
    near = nearest_rows(minmax_columns(df, feats, zero_range=0.0), key, list(feats), int(top_n), [order])
    return near.select(key, F.col("position").cast("long").alias("position"), F.col("neighbour").alias("similar_place"), F.round("similarity", 4).alias("similarity"))


def similar_places_dashboard(places: DataFrame, seed: str, top_n: int = 10, key: str = "Place",
                             decimals: int = 4) -> DataFrame:
    """O-76 (dashboard variant): rating, log volume, shifted sentiment,
    consistency (1 - std) and hotspot, each min-max with NULL -> 0 and zero
    range -> 0; the seed is an exact name; every row with the seed's name is
    excluded. No seed row -> empty result.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = minmax_columns(places, {
        "_f0": num("avg_rating"),
        "_f1": F.log1p(F.greatest(num("review_count"), F.lit(0.0))),
        "_f2": (num("avg_polarity") + F.lit(1.0)) / F.lit(2.0),
        "_f3": num("rating_std"),
        "_f4": num("hotspot_score"),
    }, zero_range=0.0, fill_null=0.0)
    df = df.withColumn("_f3", F.lit(1.0) - F.col("_f3"))
    feats = [f"_f{i}" for i in range(5)]
    seed_row = df.filter(F.col(key) == F.lit(seed)).orderBy("rank", key).limit(1)
    sv = seed_row.select(F.struct(*[F.col(f) for f in feats]).alias("s")).scalar()
    df = df.withColumn("_seed", sv)
    dist = F.sqrt(sum((F.col(f) - F.col(f"_seed.{f}")) * (F.col(f) - F.col(f"_seed.{f}")) for f in feats))
    out = (df.withColumn("similarity", F.round(F.lit(1.0) / (F.lit(1.0) + dist), decimals))
             .filter(F.col("similarity").isNotNull() & (F.col(key) != F.lit(seed))))
    cols = [key, "similarity", "avg_rating", "review_count", "avg_polarity", "hotspot_score"]
    return out.orderBy(F.desc("similarity"), "rank", key).limit(top_n).select(*cols)


def daily_interest(interest: DataFrame) -> DataFrame:
    """(keyword, day): rows, sum and count of interest; all trend figures follow from it."""
    return interest.groupBy("keyword", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("interest").alias("total"), F.count("interest").alias("n"))


def trend_scores(interest: DataFrame, status: DataFrame, keywords: DataFrame, months: int = K.TREND_MONTHS,
                 decimals: int = 6, live_source: str = "Google Trends") -> DataFrame:
    """O-77a: mean interest per keyword over the last ``months`` before the latest
    day, min-max among live keywords only (zero range -> 0.5), others 0.

    ``interest`` is keyword, ts, interest, or the stored :func:`daily_interest`
    (read twice, for the latest day and the means). ``keywords`` (column
    Place) is the requested list; a keyword without a status is 'fallback', a
    live one without data 'unavailable'. ``live_source`` names the source of
    live rows.
    """
    daily = interest if "day" in interest.columns else daily_interest(interest)
    latest = daily.select(F.max("day")).scalar()
    mean = (daily.filter(F.col("day") >= F.add_months(latest, -months)).groupBy("keyword")
            .agg(F.try_divide(F.sum("total"), F.sum("n")).alias("_raw")))
    j = (keywords.join(status, keywords.Place == status.keyword, "left").drop("keyword")
         .join(mean, keywords.Place == mean.keyword, "left").drop("keyword"))
    st = (F.when(F.col("status").isNull(), F.lit("fallback"))
          .when((F.col("status") == "live") & F.col("_raw").isNull(), F.lit("unavailable")).otherwise(F.col("status")))
    j = j.withColumn("status", st).withColumn(
        "RawTrendScore", F.when(F.col("status") == "live", F.col("_raw")).otherwise(F.lit(0.0)))
    live = F.col("status") == "live"
    j = minmax_columns(j, {"_ts": F.col("RawTrendScore")}, zero_range=K.LIVE_ZERO_RANGE, where=live)
    return j.select(
        "Place",
        F.round("RawTrendScore", decimals).alias("RawTrendScore"),
        F.when(live, F.round("_ts", decimals)).otherwise(F.lit(0.0)).alias("TrendScore"),
        "status",
        F.when(live, F.lit(live_source)).otherwise(F.lit("fallback")).alias("source"),
        F.coalesce(F.col("notes"), F.lit("No data fetched")).alias("notes"))


def cached_trends(stored: DataFrame | None, source: str = "cached") -> DataFrame | None:
    """O-06: stored trends for reuse: all rows become 'cached' if any of them is live; None if none is, or nothing is stored."""
    if stored is None or stored.filter(F.col("status") == "live").limit(1).isEmpty():
        return None
    return stored.withColumns({"status": F.lit("cached"), "source": F.lit(source)})


def realtime_scores(base: DataFrame, trends: DataFrame, w_existing: float = K.TREND_WEIGHTS[0],
                    w_trend: float = K.TREND_WEIGHTS[1],
                    existing: str = "BasePopularity", decimals: int = 6) -> DataFrame:
    """O-77b + O-63d: base places left-joined to trend scores with per-column defaults.

    FinalRealtimeScore = w_existing * existing + w_trend * TrendScore; the
    default weights (0, 1) reproduce the computed definition.
    """
    t = trends.select("Place", "TrendScore", "status", "source", "notes")
    j = base.join(t, "Place", "left").withColumns({
        "TrendScore": F.coalesce(F.col("TrendScore"), F.lit(0.0)),
        "status": F.coalesce(F.col("status"), F.lit("unavailable")),
        "source": F.coalesce(F.col("source"), F.lit("fallback")),
        "notes": F.coalesce(F.col("notes"), F.lit("No trend data available")),
    })
    fin = F.lit(w_existing) * F.col(existing).cast("double") + F.lit(w_trend) * F.col("TrendScore")
    return j.withColumn("FinalRealtimeScore", F.round(fin, decimals)).withColumn(
        "trend_band", trend_band("FinalRealtimeScore"))


def score_breakdown(hotspots: DataFrame, key: str, n: int = 20,
                    weights: tuple[float, float, float] = HOTSPOT_WEIGHTS, decimals: int = 6) -> DataFrame:
    """O-77c: weight x component of the n leaders, long form (key, component, value)."""
    wr, wv, ws = weights
    top = hotspots.orderBy(F.desc("hotspot_score"), key).limit(n)
    wide = top.select(key,
                      F.round(F.lit(wr) * F.col("rating_score"), decimals).alias("rating"),
                      F.round(F.lit(wv) * F.col("volume_score"), decimals).alias("volume"),
                      F.round(F.lit(ws) * F.col("sentiment_score"), decimals).alias("sentiment"))
    return wide.unpivot([key], ["rating", "volume", "sentiment"], "component", "contribution")


def comparison_frame(catalog: DataFrame, key: str, chosen: Column,
                     metrics: tuple[str, ...] = ("avg_rating", "review_count", "avg_polarity", "hotspot_score"),
                     log_volume: bool = True, decimals: int = 6, zero_range: float = 0.0) -> DataFrame:
    """O-77d: chosen destinations, metrics min-max within the chosen set, long form.

    ``log_volume=False, zero_range=0.5`` is the browser's variant: raw counts,
    and 0.5 where all values are equal.
    """
    sel = catalog.filter(chosen)
    exprs = {m: (log1p_nonneg(m) if (m == "review_count" and log_volume) else F.col(m).cast("double"))
             for m in metrics}
    sel = minmax_columns(sel.select(key, *metrics), {f"n_{m}": e for m, e in exprs.items()},
                         zero_range=zero_range, fill_null=0.0)
    wide = sel.select(F.col(key).alias("Destination"),
                      *[F.round(F.col(f"n_{m}"), decimals).alias(m) for m in metrics])
    return wide.unpivot(["Destination"], list(metrics), "Metric", "Value")


def map_points(cities: DataFrame, coords: DataFrame, metric: str = "hotspot_score",
               score_min: float = 0.0, top_n: int | None = None, decimals: int = 6) -> DataFrame:
    """O-77e: mapped cities with heat weight, marker radius and metric band.

    ``coords`` is the output of the fuzzy look-up (City, lat, lon); the
    volume scale and metric scale are min-max over the mapped selection.
    """
    sel = cities.filter(F.col("hotspot_score") >= score_min)
    if top_n is not None:
        sel = sel.orderBy(F.desc("hotspot_score"), "City").limit(top_n)
    geo = sel.join(coords, "City", "inner")
    geo = minmax_columns(geo, {
        "volume_scale": log1p_nonneg(F.coalesce(F.col("review_count").cast("double"), F.lit(0.0))),
        "metric_scaled": F.col(metric).cast("double")}, zero_range=0.0, fill_null=0.0)
    return geo.select(
        "City", "lat", "lon", "hotspot_score", "review_count",
        F.round(F.greatest(F.coalesce(F.col("hotspot_score"), F.lit(0.0)), F.lit(K.MAP_MIN_WEIGHT)),
                decimals).alias("weight"),
        F.round(F.lit(K.MAP_RADIUS[0]) + F.lit(K.MAP_RADIUS[1]) * F.col("volume_scale"), decimals).alias("radius"),
        F.round("metric_scaled", decimals).alias("metric_scaled"),
        scaled_band("metric_scaled").alias("band"))
