"""Independent SQL twins of the registered queries (run by DuckDB).

Written by hand from the operator definitions, not generated from the
Spark plans, so a wrong Spark plan shows up as a mismatch.

Rounding: Spark rounds a double HALF_UP on its shortest decimal form
(0.53375 -> 0.5338 although the binary value is a hair below); every
``ROUND`` in the twins is rewritten to the same rule (see ``_spark_round``).
"""

from __future__ import annotations

from revlens.sources.testdata import reviews_num_sql

SQL: dict[str, str] = {}


def _spark_round(sql: str) -> str:
    """Rewrite every ``ROUND(x, d)`` so DuckDB rounds the way Spark does.

    Spark rounds a double HALF_UP on its shortest decimal text; DuckDB's
    ROUND scales in binary first, so the two differ on ties such as
    1.51225 (stored as 1.5122499999999999). Rounding the text form as a
    DECIMAL reproduces Spark's rule.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 5, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:
            arg, digits = sql[j + 6:k], "0"
        else:
            arg, digits = sql[j + 6:comma], sql[comma + 1:k].strip()
        arg = _spark_round(arg)
        out.append(sql[i:j])
        out.append(f"CAST(ROUND(CAST(CAST(CAST({arg} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)")
        i = k + 1


def _reg(name: str, sql: str) -> None:
    SQL[name] = _spark_round(sql.strip())


def _hotspot_sql(key: str) -> str:
    return f"""
WITH {reviews_num_sql()},
base AS (
  SELECT {key}, round(avg(Rating), 4) AS avg_rating, count(Rating) AS review_count,
         round(stddev_samp(Rating), 4) AS rating_std, coalesce(round(avg(polarity), 4), 0.0) AS avg_polarity
  FROM reviews GROUP BY {key}),""" + _hotspot_from_base()


def _hotspot_from_base() -> str:
    """Score CTEs (hb, s, h) over a CTE ``base`` with the four inputs."""
    return """
hb AS (
  SELECT min(avg_rating) AS r0, max(avg_rating) AS r1,
         min(ln(1 + review_count)) AS v0, max(ln(1 + review_count)) AS v1,
         min((avg_polarity + 1.0) / 2.0) AS s0, max((avg_polarity + 1.0) / 2.0) AS s1
  FROM base),
s AS (
  SELECT base.*,
         CASE WHEN r1 = r0 THEN 0.0 ELSE (avg_rating - r0) / (r1 - r0) END AS rs,
         CASE WHEN v1 = v0 THEN 0.0 ELSE (ln(1 + review_count) - v0) / (v1 - v0) END AS vs,
         CASE WHEN s1 = s0 THEN 0.0 ELSE ((avg_polarity + 1.0) / 2.0 - s0) / (s1 - s0) END AS ss
  FROM base, hb),
h AS (
  SELECT *, round(0.5 * rs + 0.3 * vs + 0.2 * ss, 6) AS hotspot_score FROM s)
"""


HOTSPOT_SELECT = """
SELECT {key}, CAST(row_number() OVER (ORDER BY hotspot_score DESC, {key}) AS BIGINT) AS rank,
       avg_rating, review_count, rating_std, avg_polarity,
       round(rs, 6) AS rating_score, round(vs, 6) AS volume_score, round(ss, 6) AS sentiment_score,
       hotspot_score
FROM h"""

_reg("hotspot_city", _hotspot_sql("City") + HOTSPOT_SELECT.format(key="City"))
_reg("hotspot_place", _hotspot_sql("Place") + HOTSPOT_SELECT.format(key="Place"))


def _num(with_name: bool = False) -> str:
    return "WITH " + reviews_num_sql(with_name)


_reg("dataset_summary", _num(True) + """
SELECT COUNT(*) AS total_reviews, COUNT(DISTINCT City) AS unique_cities,
       COUNT(DISTINCT Place) AS unique_places, COUNT(DISTINCT Name) AS unique_reviewers,
       ROUND(AVG(Rating), 4) AS avg_rating, ROUND(STDDEV_SAMP(Rating), 4) AS rating_std,
       MIN(Rating) AS min_rating, MAX(Rating) AS max_rating,
       CAST(SUM(CASE WHEN Rating = 5 THEN 1 ELSE 0 END) AS BIGINT) AS five_star_count,
       CAST(SUM(CASE WHEN Rating = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_star_count
FROM reviews""")

_reg("dataset_profile", "WITH " + reviews_num_sql(True, cleaned=False) + """
SELECT COUNT(*) AS rows, CAST(6 AS BIGINT) AS columns,
       COUNT(DISTINCT City) AS unique_City, COUNT(DISTINCT Place) AS unique_Place,
       COUNT(DISTINCT Name) AS unique_Name,
       MIN(Rating) AS Rating_min, MAX(Rating) AS Rating_max,
       ROUND(AVG(Rating), 4) AS Rating_mean, ROUND(MEDIAN(Rating), 4) AS Rating_median,
       COUNT(*) FILTER (WHERE City IS NULL) AS null_City, COUNT(*) FILTER (WHERE Place IS NULL) AS null_Place,
       COUNT(*) FILTER (WHERE Name IS NULL) AS null_Name, COUNT(*) FILTER (WHERE Rating IS NULL) AS null_Rating
FROM reviews_raw""")

_reg("rating_distribution", _num() + """,
dist AS (SELECT Rating AS rating, COUNT(*) AS count FROM reviews GROUP BY Rating)
SELECT rating, count, ROUND(count / (SELECT SUM(count) FROM dist) * 100, 2) AS pct FROM dist""")

_reg("rating_distribution_int", _num() + """,
dist AS (SELECT CAST(trunc(Rating) AS INTEGER) AS rating, COUNT(*) AS count FROM reviews GROUP BY 1)
SELECT rating, count, ROUND(count / (SELECT SUM(count) FROM dist) * 100, 2) AS pct FROM dist""")

_reg("city_weighted_rating", _num() + """,
dist AS (SELECT City, Rating AS rating, COUNT(*) AS count FROM reviews GROUP BY City, Rating)
SELECT City, ROUND(SUM(rating * count) / CAST(SUM(count) AS DOUBLE), 3) AS avg_rating FROM dist GROUP BY City""")

_reg("top_cities", _num() + """
SELECT City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating,
       COUNT(DISTINCT Place) AS unique_places
FROM reviews GROUP BY City ORDER BY review_count DESC, City LIMIT 20""")

_MODE_PLACE_CITY = """,
pc AS (SELECT Place, City, COUNT(*) AS n FROM reviews GROUP BY Place, City),
pc_ranked AS (SELECT Place, City, ROW_NUMBER() OVER (PARTITION BY Place ORDER BY n DESC, City) AS rn FROM pc),
mode_city AS (SELECT Place, City AS mode_city FROM pc_ranked WHERE rn = 1)"""

_reg("top_places", _num() + _MODE_PLACE_CITY + """
SELECT r.Place, COUNT(r.Rating) AS review_count, ROUND(AVG(r.Rating), 4) AS avg_rating, m.mode_city AS city
FROM reviews r JOIN mode_city m ON r.Place = m.Place
GROUP BY r.Place, m.mode_city ORDER BY review_count DESC, r.Place LIMIT 20""")

for _k, _name in (("City", "city_ratings"), ("Place", "place_ratings")):
    _reg(_name, _num() + f"""
SELECT {_k}, ROUND(AVG(Rating), 4) AS avg_rating, COUNT(Rating) AS review_count,
       ROUND(STDDEV_SAMP(Rating), 4) AS rating_std
FROM reviews GROUP BY {_k}""")

_reg("city_metrics_exact", _num(True) + """
SELECT City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating,
       ROUND(STDDEV_SAMP(Rating), 4) AS rating_std, ROUND(MIN(Rating), 1) AS min_rating,
       ROUND(MAX(Rating), 1) AS max_rating, COUNT(DISTINCT Place) AS unique_places,
       COUNT(DISTINCT Name) AS unique_reviewers,
       ROUND(AVG(CASE WHEN Rating = 5 THEN 1 ELSE 0 END), 4) AS five_star_rate
FROM reviews GROUP BY City""")

_PLACE_ENRICHED = """,
pm AS (SELECT Place, City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating,
              ROUND(STDDEV_SAMP(Rating), 4) AS rating_std FROM reviews GROUP BY Place, City),
cs AS (SELECT City, COUNT(Rating) AS city_review_count, ROUND(AVG(Rating), 4) AS city_avg_rating,
              COUNT(DISTINCT Place) AS city_place_count FROM reviews GROUP BY City),
pe AS (SELECT pm.*, cs.city_review_count, cs.city_avg_rating, cs.city_place_count
       FROM pm LEFT JOIN cs ON pm.City = cs.City)"""

_reg("place_metrics_enriched", _num() + _PLACE_ENRICHED + "\nSELECT * FROM pe")

_CITY_RANKS = """,
cm AS (SELECT City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating,
              ROUND(AVG(CASE WHEN Rating = 5 THEN 1 ELSE 0 END), 4) AS five_star_rate
       FROM reviews GROUP BY City),
cr AS (SELECT City, review_count, avg_rating, five_star_rate,
              CAST(RANK() OVER (ORDER BY review_count DESC) AS BIGINT) AS rank,
              CAST(DENSE_RANK() OVER (ORDER BY review_count DESC) AS BIGINT) AS dense_rank,
              CAST(ROW_NUMBER() OVER (ORDER BY review_count DESC, City) AS BIGINT) AS row_num,
              ROUND(PERCENT_RANK() OVER (ORDER BY review_count DESC), 4) AS pct_rank,
              ROUND(review_count / (SELECT SUM(review_count) FROM cm) * 100, 2) AS review_pct
       FROM cm)"""

_reg("city_ranks", _num() + _CITY_RANKS + "\nSELECT * FROM cr")

_reg("top_ranked_cities", _num() + _CITY_RANKS + """
SELECT * FROM cr WHERE review_count > 100 ORDER BY review_count DESC, City LIMIT 20""")

_reg("place_ranks", _num() + """,
pm AS (SELECT Place, City, COUNT(Rating) AS review_count FROM reviews GROUP BY Place, City)
SELECT Place, City, review_count,
       CAST(RANK() OVER (ORDER BY review_count DESC) AS BIGINT) AS rank,
       CAST(DENSE_RANK() OVER (ORDER BY review_count DESC) AS BIGINT) AS dense_rank,
       CAST(ROW_NUMBER() OVER (ORDER BY review_count DESC, Place, City) AS BIGINT) AS row_number,
       ROUND(PERCENT_RANK() OVER (ORDER BY review_count DESC), 4) AS percent_rank
FROM pm""")

_PLACE_IN_CITY = _PLACE_ENRICHED + """,
pic AS (SELECT pe.*,
        CAST(RANK() OVER (PARTITION BY City ORDER BY review_count DESC) AS BIGINT) AS city_rank,
        CAST(DENSE_RANK() OVER (PARTITION BY City ORDER BY review_count DESC) AS BIGINT) AS city_dense_rank,
        CAST(ROW_NUMBER() OVER (PARTITION BY City ORDER BY review_count DESC, Place) AS BIGINT) AS city_row_number
        FROM pe)"""

_reg("place_ranks_in_city", _num() + _PLACE_IN_CITY + "\nSELECT * FROM pic")
_reg("top_ranked_places", _num() + _PLACE_IN_CITY + """
SELECT * FROM pic WHERE review_count > 10 ORDER BY review_count DESC, Place, City LIMIT 20""")

_CITY_STATE = """
city_state AS (SELECT n.n_name AS City, r.r_name AS State
               FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
               WHERE r.r_name <> 'MIDDLE EAST')"""

_reg("state_metrics", _num() + """,
cm AS (SELECT City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating,
              ROUND(STDDEV_SAMP(Rating), 4) AS rating_std,
              ROUND(AVG(CASE WHEN Rating = 5 THEN 1 ELSE 0 END), 4) AS five_star_rate
       FROM reviews GROUP BY City),""" + _CITY_STATE + """
SELECT cs.State, CAST(SUM(cm.review_count) AS BIGINT) AS total_reviews,
       ROUND(AVG(CAST(cm.avg_rating AS DECIMAL(30, 4))), 4) AS avg_rating,
       ROUND(AVG(CAST(cm.rating_std AS DECIMAL(30, 4))), 4) AS avg_rating_std, COUNT(cm.City) AS num_cities,
       ROUND(AVG(CAST(cm.five_star_rate AS DECIMAL(30, 4))), 4) AS avg_five_star_rate
FROM cm JOIN city_state cs ON cm.City = cs.City GROUP BY cs.State""")

_reg("place_primary_city", _num() + _MODE_PLACE_CITY + """
SELECT Place, mode_city AS primary_city FROM mode_city""")

_reg("places_per_city", _num() + _MODE_PLACE_CITY + """
SELECT mode_city AS primary_city, COUNT(*) AS place_count FROM mode_city GROUP BY mode_city""")

_PLACE_AVG = """,
pr AS (SELECT Place, ROUND(AVG(Rating), 4) AS avg_rating FROM reviews GROUP BY Place)"""

_reg("place_rating_histogram", _num() + _PLACE_AVG + """,
b AS (SELECT CASE WHEN MIN(avg_rating) = MAX(avg_rating) THEN MIN(avg_rating) - 0.5 ELSE MIN(avg_rating) END AS mn,
             CASE WHEN MIN(avg_rating) = MAX(avg_rating) THEN MAX(avg_rating) + 0.5 ELSE MAX(avg_rating) END AS mx
      FROM pr),
c AS (SELECT CAST(LEAST(FLOOR((avg_rating - mn) / (mx - mn) * 50.0), 49) AS INTEGER) AS bin, COUNT(*) AS count
      FROM pr, b GROUP BY 1),
spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 50))
SELECT spine.bin, ROUND(mn + (spine.bin + 0.5) * ((mx - mn) / 50.0), 4) AS bin_center,
       CAST(COALESCE(c.count, 0) AS BIGINT) AS count
FROM spine CROSS JOIN b LEFT JOIN c ON spine.bin = c.bin""")

_reg("place_rating_box", _num() + _PLACE_AVG + """,
q AS (SELECT QUANTILE_CONT(avg_rating, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM pr)
SELECT ROUND(q[1], 4) AS min, ROUND(q[2], 4) AS q1, ROUND(q[3], 4) AS median,
       ROUND(q[4], 4) AS q3, ROUND(q[5], 4) AS max FROM q""")

_reg("city_place_rollup", _num() + """,
pm AS (SELECT Place, City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating
       FROM reviews GROUP BY Place, City)
SELECT City, Place, CAST(SUM(review_count) AS BIGINT) AS total_reviews,
       ROUND(SUM(CAST(avg_rating AS DECIMAL(30, 4)) * review_count) / SUM(review_count), 4) AS weighted_rating,
       CAST(GROUPING_ID(City, Place) AS INTEGER) AS level
FROM pm GROUP BY ROLLUP (City, Place)""")

_reg("first_reviews", _num() + """
SELECT City, Place, Rating, polarity, subjectivity FROM reviews
ORDER BY City, Place, Rating, polarity, subjectivity LIMIT 5000""")


def _hs(key: str) -> str:
    """Hotspot table as CTE ``hs`` (rounded components, sequential rank)."""
    return _hotspot_sql(key) + f""",
hs AS (SELECT {key}, CAST(ROW_NUMBER() OVER (ORDER BY hotspot_score DESC, {key}) AS BIGINT) AS rank,
              avg_rating, review_count, rating_std, avg_polarity,
              ROUND(rs, 6) AS rating_score, ROUND(vs, 6) AS volume_score, ROUND(ss, 6) AS sentiment_score,
              hotspot_score FROM h)"""


_reg("review_sample_properties", """
SELECT LEAST(5000, COUNT(*)) AS rows, CAST(0 AS BIGINT) AS excess_rows FROM lineitem""")
_reg("reviewer_sketch_error", _num(True) + """
SELECT City, COUNT(DISTINCT Name) AS unique_reviewers, TRUE AS within_bound FROM reviews GROUP BY City""")

_reg("reviewer_sketch_levels", _num(True) + "," + _CITY_STATE + """
SELECT 'place' AS level, City || '/' || Place AS key, COUNT(DISTINCT Name) AS unique_reviewers, TRUE AS within_bound FROM reviews GROUP BY City, Place
UNION ALL SELECT 'city', City, COUNT(DISTINCT Name), TRUE FROM reviews GROUP BY City
UNION ALL SELECT 'state', cs.State, COUNT(DISTINCT Name), TRUE FROM reviews JOIN city_state cs ON reviews.City = cs.City GROUP BY cs.State""")

_reg("coerced_ratings", _num() + """
SELECT City, COUNT(*) AS rows, ROUND(AVG(GREATEST(COALESCE(CAST(Rating AS DOUBLE), 3.0), 1.0)), 4) AS avg_rating,
       MIN(GREATEST(COALESCE(CAST(Rating AS DOUBLE), 3.0), 1.0)) AS min_rating FROM reviews_raw GROUP BY City""")

_reg("csv_rejects", _num() + """
SELECT 'good' AS kind, City, COUNT(*) AS rows, ROUND(AVG(Rating), 4) AS avg_rating FROM reviews_raw WHERE Rating IS NOT NULL GROUP BY City
UNION ALL SELECT 'rejected', NULL, COUNT(*), NULL FROM reviews_raw WHERE Rating IS NULL""")

_reg("incremental_cities", _num() + """
SELECT City, COUNT(Rating) AS review_count, ROUND(AVG(Rating), 4) AS avg_rating, ROUND(STDDEV_SAMP(Rating), 4) AS rating_std,
       COUNT(DISTINCT Place) AS unique_places FROM reviews GROUP BY City""")

_reg("record_export", _hs("City") + """
SELECT '{"rank":' || rank || ',"City":"' || City || '","hotspot_score":' || hotspot_score || '}' AS record FROM hs""")

_reg("state_hotspots", _hs("City") + "," + _CITY_STATE + """
SELECT cs.State, CAST(SUM(hs.review_count) AS BIGINT) AS ReviewCount,
       ROUND(AVG(CAST(hs.avg_rating AS DECIMAL(30, 4))), 4) AS AverageRating,
       ROUND(AVG(CAST(hs.hotspot_score AS DECIMAL(30, 6))), 4) AS HotspotScore, COUNT(hs.City) AS NumCities,
       ROUND(AVG(CAST(hs.avg_polarity AS DECIMAL(30, 4))), 4) AS SentimentScore
FROM hs JOIN city_state cs ON hs.City = cs.City GROUP BY cs.State""")

_reg("reweighted_city_ranks", _hs("City") + """,
rw AS (SELECT City, hotspot_score, rank AS old_rank,
              ROUND(0.2 * rating_score + 0.5 * volume_score + 0.3 * sentiment_score, 6) AS custom_hotspot_score
       FROM hs),
rr AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY custom_hotspot_score DESC, City) AS BIGINT) AS new_rank FROM rw)
SELECT City, hotspot_score, custom_hotspot_score, old_rank, new_rank,
       CAST(old_rank - new_rank AS BIGINT) AS rank_change FROM rr""")

_reg("zero_weight_ranks", _hs("City") + """
SELECT City, ROUND(0.5 * COALESCE(rating_score, 0.0) + 0.3 * COALESCE(volume_score, 0.0) + 0.2 * COALESCE(sentiment_score, 0.0), 6) AS default_score,
       0.0 AS zero_score FROM hs""")

_INSIGHTS = _hs("Place").replace("WITH ", "WITH ", 1) + """,
pc AS (SELECT Place, City, COUNT(*) AS n FROM reviews GROUP BY Place, City),
pc_ranked AS (SELECT Place, City, ROW_NUMBER() OVER (PARTITION BY Place ORDER BY n DESC, City) AS rn FROM pc),
mode_city AS (SELECT Place, City AS mode_city FROM pc_ranked WHERE rn = 1),
fr AS (SELECT hs.*, COALESCE(m.mode_city, 'Unknown') AS City, COALESCE(hs.rating_std, 0.0) AS std0
       FROM hs LEFT JOIN mode_city m ON hs.Place = m.Place),
sb AS (SELECT MIN(std0) AS s0, MAX(std0) AS s1 FROM fr),
sg AS (SELECT fr.*, COALESCE(rating_score, 0.0) AS r, COALESCE(volume_score, 0.0) AS v,
              COALESCE(sentiment_score, 0.0) AS s,
              CASE WHEN s1 = s0 THEN 0.0 ELSE (std0 - s0) / (s1 - s0) END AS sd
       FROM fr, sb),
ins AS (SELECT Place, City, review_count, avg_rating, rating_std, hotspot_score,
               ROUND(0.36 * r + 0.28 * s + 0.20 * (1.0 - sd) + 0.16 * (1.0 - v), 6) AS hidden_gem_score,
               ROUND(0.35 * v + 0.25 * (1.0 - r) + 0.25 * (1.0 - s) + 0.15 * sd, 6) AS risk_score,
               ROUND(v, 6) AS confidence_score
        FROM sg)"""

_reg("place_insights", _INSIGHTS + "\nSELECT * FROM ins")
_reg("hidden_gems", _INSIGHTS + """
SELECT * FROM ins WHERE review_count BETWEEN 30 AND 1200 ORDER BY hidden_gem_score DESC, Place LIMIT 25""")
_reg("risk_places", _INSIGHTS + """
SELECT * FROM ins WHERE review_count >= 800 ORDER BY risk_score DESC, Place LIMIT 25""")

_reg("risk_places_small", _INSIGHTS + """
SELECT * FROM ins WHERE review_count >= 20 ORDER BY risk_score DESC, Place LIMIT 25""")
_reg("place_insights_sentiment", _INSIGHTS + """,
sub AS (SELECT Place, ROUND(AVG(subjectivity), 4) AS avg_subjectivity FROM reviews GROUP BY Place)
SELECT ins.Place, ins.City, ins.review_count, ins.avg_rating, hs.avg_polarity, sub.avg_subjectivity,
       CASE WHEN hs.avg_polarity > 0.05 THEN 'Positive' WHEN hs.avg_polarity < -0.05 THEN 'Negative'
            ELSE 'Neutral' END AS dominant_sentiment,
       ins.hotspot_score, ins.hidden_gem_score, ins.risk_score, ins.confidence_score
FROM ins JOIN hs ON ins.Place = hs.Place JOIN sub ON ins.Place = sub.Place""")
_reg("lowest_polarity_places", _num() + """,
p AS (SELECT Place, ROUND(AVG(polarity), 4) AS avg_polarity, ROUND(AVG(subjectivity), 4) AS avg_subjectivity,
             COUNT(*) AS review_count FROM reviews GROUP BY Place)
SELECT *, CASE WHEN avg_polarity > 0.05 THEN 'Positive' WHEN avg_polarity < -0.05 THEN 'Negative'
               ELSE 'Neutral' END AS dominant_sentiment
FROM p ORDER BY avg_polarity, Place LIMIT 20""")
_reg("filter_values", _num() + """,
v AS (SELECT 'City' AS field, City AS value FROM reviews UNION SELECT 'Place', Place FROM reviews)
SELECT field, value, ROW_NUMBER() OVER (PARTITION BY field ORDER BY value) AS position FROM v""")

_SIMILAR = """,
f AS (SELECT *, avg_rating AS f0, ln(1 + GREATEST(CAST(review_count AS DOUBLE), 0.0)) AS f1,
             avg_polarity AS f2, hotspot_score AS f3, rating_std AS f4
      FROM hs WHERE avg_rating IS NOT NULL AND review_count IS NOT NULL AND avg_polarity IS NOT NULL
                AND hotspot_score IS NOT NULL AND rating_std IS NOT NULL),
b AS (SELECT MIN(f0) a0, MAX(f0) b0, MIN(f1) a1, MAX(f1) b1, MIN(f2) a2, MAX(f2) b2,
             MIN(f3) a3, MAX(f3) b3, MIN(f4) a4, MAX(f4) b4 FROM f),
n AS (SELECT f.*,
        CASE WHEN b0 = a0 THEN 0.0 ELSE (f0 - a0) / (b0 - a0) END AS g0,
        CASE WHEN b1 = a1 THEN 0.0 ELSE (f1 - a1) / (b1 - a1) END AS g1,
        CASE WHEN b2 = a2 THEN 0.0 ELSE (f2 - a2) / (b2 - a2) END AS g2,
        CASE WHEN b3 = a3 THEN 0.0 ELSE (f3 - a3) / (b3 - a3) END AS g3,
        CASE WHEN b4 = a4 THEN 0.0 ELSE (f4 - a4) / (b4 - a4) END AS g4
      FROM f, b)"""

_reg("similar_places", _hs("Place") + _SIMILAR + """,
seed AS (SELECT * FROM n
         WHERE lower(Place) = 'part#1' OR contains(lower(Place), 'part#1')
         ORDER BY CASE WHEN lower(Place) = 'part#1' THEN 0 ELSE 1 END, rank, Place LIMIT 1),
d AS (SELECT n.Place, n.rank, n.avg_rating, n.review_count, n.avg_polarity, n.hotspot_score,
             1.0 / (1.0 + SQRT((n.g0 - s.g0) * (n.g0 - s.g0) + (n.g1 - s.g1) * (n.g1 - s.g1)
                                     + (n.g2 - s.g2) * (n.g2 - s.g2) + (n.g3 - s.g3) * (n.g3 - s.g3)
                                     + (n.g4 - s.g4) * (n.g4 - s.g4))) AS similarity
      FROM n, seed s WHERE n.Place <> s.Place)
SELECT Place, ROUND(similarity, 4) AS similarity, avg_rating, review_count, avg_polarity, hotspot_score
FROM d ORDER BY d.similarity DESC, rank, Place LIMIT 10""")

_reg("similar_to_each_place", _hs("Place") + _SIMILAR + """,
d AS (SELECT s.Place, n.Place AS similar_place, n.rank,
             1.0 / (1.0 + SQRT((n.g0 - s.g0) * (n.g0 - s.g0) + (n.g1 - s.g1) * (n.g1 - s.g1)
                                     + (n.g2 - s.g2) * (n.g2 - s.g2) + (n.g3 - s.g3) * (n.g3 - s.g3)
                                     + (n.g4 - s.g4) * (n.g4 - s.g4))) AS similarity
      FROM n s JOIN n ON n.Place <> s.Place),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Place ORDER BY ROUND(similarity, 9) DESC, rank, similar_place) AS position FROM d)
SELECT Place, position, similar_place, ROUND(similarity, 4) AS similarity FROM r WHERE position <= 10""")

_STATE_TOP_CITIES = _hs("City") + "," + _CITY_STATE + """,
stc AS (SELECT cs.State, hs.City, hs.avg_rating, hs.review_count, hs.avg_polarity, hs.hotspot_score,
               CAST(ROW_NUMBER() OVER (PARTITION BY cs.State ORDER BY hs.hotspot_score DESC, hs.City) AS INTEGER)
                 AS state_rank
        FROM hs JOIN city_state cs ON hs.City = cs.City)"""

_reg("state_top_cities", _STATE_TOP_CITIES + "\nSELECT * FROM stc WHERE state_rank <= 10")
_reg("state_detail_summary", _STATE_TOP_CITIES + """
SELECT State, CAST(SUM(review_count) AS BIGINT) AS total_reviews,
       ROUND(AVG(CAST(NULLIF(avg_rating, 0) AS DECIMAL(30, 4))), 3) AS avg_rating,
       ROUND(AVG(CAST(NULLIF(avg_polarity, 0) AS DECIMAL(30, 4))), 4) AS avg_polarity,
       ROUND(AVG(CAST(NULLIF(hotspot_score, 0) AS DECIMAL(30, 6))), 4) AS avg_hotspot_score
FROM stc WHERE state_rank <= 10 GROUP BY State""")

_reg("state_top_places", _hs("Place") + "," + _CITY_STATE + """,
pc AS (SELECT Place, City, COUNT(*) AS n FROM reviews GROUP BY Place, City),
pc_ranked AS (SELECT Place, City, ROW_NUMBER() OVER (PARTITION BY Place ORDER BY n DESC, City) AS rn FROM pc),
mode_city AS (SELECT Place, City AS primary_city FROM pc_ranked WHERE rn = 1),
sp AS (SELECT cs.State, hs.Place, hs.avg_rating, hs.review_count, hs.avg_polarity, hs.hotspot_score,
              CAST(ROW_NUMBER() OVER (PARTITION BY cs.State ORDER BY hs.hotspot_score DESC, hs.Place) AS INTEGER)
                AS state_rank
       FROM hs JOIN mode_city m ON hs.Place = m.Place JOIN city_state cs ON m.primary_city = cs.City)
SELECT * FROM sp WHERE state_rank <= 10""")

_reg("state_places", _hs("Place") + "," + _CITY_STATE + """,
pc AS (SELECT Place, City, COUNT(*) AS n FROM reviews GROUP BY Place, City),
pr AS (SELECT Place, City, ROW_NUMBER() OVER (PARTITION BY Place ORDER BY n DESC, City) AS rn FROM pc)
SELECT Place, rank, avg_rating, review_count, avg_polarity, hotspot_score FROM hs
WHERE Place IN (SELECT pr.Place FROM pr JOIN city_state cs ON pr.City = cs.City
                WHERE pr.rn = 1 AND cs.State = 'EUROPE')""")
_reg("state_map_rows", _hs("City") + "," + _CITY_STATE + """
SELECT cs.State, CAST(SUM(hs.review_count) AS BIGINT) AS total_reviews,
       ROUND(AVG(CAST(hs.avg_rating AS DECIMAL(30, 4))), 4) AS avg_rating,
       ROUND(AVG(CAST(hs.hotspot_score AS DECIMAL(30, 6))), 4) AS avg_hotspot_score, COUNT(hs.City) AS num_cities,
       ROUND(AVG(CAST(hs.avg_polarity AS DECIMAL(30, 4))), 4) AS avg_polarity
FROM hs JOIN city_state cs ON hs.City = cs.City GROUP BY cs.State""")
_reg("comparison_raw", _hs("City") + "," + _CITY_STATE + """,
m AS (SELECT hs.City, u.Metric, u.v FROM hs JOIN city_state cs ON hs.City = cs.City,
             LATERAL (SELECT 'avg_rating' AS Metric, CAST(hs.avg_rating AS DOUBLE) AS v
                      UNION ALL SELECT 'review_count', CAST(hs.review_count AS DOUBLE)
                      UNION ALL SELECT 'avg_polarity', hs.avg_polarity
                      UNION ALL SELECT 'hotspot_score', hs.hotspot_score) u
      WHERE cs.State = 'EUROPE'),
b AS (SELECT Metric, MIN(v) AS lo, MAX(v) AS hi FROM m GROUP BY Metric)
SELECT m.City AS Destination, m.Metric,
       ROUND(CASE WHEN hi = lo THEN 0.5 ELSE (v - lo) / (hi - lo) END, 6) AS Value
FROM m JOIN b ON m.Metric = b.Metric""")

_reg("score_breakdown", _hs("City") + """,
top AS (SELECT * FROM hs ORDER BY hotspot_score DESC, City LIMIT 20)
SELECT City, 'rating' AS component, ROUND(0.5 * rating_score, 6) AS contribution FROM top
UNION ALL SELECT City, 'volume', ROUND(0.3 * volume_score, 6) FROM top
UNION ALL SELECT City, 'sentiment', ROUND(0.2 * sentiment_score, 6) FROM top""")

_reg("comparison", _hs("City") + "," + _CITY_STATE + """,
sel AS (SELECT hs.City, COALESCE(hs.avg_rating, 0.0) AS m0,
               COALESCE(ln(1 + GREATEST(CAST(hs.review_count AS DOUBLE), 0.0)), 0.0) AS m1,
               COALESCE(hs.avg_polarity, 0.0) AS m2, COALESCE(hs.hotspot_score, 0.0) AS m3
        FROM hs JOIN city_state cs ON hs.City = cs.City WHERE cs.State = 'EUROPE'),
b AS (SELECT MIN(m0) a0, MAX(m0) b0, MIN(m1) a1, MAX(m1) b1, MIN(m2) a2, MAX(m2) b2, MIN(m3) a3, MAX(m3) b3 FROM sel),
n AS (SELECT City,
        ROUND(CASE WHEN b0 = a0 THEN 0.0 ELSE (m0 - a0) / (b0 - a0) END, 6) AS avg_rating,
        ROUND(CASE WHEN b1 = a1 THEN 0.0 ELSE (m1 - a1) / (b1 - a1) END, 6) AS review_count,
        ROUND(CASE WHEN b2 = a2 THEN 0.0 ELSE (m2 - a2) / (b2 - a2) END, 6) AS avg_polarity,
        ROUND(CASE WHEN b3 = a3 THEN 0.0 ELSE (m3 - a3) / (b3 - a3) END, 6) AS hotspot_score
      FROM sel, b)
SELECT City AS Destination, 'avg_rating' AS Metric, avg_rating AS Value FROM n
UNION ALL SELECT City, 'review_count', review_count FROM n
UNION ALL SELECT City, 'avg_polarity', avg_polarity FROM n
UNION ALL SELECT City, 'hotspot_score', hotspot_score FROM n""")

_reg("comparison_chosen", _hs("City") + """,
sel AS (SELECT hs.City, COALESCE(hs.avg_rating, 0.0) AS m0,
               COALESCE(ln(1 + GREATEST(CAST(hs.review_count AS DOUBLE), 0.0)), 0.0) AS m1,
               COALESCE(hs.avg_polarity, 0.0) AS m2, COALESCE(hs.hotspot_score, 0.0) AS m3
        FROM hs WHERE hs.City IN ('NATION_3', 'NATION_7', 'NATION_11', 'nowhere')),
b AS (SELECT MIN(m0) a0, MAX(m0) b0, MIN(m1) a1, MAX(m1) b1, MIN(m2) a2, MAX(m2) b2, MIN(m3) a3, MAX(m3) b3 FROM sel),
n AS (SELECT City,
        ROUND(CASE WHEN b0 = a0 THEN 0.0 ELSE (m0 - a0) / (b0 - a0) END, 6) AS avg_rating,
        ROUND(CASE WHEN b1 = a1 THEN 0.0 ELSE (m1 - a1) / (b1 - a1) END, 6) AS review_count,
        ROUND(CASE WHEN b2 = a2 THEN 0.0 ELSE (m2 - a2) / (b2 - a2) END, 6) AS avg_polarity,
        ROUND(CASE WHEN b3 = a3 THEN 0.0 ELSE (m3 - a3) / (b3 - a3) END, 6) AS hotspot_score
      FROM sel, b)
SELECT City AS Destination, 'avg_rating' AS Metric, avg_rating AS Value FROM n
UNION ALL SELECT City, 'review_count', review_count FROM n
UNION ALL SELECT City, 'avg_polarity', avg_polarity FROM n
UNION ALL SELECT City, 'hotspot_score', hotspot_score FROM n""")

_COORDS = """
coords AS (
  SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name
              WHEN n_nationkey % 3 = 1 THEN
                   upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' (N' || CAST(n_nationkey AS VARCHAR) || ')'
              ELSE lower(n_name) || '-x' END AS city,
         n_nationkey * 1.5 - 10.0 AS lat, n_nationkey * 0.75 + 60.0 AS lon, CAST(n_nationkey AS INTEGER) AS ordinal
  FROM nation),
cc AS (SELECT City, trim(regexp_replace(City, '\\s+', ' ', 'g')) AS ex FROM (SELECT DISTINCT City FROM reviews)),
cc2 AS (SELECT City, ex, lower(regexp_replace(ex, '\\s*\\([^)]*\\)', '', 'g')) AS cl FROM cc),
dd AS (SELECT trim(regexp_replace(city, '\\s+', ' ', 'g')) AS dex, lat, lon, ordinal FROM coords),
dd2 AS (SELECT dex, lower(regexp_replace(dex, '\\s*\\([^)]*\\)', '', 'g')) AS dcl, lat, lon, ordinal FROM dd),
cand AS (
  SELECT City, 1 AS pass, ordinal, lat, lon FROM cc2 JOIN dd2 ON ex = dex
  UNION ALL SELECT City, 2, ordinal, lat, lon FROM cc2 JOIN dd2 ON cl = dcl
  UNION ALL SELECT City, 3, ordinal, lat, lon FROM cc2 JOIN dd2
            ON dcl <> '' AND cl <> '' AND (starts_with(cl, dcl) OR starts_with(dcl, cl))),
best AS (SELECT City, lat, lon FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY City ORDER BY pass, ordinal) AS rn FROM cand) WHERE rn = 1)"""

_reg("city_coords", _num() + "," + _COORDS + "\nSELECT City, lat, lon FROM best")

_reg("map_points", _hs("City") + "," + _COORDS + """,
sel AS (SELECT * FROM hs WHERE hotspot_score >= 0.0),
geo AS (SELECT sel.*, best.lat, best.lon,
               COALESCE(ln(1 + GREATEST(COALESCE(CAST(sel.review_count AS DOUBLE), 0.0), 0.0)), 0.0) AS vol,
               COALESCE(CAST(sel.hotspot_score AS DOUBLE), 0.0) AS met
        FROM sel JOIN best ON sel.City = best.City),
b AS (SELECT MIN(vol) v0, MAX(vol) v1, MIN(met) m0, MAX(met) m1 FROM geo),
g AS (SELECT geo.*, CASE WHEN v1 = v0 THEN 0.0 ELSE (vol - v0) / (v1 - v0) END AS vs,
             CASE WHEN m1 = m0 THEN 0.0 ELSE (met - m0) / (m1 - m0) END AS ms FROM geo, b)
SELECT City, lat, lon, hotspot_score, review_count,
       ROUND(GREATEST(COALESCE(hotspot_score, 0.0), 0.05), 6) AS weight,
       ROUND(6.0 + 22.0 * vs, 6) AS radius, ROUND(ms, 6) AS metric_scaled,
       CASE WHEN ms < 0.33 THEN 'low' WHEN ms < 0.66 THEN 'mid' ELSE 'high' END AS band
FROM g""")

_reg("map_coverage", _hs("City") + "," + _COORDS + """,
sel AS (SELECT * FROM hs),
j AS (SELECT sel.*, best.City IS NOT NULL AS mapped FROM sel LEFT JOIN best ON sel.City = best.City)
SELECT COUNT(*) FILTER (WHERE mapped) AS mapped, COUNT(*) FILTER (WHERE NOT mapped) AS unmapped,
       ROUND(MIN(hotspot_score) FILTER (WHERE mapped), 6) AS score_min,
       ROUND(MAX(hotspot_score) FILTER (WHERE mapped), 6) AS score_max, COUNT(*) AS total
FROM j""")

_reg("state_coverage", _hs("City") + "," + _CITY_STATE + """,
j AS (SELECT hs.*, cs.State IS NOT NULL AS mapped FROM hs LEFT JOIN city_state cs ON hs.City = cs.City)
SELECT COUNT(*) FILTER (WHERE mapped) AS mapped, COUNT(*) FILTER (WHERE NOT mapped) AS unmapped,
       ROUND(MIN(hotspot_score) FILTER (WHERE mapped), 6) AS score_min,
       ROUND(MAX(hotspot_score) FILTER (WHERE mapped), 6) AS score_max, COUNT(*) AS total
FROM j""")


# ── text queries ────────────────────────────────────────────────────────────
from revlens.operators.text import word_boundary_pattern  # noqa: E402
from revlens.sources import dimensions as _dims  # noqa: E402
from revlens.sources.testdata import REVIEWS_TEXT_SQL  # noqa: E402

_BLANK = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def _blank(x: str) -> str:
    return f"COALESCE(regexp_replace({x}, '{_BLANK}', '', 'g') = '', TRUE)"


def _choose(review: str, raw: str) -> str:
    return f"(CASE WHEN NOT {_blank(review)} THEN {review} WHEN NOT {_blank(raw)} THEN {raw} ELSE '' END)"


def _clean(x: str) -> str:
    return f"COALESCE(trim(regexp_replace(lower({x}), '[^a-z]+', ' ', 'g')), '')"


_LABEL = "CASE WHEN {x} > 0.05 THEN 'Positive' WHEN {x} < -0.05 THEN 'Negative' ELSE 'Neutral' END"



def _scores_sql(lexicon: str) -> str:
    """Review scores as CTE ``sent``: two predecessors decide the modifier of a token."""
    return "WITH " + REVIEWS_TEXT_SQL + f""",
txt AS (SELECT doc_id, City, Place, Rating, {_clean(_choose('Review', 'Raw_Review'))} AS ct FROM reviews_text),
tk AS (SELECT doc_id, City, Place, Rating, string_split(ct, ' ') AS toks FROM txt),
pr AS (SELECT doc_id, City, Place, Rating, unnest(toks) AS w,
              unnest(list_concat([''], toks)[1:len(toks)]) AS p,
              unnest(list_concat(['', ''], toks)[1:len(toks)]) AS q FROM tk),
lex AS (SELECT * FROM {lexicon}),
mods AS (SELECT word, intensity FROM lex WHERE intensity IS NOT NULL),
ch AS (SELECT pr.*, lw.polarity AS pol, lw.subjectivity AS sub,
              CASE WHEN m1.intensity IS NULL THEN 1.0 ELSE m1.intensity * COALESCE(m2.intensity, 1.0) END AS f
       FROM pr LEFT JOIN (SELECT * FROM lex WHERE polarity IS NOT NULL) lw ON pr.w = lw.word
               LEFT JOIN mods m1 ON pr.p = m1.word LEFT JOIN mods m2 ON pr.q = m2.word),
sc AS (SELECT doc_id, City, Place, Rating,
              CASE WHEN pol IS NULL THEN NULL ELSE GREATEST(-1.0, LEAST(1.0, pol * f)) END AS ps,
              CASE WHEN sub IS NULL THEN NULL
                   ELSE GREATEST(0.0, LEAST(1.0, sub * CASE WHEN f > 0 THEN f ELSE 1.0 END)) END AS ss
       FROM ch),
sent0 AS (SELECT doc_id, City, Place, Rating, COALESCE(ROUND(AVG(ps), 4), 0.0) AS polarity,
                 COALESCE(ROUND(AVG(ss), 4), 0.0) AS subjectivity
          FROM sc GROUP BY doc_id, City, Place, Rating),
sent AS (SELECT *, {_LABEL.format(x='polarity')} AS sentiment FROM sent0)"""


_COMMON = _scores_sql(_dims.lexicon_values_sql(_dims.COMMON_WORD_LEXICON, _dims.COMMON_NEGATORS))
_reg("sentiment_common", _COMMON + "\nSELECT doc_id, City, Place, polarity, subjectivity, sentiment FROM sent")
_reg("sentiment_common_distribution", _COMMON + """,
d AS (SELECT sentiment AS label, COUNT(*) AS count FROM sent GROUP BY sentiment)
SELECT label, count, ROUND(count / (SELECT SUM(count) FROM d) * 100, 2) AS pct FROM d""")

_SENT = _scores_sql(_dims.lexicon_values_sql()) + """,
ps_c AS (SELECT City, Place, sentiment, COUNT(*) AS n, SUM(CAST(polarity AS DECIMAL(30, 4))) AS s, COUNT(polarity) AS c
         FROM sent GROUP BY City, Place, sentiment),
ps_r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY City, Place ORDER BY n DESC, sentiment) AS rn FROM ps_c),
place_sent AS (SELECT a.City, a.Place, ROUND(t.s / t.c, 4) AS polarity, a.sentiment
               FROM ps_r a JOIN (SELECT City, Place, SUM(s) AS s, SUM(c) AS c FROM ps_c GROUP BY City, Place) t
                 ON a.City = t.City AND a.Place = t.Place
               WHERE a.rn = 1),
search AS (SELECT r.doc_id, COALESCE(r.City, 'Unknown') AS City, COALESCE(r.Place, 'Unknown') AS Place,
                  COALESCE(r.Raw_Review, '') AS Review, r.Rating
           FROM reviews_text r),
search_s AS (SELECT s.*, p.polarity, p.sentiment FROM search s LEFT JOIN place_sent p
             ON s.City = p.City AND s.Place = p.Place)"""

_reg("review_text_clean", "WITH " + REVIEWS_TEXT_SQL + f"""
SELECT doc_id, {_choose('Review', 'Raw_Review')} AS review_text,
       {_clean(_choose('Review', 'Raw_Review'))} AS clean_text
FROM reviews_text""")

_reg("sentiment_results", _SENT + "\nSELECT doc_id, City, Place, Rating, polarity, subjectivity, sentiment FROM sent")

for _k, _name in (("City", "sentiment_by_lang"), ("Place", "sentiment_by_source")):
    _reg(_name, _SENT + f""",
g AS (SELECT {_k}, ROUND(AVG(CAST(polarity AS DECIMAL(30, 4))), 4) AS avg_polarity,
             ROUND(AVG(CAST(subjectivity AS DECIMAL(30, 4))), 4) AS avg_subjectivity,
             COUNT(*) AS review_count FROM sent GROUP BY {_k})
SELECT *, {_LABEL.format(x='avg_polarity')} AS dominant_sentiment FROM g""")

_reg("sentiment_distribution", _SENT + """,
d AS (SELECT sentiment AS label, COUNT(*) AS count FROM sent GROUP BY sentiment)
SELECT label, count, ROUND(count / (SELECT SUM(count) FROM d) * 100, 2) AS pct FROM d""")

_reg("place_sentiment", _SENT + "\nSELECT City, Place, polarity, sentiment FROM place_sent")

_reg("polarity_histogram", _SENT + """,
b AS (SELECT CASE WHEN MIN(polarity) = MAX(polarity) THEN MIN(polarity) - 0.5 ELSE MIN(polarity) END AS mn,
             CASE WHEN MIN(polarity) = MAX(polarity) THEN MAX(polarity) + 0.5 ELSE MAX(polarity) END AS mx
      FROM sent),
c AS (SELECT CAST(LEAST(FLOOR((polarity - mn) / (mx - mn) * 50.0), 49) AS INTEGER) AS bin, COUNT(*) AS count
      FROM sent, b GROUP BY 1),
spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 50))
SELECT spine.bin, ROUND(mn + (spine.bin + 0.5) * ((mx - mn) / 50.0), 4) AS bin_center,
       CAST(COALESCE(c.count, 0) AS BIGINT) AS count
FROM spine CROSS JOIN b LEFT JOIN c ON spine.bin = c.bin""")

_reg("reviews_with_place_sentiment", _SENT + "\nSELECT doc_id, City, Place, Rating, polarity, sentiment FROM search_s")

_FILTER = """lower(City) = 'en' AND Rating >= 3.0 AND COALESCE(contains(lower(Review), 'the'), FALSE)"""


def _sq(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _substring_aspects(mapping: dict, src: str) -> str:
    """Per-review aspect flags (substring rule), long form of matches."""
    parts = []
    for i, (a, kws) in enumerate(mapping.items()):
        cond = " OR ".join(f"contains(lower(Review), {_sq(k.lower())})" for k in kws)
        parts.append(f"SELECT {_sq(a)} AS aspect, {i} AS ordinal, Rating FROM {src} WHERE {cond}")
    spine = " UNION ALL ".join(f"SELECT {_sq(a)} AS aspect, {i} AS ordinal" for i, a in enumerate(mapping))
    return f"""m AS ({' UNION ALL '.join(parts)}),
spine AS ({spine}),
am AS (SELECT spine.aspect, spine.ordinal, CAST(COUNT(m.aspect) AS BIGINT) AS mentions,
              ROUND(AVG(CASE WHEN isnan(m.Rating) THEN NULL ELSE m.Rating END), 2) AS avg_rating
       FROM spine LEFT JOIN m ON spine.aspect = m.aspect GROUP BY spine.aspect, spine.ordinal)"""


_reg("review_search_aspects", _SENT + f""",
flt AS (SELECT * FROM search_s WHERE {_FILTER}),
{_substring_aspects(_dims.SEARCH_ASPECTS, 'flt')}
SELECT * FROM am""")

_reg("review_search_summary", _SENT + f""",
flt AS (SELECT * FROM search_s WHERE {_FILTER}),
{_substring_aspects(_dims.SEARCH_ASPECTS, 'flt')},
top AS (SELECT aspect AS top_aspect FROM am ORDER BY mentions DESC, ordinal LIMIT 1)
SELECT COUNT(*) AS count, ROUND(AVG(CASE WHEN isnan(Rating) THEN NULL ELSE Rating END), 2) AS avg_rating,
       ROUND(AVG(CAST(polarity AS DECIMAL(30, 4))), 4) AS avg_polarity, (SELECT top_aspect FROM top) AS top_aspect
FROM flt""")

_reg("review_search_rows", _SENT + f""",
flt AS (SELECT * FROM search_s WHERE {_FILTER})
SELECT doc_id, City, Place, substr(Review, 1, 400) AS Review, Rating, polarity, sentiment
FROM flt ORDER BY doc_id LIMIT 50""")

_reg("indexed_search", "WITH " + REVIEWS_TEXT_SQL + """
SELECT k.keyword, doc_id, City, Place FROM reviews_text, (VALUES ('tionment'), ('Er'), ('zzzq'), ('es de')) AS k(keyword)
WHERE contains(lower(Raw_Review), lower(k.keyword))""")

_reg("aspect_mentions_all", _SENT + f""",
{_substring_aspects(_dims.SEARCH_ASPECTS, 'search_s')}
SELECT * FROM am""")
_reg("aspect_mentions_common", _SENT + f""",
{_substring_aspects(_dims.COMMON_WORD_ASPECTS, 'search_s')}
SELECT * FROM am""")


def _boundary_summary(mapping: dict) -> str:
    parts = []
    for a, kws in mapping.items():
        pat = word_boundary_pattern([k.lower() for k in kws]).replace("'", "''")
        parts.append(f"SELECT {_sq(a)} AS aspect, Rating FROM rt WHERE regexp_matches(lower(review_text), '{pat}')")
    return "WITH " + REVIEWS_TEXT_SQL + f""",
rt0 AS (SELECT doc_id, Rating, {_choose('Review', 'Raw_Review')} AS review_text FROM reviews_text),
rt AS (SELECT * FROM rt0 WHERE NOT {_blank('review_text')} AND Rating IS NOT NULL),
m AS ({' UNION ALL '.join(parts)})
SELECT aspect, COUNT(*) AS mentions, ROUND(AVG(Rating), 6) AS avg_rating,
       ROUND(AVG(CASE WHEN Rating >= 4 THEN 1.0 ELSE 0.0 END), 6) AS positive_share,
       ROUND(AVG(CASE WHEN Rating <= 2 THEN 1.0 ELSE 0.0 END), 6) AS negative_share,
       ROUND((AVG(Rating) - 3.0) / 2.0, 6) AS signal,
       ROW_NUMBER() OVER (ORDER BY AVG(Rating) DESC, COUNT(*) DESC, aspect) AS position
FROM m GROUP BY aspect"""


_reg("aspect_summary", _boundary_summary(_dims.SUMMARY_ASPECTS))
_reg("aspect_summary_common", _boundary_summary(_dims.COMMON_WORD_ASPECTS))


# ── trend queries ───────────────────────────────────────────────────────────
from revlens.sources.testdata import INTEREST_SQL, TREND_STATUS_SQL  # noqa: E402

_TRENDS = "WITH " + INTEREST_SQL + "," + TREND_STATUS_SQL + """,
base AS (SELECT keyword AS Place, COUNT(*) AS BasePopularity FROM interest GROUP BY keyword
         ),
lim AS (SELECT CAST(CAST(MAX(ts) AS DATE) - INTERVAL 3 MONTH AS TIMESTAMP) AS t0 FROM interest),
mean AS (SELECT keyword, AVG(interest) AS raw FROM interest, lim WHERE ts >= t0 GROUP BY keyword),
j AS (SELECT b.Place, s.status AS st0, s.notes, m.raw FROM base b
      LEFT JOIN trend_status s ON b.Place = s.keyword LEFT JOIN mean m ON b.Place = m.keyword),
j2 AS (SELECT Place, notes, raw,
              CASE WHEN st0 IS NULL THEN 'fallback' WHEN st0 = 'live' AND raw IS NULL THEN 'unavailable' ELSE st0 END AS status
       FROM j),
j3 AS (SELECT *, CASE WHEN status = 'live' THEN raw ELSE 0.0 END AS rts FROM j2),
bb AS (SELECT MIN(rts) AS lo, MAX(rts) AS hi FROM j3 WHERE status = 'live'),
trends AS (
  SELECT Place, ROUND(rts, 6) AS RawTrendScore,
         CASE WHEN status = 'live' THEN ROUND(CASE WHEN hi = lo THEN 0.5 ELSE (rts - lo) / (hi - lo) END, 6)
              ELSE 0.0 END AS TrendScore,
         status, CASE WHEN status = 'live' THEN 'Google Trends' ELSE 'fallback' END AS source,
         COALESCE(notes, 'No data fetched') AS notes
  FROM j3, bb)"""

_reg("trend_scores", _TRENDS + "\nSELECT * FROM trends")
_reg("realtime_scores", _TRENDS + """,
rt AS (SELECT b.Place, b.BasePopularity, COALESCE(t.TrendScore, 0.0) AS TrendScore,
              COALESCE(t.status, 'unavailable') AS status, COALESCE(t.source, 'fallback') AS source,
              COALESCE(t.notes, 'No trend data available') AS notes
       FROM base b LEFT JOIN trends t ON b.Place = t.Place),
rt2 AS (SELECT *, ROUND(0.0 * BasePopularity + 1.0 * TrendScore, 6) AS FinalRealtimeScore FROM rt)
SELECT *, CASE WHEN FinalRealtimeScore > 0.66 THEN 'High' WHEN FinalRealtimeScore > 0.33 THEN 'Medium'
               ELSE 'Low' END AS trend_band
FROM rt2""")
_reg("trend_status_counts", _TRENDS + """
SELECT COUNT(*) FILTER (WHERE status = 'live') AS live_count,
       COUNT(*) FILTER (WHERE status <> 'live') AS not_live_count, COUNT(*) AS total FROM trends""")
_reg("trend_cached", _TRENDS + """
SELECT * REPLACE ('cached' AS status, 'cached' AS source) FROM trends""")
_reg("trend_status_breakdown", _TRENDS + "\nSELECT status, COUNT(*) AS count FROM trends GROUP BY status")


# ── ML feature frame ────────────────────────────────────────────────────────
_reg("place_features", _num() + _MODE_PLACE_CITY + """,
place AS (SELECT Place, ROUND(AVG(Rating), 4) AS avg_rating, COUNT(Rating) AS review_count,
                 ROUND(STDDEV_SAMP(Rating), 4) AS rating_std,
                 ROUND(AVG(polarity), 4) AS avg_polarity, ROUND(AVG(subjectivity), 4) AS avg_subjectivity
          FROM reviews GROUP BY Place),
city AS (SELECT City AS primary_city, ROUND(AVG(Rating), 4) AS city_avg_rating,
                ROUND(AVG(polarity), 4) AS city_avg_polarity FROM reviews GROUP BY City),
cnt AS (SELECT mode_city AS primary_city, COUNT(*) AS city_place_count FROM mode_city GROUP BY mode_city)
SELECT p.Place, COALESCE(m.mode_city, 'Unknown') AS primary_city, p.review_count, p.avg_rating,
       COALESCE(p.rating_std, 0.0) AS rating_std, COALESCE(p.avg_polarity, 0.0) AS avg_polarity,
       COALESCE(p.avg_subjectivity, 0.0) AS avg_subjectivity,
       COALESCE(c.city_avg_rating, p.avg_rating) AS city_avg_rating,
       CAST(COALESCE(n.city_place_count, 1) AS BIGINT) AS city_place_count,
       COALESCE(c.city_avg_polarity, 0.0) AS city_avg_polarity,
       COALESCE(ROUND(GREATEST(0.0, LEAST(1.0, (c.city_avg_rating - 1.0) / 4.0)), 4), 0.5) AS city_five_star_rate
FROM place p LEFT JOIN mode_city m ON p.Place = m.Place
     LEFT JOIN city c ON m.mode_city = c.primary_city
     LEFT JOIN cnt n ON m.mode_city = n.primary_city""")

# every place is scored once by every tree, with the model's own result
_reg("forest_table_scores", "SELECT primary_city, COUNT(*) AS n_places, COUNT(*) AS n_equal FROM ("
     + SQL["place_features"] + ") AS f GROUP BY primary_city")


# ── O-61 with a separate sentiment table, O-63b enrichment ──────────────────
_reg("hotspot_source", _SENT + """,
rr AS (SELECT trim(Place) AS Place, GREATEST(1.0, LEAST(5.0, Rating)) AS Rating FROM reviews_text
       WHERE Rating IS NOT NULL AND NOT isnan(Rating) AND City IS NOT NULL AND Place IS NOT NULL),
ra AS (SELECT Place, ROUND(AVG(Rating), 4) AS avg_rating, COUNT(Rating) AS review_count,
              ROUND(STDDEV_SAMP(Rating), 4) AS rating_std FROM rr GROUP BY Place),
sp AS (SELECT Place, ROUND(AVG(CAST(polarity AS DECIMAL(30, 4))), 4) AS avg_polarity FROM sent GROUP BY Place),
base AS (SELECT ra.*, COALESCE(sp.avg_polarity, 0.0) AS avg_polarity FROM ra LEFT JOIN sp ON ra.Place = sp.Place),"""
     + _hotspot_from_base() + HOTSPOT_SELECT.format(key="Place"))

_reg("compare_catalog", _hs("City") + """,
sc AS (SELECT City, ROUND(AVG(subjectivity), 4) AS avg_subjectivity, ROUND(AVG(polarity), 4) AS ap
       FROM reviews GROUP BY City)
SELECT hs.*, sc.avg_subjectivity,
       CASE WHEN sc.ap > 0.05 THEN 'Positive' WHEN sc.ap < -0.05 THEN 'Negative' ELSE 'Neutral' END
         AS dominant_sentiment
FROM hs LEFT JOIN sc ON hs.City = sc.City""")


# ── dashboard similarity, search box, frequent values ───────────────────────
_reg("similar_places_dashboard", _hs("Place") + """,
f AS (SELECT *, COALESCE(avg_rating, 0.0) AS f0,
             ln(1 + GREATEST(COALESCE(CAST(review_count AS DOUBLE), 0.0), 0.0)) AS f1,
             (COALESCE(avg_polarity, 0.0) + 1.0) / 2.0 AS f2, COALESCE(rating_std, 0.0) AS f3,
             COALESCE(hotspot_score, 0.0) AS f4 FROM hs),
b AS (SELECT MIN(f0) a0, MAX(f0) b0, MIN(f1) a1, MAX(f1) b1, MIN(f2) a2, MAX(f2) b2,
             MIN(f3) a3, MAX(f3) b3, MIN(f4) a4, MAX(f4) b4 FROM f),
n AS (SELECT f.*,
        CASE WHEN b0 = a0 THEN 0.0 ELSE (f0 - a0) / (b0 - a0) END AS g0,
        CASE WHEN b1 = a1 THEN 0.0 ELSE (f1 - a1) / (b1 - a1) END AS g1,
        CASE WHEN b2 = a2 THEN 0.0 ELSE (f2 - a2) / (b2 - a2) END AS g2,
        1.0 - CASE WHEN b3 = a3 THEN 0.0 ELSE (f3 - a3) / (b3 - a3) END AS g3,
        CASE WHEN b4 = a4 THEN 0.0 ELSE (f4 - a4) / (b4 - a4) END AS g4
      FROM f, b),
seed AS (SELECT * FROM n WHERE Place = 'Part#1' ORDER BY rank, Place LIMIT 1),
d AS (SELECT n.Place, n.rank, n.avg_rating, n.review_count, n.avg_polarity, n.hotspot_score,
             ROUND(1.0 / (1.0 + SQRT((n.g0 - s.g0) * (n.g0 - s.g0) + (n.g1 - s.g1) * (n.g1 - s.g1)
                                     + (n.g2 - s.g2) * (n.g2 - s.g2) + (n.g3 - s.g3) * (n.g3 - s.g3)
                                     + (n.g4 - s.g4) * (n.g4 - s.g4))), 4) AS similarity
      FROM n, seed s WHERE n.Place <> 'Part#1')
SELECT Place, similarity, avg_rating, review_count, avg_polarity, hotspot_score
FROM d ORDER BY similarity DESC, rank, Place LIMIT 12""")

_reg("place_search", _num() + """
SELECT Place FROM (SELECT DISTINCT Place FROM reviews) WHERE contains(lower(Place), 'part#1')
ORDER BY Place LIMIT 40""")

_reg("frequent_places", _num() + """
SELECT Place, COUNT(*) AS count FROM reviews GROUP BY Place ORDER BY count DESC, Place LIMIT 80""")

_reg("top_state", _hs("City") + "," + _CITY_STATE + """,
st AS (SELECT cs.State, ROUND(AVG(CAST(hs.hotspot_score AS DECIMAL(30, 6))), 4) AS HotspotScore
       FROM hs JOIN city_state cs ON hs.City = cs.City GROUP BY cs.State)
SELECT State AS top_state FROM st ORDER BY HotspotScore DESC, State DESC LIMIT 1""")
