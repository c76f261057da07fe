"""Values that must equal the reviewed application's for equal results."""

# ── Fixed values ────────────────────────────────────────────────────────────
RATING_MIN, RATING_MAX = 1.0, 5.0                  # rating clamp
POLARITY_POSITIVE, POLARITY_NEGATIVE = 0.05, -0.05  # label bounds (strict)
HOTSPOT_WEIGHTS = (0.5, 0.3, 0.2)                  # rating, volume, sentiment
HIDDEN_GEM_WEIGHTS = (0.36, 0.28, 0.20, 0.16)      # rating, sentiment, consistency, low volume
RISK_WEIGHTS = (0.35, 0.25, 0.25, 0.15)            # volume, 1 - rating, 1 - sentiment, rating std
HIDDEN_GEM_REVIEWS = (30, 1200)                    # review-count window of the hidden-gem list
RISK_MIN_REVIEWS = 800                             # minimum reviews of the risk list
INSIGHT_LIST_SIZE = 25                             # hidden-gem and risk list length
TOP_N = 20                                         # top cities / places
CITY_MIN_REVIEWS, PLACE_MIN_REVIEWS = 100, 10      # strict minimum for the ranked top-n
STATE_TOP_DEFAULT = 10                             # per-state top-n
SIMILAR_DEFAULT = 10                               # similar places returned
HISTOGRAM_BINS = 50
SEARCH_LIMIT = 50                                  # matching reviews returned
TEXT_PREVIEW_CHARS = 400
NAME_SEARCH_LIMIT = 40
FREQUENT_VALUES = 80
MAP_MIN_WEIGHT = 0.05                              # heat weight floor
MAP_RADIUS = (6.0, 22.0)                           # base, scale of the marker radius
SCALED_BANDS = (0.33, 0.66)                        # low < 0.33 <= mid < 0.66 <= high
RATING_BANDS = (3.0, 4.0)                          # low < 3 <= mid < 4 <= high
TREND_BANDS = (0.33, 0.66)                         # Low <= 0.33 < Medium <= 0.66 < High
TREND_MONTHS = 3                                   # interest window before the latest record
TREND_WEIGHTS = (0.0, 1.0)                         # existing score, trend score
LIVE_ZERO_RANGE = 0.5                              # trend min-max value when all live scores are equal
FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 8, "seed": 42}
CV_TREES, CV_FOLDS, TEST_PERCENT = 100, 5, 20
LOAD_SAMPLE_SIZES = (100_000, 500_000, 1_000_000)  # plus the full table
# ── end of fixed values ─────────────────────────────────────────────────────
STATE_MAP_COLUMNS = {"ReviewCount": "total_reviews", "AverageRating": "avg_rating", "HotspotScore": "avg_hotspot_score",
                     "SentimentScore": "avg_polarity", "NumCities": "num_cities"}
