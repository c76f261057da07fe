"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from revlens.plans import analysis as an
from revlens.plans import destinations as dest
from revlens.plans import ml
from revlens.plans import text as tx
from revlens.plans import trends as tr

QUERIES = {
    # scoring core
    "hotspot_city": dest.hotspot_city,
    "hotspot_place": dest.hotspot_place,
    "state_hotspots": dest.state_hotspots,
    "reweighted_city_ranks": dest.reweighted_city_ranks,
    "zero_weight_ranks": dest.zero_weight_ranks,
    "comparison_chosen": dest.comparison_chosen,
    "place_insights_predicted": dest.place_insights_predicted,
    "place_insights": dest.place_insights,
    "hidden_gems": dest.hidden_gems,
    "risk_places": dest.risk_places,
    "risk_places_small": dest.risk_places_small,
    "place_insights_sentiment": dest.place_insights_sentiment,
    "lowest_polarity_places": dest.lowest_polarity_places,
    "filter_values": dest.filter_values,
    "state_places": dest.state_places,
    "state_map_rows": dest.state_map_rows,
    "comparison_raw": dest.comparison_raw,
    "similar_places": dest.similar_places,
    "similar_to_each_place": dest.similar_to_each_place,
    "state_top_cities": dest.state_top_cities,
    "state_top_places": dest.state_top_places,
    "state_detail_summary": dest.state_detail_summary,
    "score_breakdown": dest.score_breakdown,
    "comparison": dest.comparison,
    "city_coords": dest.city_coords,
    "map_points": dest.map_points,
    "map_coverage": dest.map_coverage,
    "state_coverage": dest.state_coverage,
    "compare_catalog": dest.compare_catalog,
    "similar_places_dashboard": dest.similar_places_dashboard,
    "place_search": dest.place_search,
    "frequent_places": dest.frequent_places,
    "top_state": dest.top_state,
    # batch analysis
    "dataset_summary": an.dataset_summary,
    "dataset_profile": an.dataset_profile,
    "rating_distribution": an.rating_distribution,
    "rating_distribution_int": an.rating_distribution_int,
    "city_weighted_rating": an.city_weighted_rating,
    "top_cities": an.top_cities,
    "top_places": an.top_places,
    "city_ratings": an.city_ratings,
    "place_ratings": an.place_ratings,
    "city_metrics": an.city_metrics,
    "city_metrics_exact": an.city_metrics_exact,
    "place_metrics_enriched": an.place_metrics_enriched,
    "city_ranks": an.city_ranks,
    "place_ranks": an.place_ranks,
    "place_ranks_in_city": an.place_ranks_in_city,
    "top_ranked_cities": an.top_ranked_cities,
    "top_ranked_places": an.top_ranked_places,
    "state_metrics": an.state_metrics,
    "place_primary_city": an.place_primary_city,
    "places_per_city": an.places_per_city,
    "place_rating_histogram": an.place_rating_histogram,
    "place_rating_box": an.place_rating_box,
    "city_place_rollup": an.city_place_rollup,
    "first_reviews": an.first_reviews,
    "review_sample": an.review_sample,
    "review_sample_properties": an.review_sample_properties,
    "reviewer_sketch_error": an.reviewer_sketch_error,
    "reviewer_sketch_levels": an.reviewer_sketch_levels,
    "coerced_ratings": an.coerced_ratings,
    "csv_rejects": an.csv_rejects,
    "incremental_cities": an.incremental_cities,
    "record_export": an.record_export,
    # text
    "review_text_clean": tx.review_text_clean,
    "sentiment_results": tx.sentiment_results,
    "sentiment_common": tx.sentiment_common,
    "sentiment_common_distribution": tx.sentiment_common_distribution,
    "sentiment_by_lang": tx.sentiment_by_lang,
    "sentiment_by_source": tx.sentiment_by_source,
    "sentiment_distribution": tx.sentiment_distribution,
    "place_sentiment": tx.place_sentiment,
    "polarity_histogram": tx.polarity_histogram,
    "reviews_with_place_sentiment": tx.reviews_with_place_sentiment,
    "review_search_aspects": tx.review_search_aspects,
    "review_search_summary": tx.review_search_summary,
    "indexed_search": tx.indexed_search,
    "review_search_rows": tx.review_search_rows,
    "aspect_mentions_all": tx.aspect_mentions_all,
    "aspect_mentions_common": tx.aspect_mentions_common,
    "aspect_summary": tx.aspect_summary,
    "aspect_summary_common": tx.aspect_summary_common,
    "hotspot_source": tx.hotspot_source,
    # trends
    "trend_scores": tr.trend_scores,
    "realtime_scores": tr.realtime_scores,
    "trend_status_counts": tr.trend_status_counts,
    "trend_status_breakdown": tr.trend_status_breakdown,
    "trend_cached": tr.trend_cached,
    # popularity model
    "place_features": ml.place_features,
    "model_metrics": ml.model_metrics,
    "feature_importances": ml.feature_importances,
    "test_predictions": ml.test_predictions,
    "place_predictions": ml.place_predictions,
    "residual_histogram": ml.residual_histogram,
    "forest_table_scores": ml.forest_table_scores,
}
