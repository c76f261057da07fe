"""Incremental (Structured Streaming) form of the per-city rating rollup."""

from revlens.streaming.incremental import city_ratings_stream, current_city_ratings, start_city_ratings  # noqa: F401
