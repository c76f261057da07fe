"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced to full evaluation with the ``noop`` sink (scan,
joins, every aggregate and the sort), once to warm up and then timed
``BENCH_REPEATS`` times; the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans import analysis, destinations, load, ml, text, trends  # noqa: E402
from revlens.session import get_session  # noqa: E402
from revlens.sources import testdata as td  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = {
    # the reference's published benchmark: group reviews by city
    "city_groupby": lambda s, d: load.city_load_query(td.reviews_num(s, d)),
    "hotspot_city": destinations.hotspot_city,
    "hotspot_place": destinations.hotspot_place,
    "dataset_summary": analysis.dataset_summary,
    "city_metrics": analysis.city_metrics,
    "top_places": analysis.top_places,
    "place_ranks": analysis.place_ranks,
    "state_metrics": analysis.state_metrics,
    "state_top_places": destinations.state_top_places,
    "similar_places": destinations.similar_places,
    "place_insights": destinations.place_insights,
    "sentiment_results": text.sentiment_results,
    "aspect_mentions_all": text.aspect_mentions_all,
    "review_search_summary": text.review_search_summary,
    "trend_scores": trends.trend_scores,
    "place_features": ml.place_features,
}


def main() -> None:
    spark = get_session(f"local[{CPUS}]", shuffle_partitions=2 * CPUS, app_name="revlens-bench",
                        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                               "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    results = {}
    for name, fn in HEADLINE.items():
        load.run_timed(fn(spark, SF_DIR))  # warm-up (JIT, file listing, broadcast build)
        times = []
        for _ in range(REPEATS):
            t0 = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 4)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median",
        "value": round(sum(results.values()), 4),
        "unit": "sec",
        "queries": results,
        "sf": sf,
        "cpus": CPUS,
        "repeats": REPEATS,
        "hardware": f"{platform.machine()} {os.cpu_count()} cores, local[{CPUS}] single JVM",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
