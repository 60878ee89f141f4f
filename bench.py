"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run to a sink that takes all rows and columns, so nothing is pruned away. One query is run first, to
start the workers; then each counts once, planning included.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee.plans import registry
from marquee.session import local_session

HEADLINE = [
    "upcoming", "display_fields", "facet_categories", "facet_neighborhoods", "catalog_facts", "catalog_manifest",
    "duplicate_groups", "dedupe_keep_first", "feed_page", "unique_urls", "price_distribution", "venue_priors",
    "point_in_polygon", "resolve_neighborhood", "merge_venue_batch", "merge_by_url_city_api", "insert_only",
    "enrich", "card_price", "page_price", "parse_date_range", "classify_labels", "recategorize",
    "semantic_category", "extract_keywords", "search_feed", "nearest", "rank_candidates", "flag_injection",
    "validate_messages", "metrics", "sessions", "flatten_ticketing_api", "pages_dated_links", "pages_time_tag_events",
    "page_visible_text", "sweep_floor",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores=cpus)
    queries = registry.queries()
    queries["facet_neighborhoods"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
