"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from offermill.plans.catalog import QUERIES  # noqa: E402
from offermill.session import local_session  # noqa: E402

HEADLINE = [
    "nearby_ranked", "nearby_batch", "geo_radius_join", "rank_all_deals", "search_deals", "deal_details", "reports_summary",
    "city_status", "venue_details", "normalize_offers", "deduplicate_offers", "extract_candidates", "ingest_fields",
    "change_detection", "upsert_deals", "ingest_listings", "url_duplicates", "apply_reports", "report_actions",
    "merge_deals", "page_candidates", "clean_documents", "venue_pairs_same_city",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    wanted = sys.argv[1:] or HEADLINE
    QUERIES["deals_by_category"](spark, sf_dir).count()  # start-up is not a query
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
