"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Every query is built, planned and run over its whole result
once, so the times include planning.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobsieve.plans.catalog import QUERIES  # noqa: E402
from jobsieve.session import local_session  # noqa: E402

HEADLINE = (
    "clean_text", "parse_headcount", "classify_role", "dedupe_postings", "valid_record",
    "curated_postings", "enrich_headcount", "upsert_postings", "new_vs_existing", "keyword_match",
    "category_overview", "store_stats", "run_stats", "recent_postings", "search_roles",
    "early_stop_prefix", "application_rownum", "route_master_tabs", "feed_a_postings",
    "feed_b_postings", "extract_jsonld", "extract_cards", "extract_tables", "stream_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr)
    line = {
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
