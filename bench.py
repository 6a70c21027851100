"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf", ...}.
Each query is executed completely (``noop`` sink: every row is produced,
nothing is collected to the driver).  The corpus is parsed once into the
staged node table (timed as ``html_nodes``); later queries read it, as a
pipeline run would.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "page_summary",
    "generic_page",
    "categorize_links",
    "link_filters",
    "bfs_pages",
    "title_detail",
    "sections",
    "main_content",
    "interactive_sections",
    "listing_links",
    "enrich_pages",
    "validate_records",
    "job_latest",
    "stream_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from pagefold.plans.registry import QUERIES, load_all
    from pagefold.plans.stage import corpus_nodes
    from pagefold.session import build_session

    spark = build_session(app="pagefold-bench")
    load_all()
    times: dict[str, float] = {}
    t0 = time.time()
    corpus_nodes(spark, sf_dir, "generic")
    times["html_nodes"] = round(time.time() - t0, 3)
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for key in HEADLINE:
        t = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "pages": n_pages,
        "pages_per_sec_parse": round(n_pages / times["html_nodes"], 1) if times["html_nodes"] else None,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
