"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose tables and cores. Web documents are
derived and written before the clock starts: engines read them from storage.
Every query's result is written to the no-op sink, so all rows and columns are
computed. ``queries`` has the times of the first run of each, ``warm`` those of a
second (but for the streams), when code is compiled.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "normalize_text",
    "keyword_search",
    "iso_dates",
    "url_parts",
    "page_titles",
    "page_metadata",
    "sitemap_entries",
    "sitemap_budget",
    "robots_verdict",
    "interleave_cap",
    "interleave_all",
    "keep_first",
    "first_success",
    "discover",
    "resolve_articles",
    "search",
    "search_many",
    "search_table",
    "search_funnel",
    "append_new",
    "upsert",
    "stream_entries",
    "stream_articles",
)


def main() -> None:
    from presscan import build_session
    from workloads import derived
    from workloads.registry import QUERIES

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=CPUS,
        spark__sql__files__maxPartitionBytes=str(4 << 20),
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    derived.documents_table(spark, SF_DIR)
    derived.sites_table(spark, SF_DIR)
    derived.article_pages_table(spark, SF_DIR)
    derived.written(spark, SF_DIR, "url_sets", derived.url_sets)

    def timed(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    seconds = {name: timed(name) for name in HEADLINE}
    warm = {name: timed(name) for name in HEADLINE if not name.startswith("stream")}
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": seconds, "warm": warm, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
