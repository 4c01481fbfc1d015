"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

``queries`` and ``value`` are first runs; ``second_run`` repeats each query in the same session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathom.catalog import all_queries, inputs
from fathom.catalog.crawl_queries import new_folder
from fathom.catalog.search_queries import PATTERNS
from fathom.operators import term_grams
from fathom.operators.index import build_postings
from fathom.operators.search import search
from fathom.sources import page_store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["i1_build_postings", "q24_search", "q13_phrase", "q9_wildcard_terms", "e8_extract_pages",
         "g1_link_edges", "g2_intra_site_depth", "g8_robots_allowed", "g12_robots_as_of", "p1_upsert_pages",
         "p2_collapse_fetches", "b1_rate_limit", "b3_submit_urls", "a1_bandwidth_running", "a2_queue_running", "q8_nested", "q24_text"]


def timed(work) -> float:
    begin = time.perf_counter()
    work()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    queries, seconds, second = all_queries(), {}, {}
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    run(spark.range(1000).selectExpr("sum(id)"))
    for name in NAMES:
        if not only or name in only:
            seconds[name], second[name] = (timed(lambda: run(queries[name](spark, SF_DIR))) for _ in range(2))
            print(name, seconds[name], second[name], file=sys.stderr, flush=True)
    if not only:
        # A stored index, built once and searched twice.
        pages, path = inputs.doc_pages(spark, SF_DIR), new_folder(spark, "bench")
        at = F.lit(inputs.NOW).cast("timestamp")
        seconds["pages_write"] = timed(lambda: page_store.write_pages(pages.withColumns(
            {"created_at": at, "last_updated": at, "dead_since": F.lit(None).cast("timestamp")}), f"{path}/pages", buckets=16))
        seconds["index_write"] = timed(lambda: page_store.write_index(
            build_postings(pages), f"{path}/index", buckets=16))
        seconds["index_write_extras"] = timed(lambda: page_store.write_index(
            build_postings(pages, fields=("content",)), f"{path}/blocks", buckets=16, extras=True))
        for name, place in (("search_stored", "index"), ("search_blocks", "blocks")):
            seconds[name], second[name] = (timed(lambda: run(search(
                inputs.queries_table(spark), lambda keys: page_store.read_pages_of(spark, f"{path}/pages", keys),
                index=page_store.read_index(spark, f"{path}/{place}")))) for _ in range(2))
        patterns = spark.createDataFrame(PATTERNS, "query_id int, field string, pattern string").filter("field = 'content'")
        ix = page_store.read_index(spark, f"{path}/blocks")
        seconds["wildcards_stored"] = timed(lambda: run(term_grams.wildcard_terms(patterns, ix.grams, ix.dictionary)))
        seconds["st1_stream_ingest"] = timed(lambda: run(queries["st1_stream_ingest"](spark, SF_DIR)))
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "second_run": second, "sf": SF_DIR.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
