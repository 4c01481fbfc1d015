"""The batch operators as Structured Streaming jobs.

Sinks are written per micro-batch under the batch's number, so a batch that is run again after a failure replaces what
it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom import config
from fathom.functions import urls
from fathom.operators.accounting import queue_change
from fathom.operators.extract import extract_pages
from fathom.operators.index import build_postings, exact_terms
from fathom.operators.ingest import CrawlRules, screened
from fathom.operators.pages import collapse_fetches
from fathom.operators.submissions import rate_limit
from fathom.operators.url_filters import fingerprint
from fathom.plans.lineage import cut_lineage
from fathom.sources import page_store

BatchWork = Callable[[DataFrame, int], None]


def start(stream: DataFrame, work: BatchWork, checkpoint: str, mode: str = "append",
          trigger: dict | None = None) -> StreamingQuery:
    """Run ``work`` on each micro-batch; by default over what is there, then stop."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_by_key(path: str, keys: list[str], buckets: int = page_store.BUCKETS) -> BatchWork:
    """Sink for update mode: a table with the last row of each key. A batch reads and writes the buckets of its own keys."""
    def work(df: DataFrame, batch_id: int) -> None:
        # Written once: the batch is read for its buckets, for the rows that it replaces, and for the rows themselves.
        page_store.upsert_rows(cut_lineage(df), path, keys, buckets)
    return work


def into_parquet(path: str) -> BatchWork:
    def work(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return work


def ingest(path: str, index_path: str | None = None, buckets: int = page_store.BUCKETS, rules: CrawlRules | None = None,
           requests_path: str | None = None) -> BatchWork:
    """Filter fetched pages by ``rules``, extract them, collapse them per URL and upsert them; optionally bring the index up to
    date with the changed documents. Root pages to be asked for instead of template pages go to ``requests_path``.
    """
    def work(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if rules is not None:
            df, instead = screened(df, rules)
            if requests_path is not None:
                instead.write.mode("overwrite").parquet(f"{requests_path}/batch={batch_id}")
        # Decides only between fetches of the same moment; a hash of the content is the same in a second run.
        records = extract_pages(df).withColumn("seq", F.xxhash64("title", "content"))
        batch = collapse_fetches(records)
        page_store.upsert_into(batch, path, buckets)
        if index_path is not None:
            changed = df.select("url").distinct()
            pages = page_store.read_pages_of(spark, path, changed).drop("url_bucket")
            postings = build_postings(pages).unionByName(exact_terms(pages))
            page_store.update_index(postings, changed.withColumnRenamed("url", "doc"), index_path, buckets)
    return work


def stream_ingest(fetches: DataFrame, path: str, checkpoint: str, index_path: str | None = None,
                  buckets: int = page_store.BUCKETS, trigger: dict | None = None, rules: CrawlRules | None = None,
                  requests_path: str | None = None) -> StreamingQuery:
    return start(fetches, ingest(path, index_path, buckets, rules, requests_path), checkpoint, trigger=trigger)


def limited(out: str, state: str, limit_s: int = config.RATE_LIMIT_S) -> BatchWork:
    """Rate limit with the last accepted time per client carried from batch to batch.

    The state of batch n is read from the folder of batch n-1. Clients whose last time is older than the limit no longer
    matter and leave the state. The batch operator spreads one busy client over many tasks.
    """
    schema = "ip bigint, last_timestamp bigint"

    def work(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        last = spark.createDataFrame([], schema)
        if batch_id > 0:
            last = spark.read.schema(schema).parquet(f"{state}/batch={batch_id - 1}")
        target = f"{out}/batch={batch_id}"
        rate_limit(df, limit_s, last=last).write.mode("overwrite").parquet(target)
        done = spark.read.parquet(target)
        newest = done.agg(F.max("timestamp").alias("newest"))
        times = done.filter("accepted").select("ip", F.col("timestamp").alias("last_timestamp")).unionByName(last)
        kept = times.groupBy("ip").agg(F.max("last_timestamp").alias("last_timestamp"))
        # One row: the newest time of the batch.
        kept = kept.join(F.broadcast(newest), F.col("newest").isNull() | (
            F.col("last_timestamp") > F.col("newest") - limit_s)).drop("newest")
        kept.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return work


def stream_rate_limit(subs: DataFrame, out: str, state: str, checkpoint: str, limit_s: int = config.RATE_LIMIT_S,
                      trigger: dict | None = None) -> StreamingQuery:
    return start(subs, limited(out, state, limit_s), checkpoint, trigger=trigger)


def stream_bandwidth(log: DataFrame, start_at: str, limit: int = config.BANDWIDTH_LIMIT,
                     interval_s: int = config.BANDWIDTH_INTERVAL_S, lateness: str = "1 hour") -> DataFrame:
    """Bytes per interval counted from the crawl's start; rows later than ``lateness`` are dropped."""
    offset = F.window("ts", f"{interval_s} seconds", startTime=f"{_offset(start_at, interval_s)} seconds")
    total = F.sum(F.col("in_bytes") + F.col("out_bytes"))
    return log.withWatermark("ts", lateness).groupBy(offset.alias("w")).agg(
        F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), total.alias("total_bytes"),
        (total > limit).alias("over_limit")).select(
        F.col("w.start").alias("interval_start"), "in_bytes", "out_bytes", "total_bytes", "over_limit")


def _offset(start_at: str, interval_s: int) -> int:
    """Seconds from the window grid (which starts in 1970) to the crawl's start."""
    from datetime import datetime, timezone

    at = datetime.fromisoformat(start_at).replace(tzinfo=timezone.utc)
    return int(at.timestamp()) % interval_s


def stream_queue_totals(log: DataFrame) -> DataFrame:
    """Scheduled minus dropped per host, to be written in update mode."""
    events = log.filter(F.col("kind").isin("scheduled", "dropped"))
    return events.groupBy("netloc").agg(F.sum(queue_change()).alias("total"))


def drained(subs: DataFrame) -> DataFrame:
    """Pending submissions as requests: first in line, never filtered, with fresh robots rules."""
    return subs.select(
        "id", urls.url_origin(F.col("url")).alias("url"), F.lit(1).alias("priority"), F.lit(True).alias("dont_filter"),
        F.lit(True).alias("refresh_robots")).filter("url is not null")


def stream_drain(subs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Move everything pending to the frontier once; the checkpoint remembers what was taken."""
    return start(drained(subs), into_parquet(out), checkpoint)


def stream_dedupe(requests: DataFrame, time: str, horizon: str = "1 day") -> DataFrame:
    """First request per fingerprint within ``horizon``; requests marked ``dont_filter`` have a key of their own."""
    key = F.when(F.col("dont_filter"), F.concat(F.lit("own:"), F.col("seq").cast("string"))).otherwise(
        fingerprint(F.col("url"), F.col("normalised")))
    return requests.withColumn("__fp", key).withWatermark(time, horizon).dropDuplicatesWithinWatermark(
        ["__fp"]).drop("__fp")
