"""Registered queries: the streaming jobs, run over the given tables as streams; results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.catalog import crawl_queries as cq
from fathom.catalog import inputs as inp
from fathom.catalog import url_queries as uq
from fathom.functions import urls
from fathom.operators.accounting import with_interval
from fathom.sources import page_store
from fathom.streaming import jobs, keyed


PARTS = 4
#: Files of a micro-batch, each written by a task of its own.
FILES = 8


def _source(spark, sf, name):
    """The table as a stream of ``PARTS`` micro-batches, in the order of time or key: one read, one write of files in that order.

    The file source takes files by their time, so they get times in the order of their names. Rows of one moment are dealt by a hash.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    key = {"events": "ts", "pages": "page_id"}[name]
    place = cq.new_folder(spark, "source")
    df.repartitionByRange(PARTS * FILES, F.col(key), F.xxhash64(*df.columns)).write.parquet(place)
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    first = min((s.getModificationTime() for s in files), default=0) - 1000 * len(files)
    for i, status in enumerate(files):
        fs.setTimes(status.getPath(), first + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(place)


class _StreamTables:
    """Lets the derivations of the batch queries read a table as a stream."""

    def __enter__(self):
        self.batch = inp.table
        inp.table = _source

    def __exit__(self, *_):
        inp.table = self.batch


def _derived(fn, *args):
    with _StreamTables():
        return fn(*args)


def _work(spark) -> str:
    return cq.new_folder(spark, "stream")


def _written(spark, path, schema):
    """What the micro-batches wrote; no folder was made if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def _run(spark, stream):
    """Run over all that is there, into parquet, and read that back."""
    work = _work(spark)
    jobs.start(stream, jobs.into_parquet(f"{work}/out"), f"{work}/checkpoint").awaitTermination()
    return _written(spark, f"{work}/out", T.StructType(stream.schema.fields))


def _latest(spark, stream, keys):
    """The same in update mode: the last row of each key."""
    work = _work(spark)
    jobs.start(stream, jobs.latest_by_key(f"{work}/out", keys, buckets=8), f"{work}/checkpoint", "update").awaitTermination()
    return page_store.read_rows(spark, f"{work}/out", T.StructType(stream.schema.fields))


def st1(spark, sf):
    work = _work(spark)
    stream = _derived(inp.fetches, spark, sf)
    jobs.stream_ingest(stream, f"{work}/pages", f"{work}/checkpoint", buckets=8).awaitTermination()
    return page_store.read_pages(spark, f"{work}/pages")


def _submissions(spark, sf):
    e = _source(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.expr(cq.SUB_URL).alias("url"), F.col("user_id").alias("ip"),
                    F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"))


def st2(spark, sf):
    work = _work(spark)
    jobs.stream_rate_limit(_submissions(spark, sf), f"{work}/out", f"{work}/state", f"{work}/checkpoint",
                           7200).awaitTermination()
    kind = "id bigint, ip bigint, accepted boolean, wait_s bigint"
    return _written(spark, f"{work}/out", T.StructType.fromDDL(kind))


def st2_keyed(spark, sf):
    """The same by state per client."""
    return _run(spark, keyed.keyed_rate_limit(_submissions(spark, sf), 7200)).select("id", "ip", "accepted", "wait_s")


def st3(spark, sf):
    sums = jobs.stream_bandwidth(_derived(cq.crawl_log, spark, sf), cq.CRAWL_START, 3_000_000)
    found = with_interval(_latest(spark, sums, ["interval_start"]).withColumnRenamed("interval_start", "ts"), cq._start(), 604800)
    return found.drop("ts")


def st4(spark, sf):
    return _latest(spark, jobs.stream_queue_totals(_derived(cq.crawl_log, spark, sf)), ["netloc"])


def st5(spark, sf):
    work, pending = _work(spark), _submissions(spark, sf)
    for _ in range(2):  # the second run finds nothing left
        jobs.stream_drain(pending, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _written(spark, f"{work}/out", T.StructType(jobs.drained(pending).schema.fields))


def st6(spark, sf):
    asked = _derived(uq.requests, spark, sf).withColumn("at", F.lit(inp.NOW).cast("timestamp"))
    kept = _run(spark, jobs.stream_dedupe(asked, "at"))
    # Which of several spellings in one batch stays is not fixed; their normal form is.
    return kept.select(urls.canonical_url(F.col("url")).alias("url"), "normalised", "dont_filter")


QUERIES = {"st1_stream_ingest": st1, "st2_stream_rate_limit": st2, "st2_keyed_rate_limit": st2_keyed, "st3_stream_bandwidth": st3,
           "st4_stream_queue_totals": st4, "st5_stream_drain": st5, "st6_stream_dedupe": st6}

ORACLE = {
    "st1_stream_ingest": uq.ORACLE["e8_extract_pages"],
    "st2_stream_rate_limit": cq.ORACLE["b1_rate_limit"],
    "st2_keyed_rate_limit": cq.ORACLE["b1_rate_limit"],
    "st3_stream_bandwidth": cq.ORACLE["a1_bandwidth_report"],
    "st4_stream_queue_totals": cq.ORACLE["a2_queue_totals"],
    "st5_stream_drain": f"""SELECT id, {cq._ORIGIN} AS url, 1 AS priority, true AS dont_filter, true AS refresh_robots
        FROM {cq._SUBS_SQL} WHERE url <> 'no url'""",
    "st6_stream_dedupe": f"""SELECT {inp.sql_canonical('url')} AS url, normalised, dont_filter
        FROM ({uq.ORACLE['u9_dedupe_requests']}) AS kept""",
}
