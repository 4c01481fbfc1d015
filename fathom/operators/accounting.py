"""Bandwidth and queue reports over the crawl log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import config
from fathom.plans.skew import running_sum

# Lengths of the time slots of running totals, from coarse to fine.
SLOTS_S = (3600, 60, 1)


def _seconds_in(start: Column) -> Column:
    return F.unix_micros("ts") - F.unix_micros(start)


def _slots(lengths: tuple[int, ...]) -> list[Column]:
    return [F.floor(F.unix_seconds("ts") / F.lit(n)) for n in lengths]


def with_interval(log: DataFrame, start: Column, interval_s: int) -> DataFrame:
    """Adds ``interval_no`` (0 at the crawl's start) and ``interval_start``."""
    step = interval_s * 1_000_000
    no = F.floor(_seconds_in(start) / F.lit(step))
    return log.withColumn("interval_no", no).withColumn(
        "interval_start", F.timestamp_micros(F.unix_micros(start) + F.col("interval_no") * step))


def bandwidth_report(log: DataFrame, start: Column, limit: int = config.BANDWIDTH_LIMIT,
                     interval_s: int = config.BANDWIDTH_INTERVAL_S) -> DataFrame:
    """Bytes per interval from the crawl's start, and whether the budget was exceeded."""
    total = F.sum(F.col("in_bytes") + F.col("out_bytes"))
    return with_interval(log, start, interval_s).groupBy("interval_no", "interval_start").agg(
        F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), total.alias("total_bytes"),
        (total > limit).alias("over_limit"))


def bandwidth_running(log: DataFrame, start: Column, limit: int = config.BANDWIDTH_LIMIT,
                      interval_s: int = config.BANDWIDTH_INTERVAL_S, slots_s: tuple[int, ...] = SLOTS_S) -> DataFrame:
    """Per response: bytes so far in its interval, whether they exceed the budget, seconds to the next interval."""
    rows = running_sum(with_interval(log, start, interval_s), ["interval_no"], _slots(slots_s), [F.col("ts"), F.col("id")],
                       F.col("in_bytes") + F.col("out_bytes"), "running_bytes")
    left = F.unix_micros("interval_start") + interval_s * 1_000_000 - F.unix_micros("ts")
    return rows.withColumn("over_limit", F.col("running_bytes") > limit).withColumn(
        "seconds_left", F.floor(left / F.lit(1_000_000)))


def queue_change() -> Column:
    return F.when(F.col("kind") == "scheduled", 1).when(F.col("kind") == "dropped", -1).otherwise(0)


def queue_totals(log: DataFrame) -> DataFrame:
    """Requests in the queue per host: scheduled minus dropped."""
    return log.filter(F.col("kind").isin("scheduled", "dropped")).groupBy("netloc").agg(F.sum(queue_change()).alias("total"))


def queue_running(log: DataFrame, slots_s: tuple[int, ...] = SLOTS_S) -> DataFrame:
    """The same after each event."""
    events = log.filter(F.col("kind").isin("scheduled", "dropped"))
    return running_sum(events, ["netloc"], _slots(slots_s), [F.col("ts"), F.col("id")], queue_change(), "total")


def crawl_counts(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Pages at depth 0 and number of robots fetches."""
    counts = pages.filter("depth = 0").select(F.lit("depth_0_pages").alias("counter")).unionByName(
        log.filter("kind = 'robots'").select(F.lit("robots_fetches").alias("counter")))
    return counts.groupBy("counter").agg(F.count("*").alias("n"))
