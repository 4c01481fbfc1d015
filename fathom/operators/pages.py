"""One up-to-date record per URL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Policy = Callable[[Column, Column], Column]

TEXT_FIELDS = ("title", "content", "description")
# How old and new values of a known page are merged; fields without an entry take the new value.
POLICIES: dict[str, Policy] = {"depth": F.least}


def collapse_fetches(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Many fetches of a URL to the record that upserts in order would leave.

    Text comes from the last fetch that was alive, else from the very first; depth is the smallest among those. The
    columns ``has_alive`` and ``alive_depth`` tell a later upsert what may replace a known page's values. All
    aggregates combine before the shuffle, so a URL fetched very often stays one small row.
    """
    when = F.struct("last_updated", seq)
    alive = F.col("dead_since").isNull()
    texts = F.struct(*TEXT_FIELDS)
    first_depth = F.min_by("depth", when)
    last_alive = F.max(F.when(alive, F.col("last_updated")))
    grouped = records.groupBy("url").agg(
        F.coalesce(F.max_by(F.when(alive, texts), F.when(alive, when)), F.min_by(texts, when)).alias("t"),
        F.min(F.when(alive, F.col("depth"))).alias("alive_depth"),
        first_depth.alias("first_depth"), F.min("last_updated").alias("created_at"),
        F.max("last_updated").alias("last_updated"), F.max_by("dead_since", when).alias("dead_since"),
        last_alive.isNotNull().alias("has_alive"))
    return grouped.select(
        "url", F.least("alive_depth", "first_depth").alias("depth"), "t.*", "created_at", "last_updated", "dead_since",
        "has_alive", "alive_depth")


def upsert_pages(current: DataFrame, batch: DataFrame, policies: dict[str, Policy] | None = None,
                 keep_first_dead: bool = False) -> DataFrame:
    """Merge one record per URL into the page table.

    New URLs are inserted. A known page keeps its creation time; while it is dead it also keeps depth and text.
    """
    policies = POLICIES if policies is None else policies
    if "has_alive" not in batch.columns:
        batch = batch.withColumn("has_alive", F.col("dead_since").isNull()).withColumn("alive_depth", F.col("depth"))
    old, new = current.alias("old"), batch.alias("new")
    joined = old.join(new, F.col("old.url") == F.col("new.url"), "full_outer")
    known, hit = F.col("old.url").isNotNull(), F.col("new.url").isNotNull()
    alive = F.col("new.has_alive")

    def merged(field: str) -> Column:
        was, now = F.col(f"old.{field}"), F.col(f"new.{field}")
        if field == "url":
            return F.coalesce(was, now)
        if field == "created_at":
            return F.when(known, was).otherwise(now)
        candidate = F.col("new.alive_depth") if field == "depth" else now
        picked = policies[field](was, candidate) if field in policies else candidate
        if field == "depth" or field in TEXT_FIELDS:
            picked = F.when(alive, picked).otherwise(was)
        elif field == "dead_since" and keep_first_dead:
            picked = F.when(now.isNotNull() & ~alive, F.coalesce(was, now)).otherwise(picked)
        return F.when(~hit, was).when(known, picked).otherwise(now)

    return joined.select(*[merged(c).alias(c) for c in current.columns])


def delete_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    return pages.join(keys.select("url"), "url", "left_anti")
