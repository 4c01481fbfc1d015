"""URL submissions: rate limit, uniqueness, drain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import config
from fathom.functions import urls
from fathom.plans.lineage import cut_lineage

# Length of the stretches into which one client's time line is cut, in multiples of the limit.
CHUNK_LIMITS = 24
# Stretches that are put together at a time, as a power of two.
FAN = 5
STEPS_TYPE = "struct<upto:array<bigint>,leave:array<bigint>>"


def accepted_from(secs: np.ndarray, start: int, limit: int) -> list[int]:
    """Accepted seconds of a sorted stretch, if nothing may be accepted before ``start``."""
    out, i = [], int(np.searchsorted(secs, start))
    while i < len(secs):
        out.append(int(secs[i]))
        i = int(np.searchsorted(secs, secs[i] + limit))
    return out


def _steps(secs: np.ndarray, begin: int, end: int, limit: int, anywhere: bool) -> tuple[list[int], list[int]]:
    """When the next stretch may accept, as a step function of when this one may.

    ``leave[k]`` holds for a start in ``(upto[k-1], upto[k]]``. A start lies in the first ``limit`` seconds, unless it
    comes from earlier data and may lie ``anywhere``; after the last ``upto`` nothing is accepted.
    """
    nxt = np.searchsorted(secs, secs + limit)
    leave = np.empty(len(secs), dtype=np.int64)
    for i in range(len(secs) - 1, -1, -1):
        leave[i] = leave[nxt[i]] if nxt[i] < len(secs) else max(secs[i] + limit, end)
    upto = secs
    if not anywhere:
        head = int(np.searchsorted(secs, begin + limit))
        upto = np.append(secs[:head], begin + limit)
        leave = np.append(leave[:head], leave[head] if head < len(secs) else end)
    last = np.append(leave[1:] != leave[:-1], True)
    return upto[last].tolist(), leave[last].tolist()


def _steps_udf(limit: int, span: int, anywhere: bool):
    @F.pandas_udf(STEPS_TYPE)
    def steps(chunk: pd.Series, secs: pd.Series) -> pd.DataFrame:
        rows = [_steps(np.asarray(s), c * span, (c + 1) * span, limit, anywhere) for c, s in zip(chunk, secs)]
        return pd.DataFrame(rows, columns=["upto", "leave"])

    return steps


def _accepted_udf(limit: int):
    @F.pandas_udf("array<bigint>")
    def accepted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for start, secs in batches:
            yield pd.Series([accepted_from(np.asarray(s), a, limit) for a, s in zip(start, secs)])

    return accepted


def _composed(sizes: np.ndarray, upto: np.ndarray, leave: np.ndarray, anywhere: bool) -> tuple[list[int], list[int]]:
    """One step function after the other, in time order, as a single one; ``sizes`` says how many steps each has."""
    ends = np.cumsum(sizes)
    u, v = upto[:ends[0]], leave[:ends[0]]
    for low, high in zip(ends[:-1], ends[1:]):
        next_u, next_v = upto[low:high], leave[low:high]
        at = np.searchsorted(next_u, v)
        v = np.where(at < len(next_u), next_v[np.minimum(at, len(next_u) - 1)], v)
        if anywhere:  # a start after all of the earlier stretches passes them by
            late = next_u > u[-1]
            u, v = np.append(u, next_u[late]), np.append(v, next_v[late])
        last = np.append(v[1:] != v[:-1], True)
        u, v = u[last], v[last]
    return u.tolist(), v.tolist()


def _composed_udf(anywhere: bool):
    @F.pandas_udf(STEPS_TYPE)
    def composed(sizes: pd.Series, upto: pd.Series, leave: pd.Series) -> pd.DataFrame:
        rows = [_composed(*map(np.asarray, row), anywhere) for row in zip(sizes, upto, leave)]
        return pd.DataFrame(rows, columns=["upto", "leave"])

    return composed


def _starts(nodes: Column, first: Column) -> Column:
    """Fold over the at most ``2 ** FAN`` children of a node in time order: when each may accept."""
    def follow(acc: Column, c: Column) -> Column:
        step = F.get(F.filter(F.arrays_zip(c["steps"]["upto"], c["steps"]["leave"]), lambda s: s["upto"] >= acc["may"]), F.lit(0))
        return F.struct(F.coalesce(step["leave"], acc["may"]).alias("may"), F.concat(
            acc["out"], F.array(F.struct(c["node"].alias("node"), acc["may"].alias("start")))).alias("out"))

    zero = F.struct(first.cast("bigint").alias("may"),
                    F.array().cast("array<struct<node:bigint,start:bigint>>").alias("out"))
    return F.aggregate(nodes, zero, follow, lambda acc: acc["out"])


def _stretch_starts(steps: DataFrame, who: list[str], stretches: int, first: DataFrame | None) -> DataFrame:
    """(who, node, start): when each stretch of ``steps`` (who, node, steps) may accept from.

    Step functions compose whatever the brackets, so they are put together in a tree, ``2 ** FAN`` at a time, and the starts
    handed down again: two rounds for each level, in which no row holds more than one family.
    """
    levels = 1
    while stretches > 1 << (FAN * levels):
        levels += 1
    families = []
    for level in range(levels):
        family = steps.groupBy(*who, F.shiftright("node", FAN).alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "steps"))).alias("c"))
        families.append(cut_lineage(family) if levels > 1 else family)
        if level + 1 < levels:
            parts = [F.transform("c", lambda x: F.size(x["steps"]["upto"])), F.flatten(F.transform("c", lambda x: x["steps"]["upto"])),
                     F.flatten(F.transform("c", lambda x: x["steps"]["leave"]))]
            steps = families[-1].select(*who, F.col("parent").alias("node"), _composed_udf(first is not None)(*parts).alias("steps"))
    starts = families[-1].select(*who, "c", F.lit(0).cast("bigint").alias("may"))
    if first is not None:
        starts = families[-1].join(first, "ip", "left").select(*who, "c", F.coalesce("may", F.lit(0)).cast("bigint").alias("may"))
    starts = starts.select(*who, F.inline(_starts(F.col("c"), F.col("may"))))
    for family in reversed(families[:-1]):
        given = starts.select(*who, F.col("node").alias("parent"), F.col("start").alias("may"))
        starts = family.join(given, [*who, "parent"]).select(*who, F.inline(_starts(F.col("c"), F.col("may"))))
    return starts


def rate_limit(subs: DataFrame, limit_s: int = config.RATE_LIMIT_S, drain_every_s: int | None = None,
               last: DataFrame | None = None) -> DataFrame:
    """Adds ``accepted`` and ``wait_s``. Per client in time order, a row is rejected within ``limit_s`` of the last
    accepted one; rejected rows do not count. ``last`` (ip, last_timestamp) holds what was accepted before ``subs``.

    The rule is sequential, and one client may send most of the rows. So its time line is cut into stretches of a day;
    each stretch is summarised, in parallel, as a step function from "may accept from" to the same for the next. These
    short summaries are composed in a tree. Then each stretch, knowing its start, lists its accepted seconds (at
    most one per ``limit_s``), and rows join those by time slot. The input is read twice: once for id, client and time,
    which are kept, and once for the rows.
    """
    epoch = F.lit(0) if drain_every_s is None else F.floor(F.col("timestamp") / F.lit(drain_every_s))
    if last is not None and drain_every_s is not None:
        raise ValueError("earlier rows and periodic drains exclude each other")
    if limit_s <= 0:
        return subs.withColumn("accepted", F.lit(True)).withColumn("wait_s", F.lit(0).cast("bigint"))
    span = limit_s * CHUNK_LIMITS
    who = ["ip", "__epoch"]
    rows = subs.withColumn("__epoch", epoch.cast("bigint")).withColumn(
        "__slot", F.floor(F.col("timestamp") / F.lit(limit_s)))
    narrow = cut_lineage(rows.select("id", *who, "timestamp"))
    # A second counts once per client, whatever the number of rows: at most ``span`` values per stretch.
    chunks = cut_lineage(narrow.groupBy(*who, F.floor(F.col("timestamp") / F.lit(span)).alias("chunk")).agg(
        F.sort_array(F.collect_set("timestamp")).alias("secs")))
    origin, end = chunks.agg(F.min("chunk"), F.max("chunk")).first()
    if origin is None:  # no rows
        return subs.select(*subs.columns, F.lit(False).alias("accepted"), F.lit(0).cast("bigint").alias("wait_s"))
    steps = chunks.select(*who, (F.col("chunk") - origin).alias("node"), _steps_udf(limit_s, span, last is not None)(
        "chunk", "secs").alias("steps"))
    first = None if last is None else last.select("ip", (F.col("last_timestamp") + limit_s).alias("may"))
    starts = _stretch_starts(steps, who, end - origin + 1, first).withColumn("chunk", F.col("node") + origin)
    accepted = cut_lineage(chunks.join(starts, [*who, "chunk"]).select(
        *who, F.explode(_accepted_udf(limit_s)("start", "secs")).alias("at")))
    here = F.floor(F.col("at") / F.lit(limit_s))
    known = accepted if last is None else accepted.unionByName(
        last.select("ip", F.lit(0).cast("bigint").alias("__epoch"), F.col("last_timestamp").alias("at")))
    slots = known.select(*who, "at", F.explode(F.array(here, here + 1)).alias("__slot"), here.alias("own")).groupBy(
        *who, "__slot").agg(F.max(F.when(F.col("__slot") == F.col("own"), F.col("at"))).alias("__cur"),
                            F.max(F.when(F.col("__slot") > F.col("own"), F.col("at"))).alias("__prev"))
    # The first row of each accepted second is the accepted one; it is found by its id, which spreads evenly.
    firsts = narrow.groupBy(*who, "timestamp").agg(F.min("id").alias("id")).join(
        accepted.withColumnRenamed("at", "timestamp"), [*who, "timestamp"]).select("id", F.lit(True).alias("__first"))
    seen = rows.join(slots, [*who, "__slot"], "left").join(firsts, "id", "left")
    before = F.when(F.col("__cur") <= F.col("timestamp"), F.col("__cur")).otherwise(F.col("__prev"))
    # A row older than what was accepted before has no predecessor here; it waits the full time.
    since = F.coalesce(F.col("timestamp") - before, F.lit(0))
    ok = F.coalesce("__first", F.lit(False))
    return seen.select(*subs.columns, ok.alias("accepted"),
                       F.when(ok, 0).otherwise(F.lit(limit_s) - since).cast("bigint").alias("wait_s"))


def unique_pending(subs: DataFrame, col: str = "url", drain_every_s: int | None = None) -> DataFrame:
    """Adds ``duplicate``: whether the URL was pending already. The first row per URL is found by a grouped minimum and
    marked through its id, so a URL sent very often does not gather in one task."""
    epoch = F.lit(0) if drain_every_s is None else F.floor(F.col("timestamp") / F.lit(drain_every_s))
    firsts = subs.groupBy(F.col(col), epoch.alias("__epoch")).agg(F.min_by("id", F.struct("timestamp", "id")).alias("id"))
    marked = subs.join(firsts.select("id", F.lit(False).alias("duplicate")), "id", "left")
    return marked.withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))


def submit_urls(subs: DataFrame, limit_s: int = config.RATE_LIMIT_S, drain_every_s: int | None = None) -> DataFrame:
    """(id, url, status, wait_s): the origin of each submitted URL and what became of it."""
    parsed = subs.withColumn("url", urls.url_origin(F.col("url")))
    bad = parsed.filter("url is null").select("id", "url", F.lit("bad_url").alias("status"),
                                              F.lit(0).cast("bigint").alias("wait_s"))
    # Read for the queue and for the answer.
    limited = cut_lineage(rate_limit(parsed.filter("url is not null"), limit_s, drain_every_s))
    queued = unique_pending(limited.filter("accepted").drop("accepted", "wait_s"), drain_every_s=drain_every_s)
    outcomes = queued.select("id", F.when(F.col("duplicate"), "duplicate").otherwise("accepted").alias("status"))
    good = limited.join(outcomes, "id", "left").select(
        "id", "url", F.coalesce("status", F.lit("rate_limited")).alias("status"), "wait_s")
    return good.unionByName(bad)


def last_seen(subs: DataFrame) -> DataFrame:
    return subs.groupBy("ip").agg(F.max("timestamp").alias("last_timestamp"))


def drain_submissions(subs: DataFrame, consumed: DataFrame) -> DataFrame:
    """Pending rows: those whose id is not in the ledger of consumed ones."""
    return subs.join(consumed.select("id"), "id", "left_anti")
