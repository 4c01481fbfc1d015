"""Fetched responses to page records and links. Projections only: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import config
from fathom.functions import html, urls


def with_clean(df: DataFrame, body: str = "body", out: str = "__clean") -> DataFrame:
    return df.withColumn(out, html.without_noise(F.col(body)))


def with_title(df: DataFrame, body: str = "body") -> DataFrame:
    return with_clean(df, body).withColumn("title", html.title(F.col("__clean"), F.col("url"))).drop("__clean")


def with_text(df: DataFrame, body: str = "body") -> DataFrame:
    """Needs ``title``."""
    df = with_clean(df, body).withColumn("content", html.text(F.col("__clean"), F.col("title")))
    return df.withColumn("content", html.without_title(F.col("content"), F.col("title"))).drop("__clean")


def with_description(df: DataFrame, body: str = "body") -> DataFrame:
    return with_clean(df, body).withColumn("description", html.description(F.col("__clean"))).drop("__clean")


def with_dead_since(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumn("dead_since", F.when(F.col("status").between(400, 599), now))


def text_responses(df: DataFrame, allowed: list[str] = config.ALLOWED_MIMETYPES) -> DataFrame:
    """Only text pages yield links."""
    return df.filter(urls.has_mimetype(F.col("url"), allowed, config.DEFAULT_MIMETYPE))


def extract_links(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per href: referrer, place on the page, and the absolute URL."""
    found = with_clean(df, body).select(
        F.col("url").alias("referrer"), F.posexplode(html.hrefs(F.col("__clean"))).alias("n", "href"))
    return found.select("referrer", "n", urls.resolve_url(F.col("referrer"), F.col("href")).alias("url"))


def extract_pages(fetches: DataFrame, at: str = "fetched_at", body: str = "body") -> DataFrame:
    """The whole page record of each fetch; times come from the fetch, so a repeated run gives the same rows."""
    df = with_clean(fetches, body).withColumn("title", html.title(F.col("__clean"), F.col("url")))
    df = df.withColumn("content", html.text(F.col("__clean"), F.col("title")))
    now = F.col(at)
    return with_dead_since(df, now).select(
        "url", F.col("depth").cast("int").alias("depth"), "title",
        html.without_title(F.col("content"), F.col("title")).alias("content"),
        html.description(F.col("__clean")).alias("description"),
        now.alias("created_at"), now.alias("last_updated"), "dead_since")


Rule = tuple[str, str | list[html.Step], bool]


def template_action(df: DataFrame, rules: list[Rule] = config.TEMPLATE_RULES, body: str = "body") -> DataFrame:
    """Adds ``rule`` (first known page template that fits, or NULL) and ``action``: keep, to_root or drop.

    A rule has a pattern on the markup, or the elements that a page of the template has inside each other.
    """
    rule = F.lit(None).cast("string")
    for name, fits, _ in reversed(rules):
        found = F.col(body).rlike(fits) if isinstance(fits, str) else html.has_nested(F.col(body), fits)
        rule = F.when(found, name).otherwise(rule)
    df = df.withColumn("rule", rule).withColumn("__root_ok", F.col("rule").isin(*[n for n, _, ok in rules if ok]))
    action = F.when(F.col("rule").isNull(), "keep").when(~F.col("__root_ok"), "drop").when(
        urls.is_root(F.col("url")), "keep").otherwise("to_root")
    return df.withColumn("action", action).drop("__root_ok")
