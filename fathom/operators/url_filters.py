"""Filters on URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import config
from fathom.functions import urls


def matches_patterns(url: Column, patterns: list[str]) -> Column:
    """One pattern for the whole list, anchored at the start."""
    return url.rlike(f"^https?://(?:{'|'.join(f'(?:{p})' for p in patterns)})")


def url_allowed(url: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """The allow list alone decides if it is set, else the deny list."""
    if allow:
        return matches_patterns(url, allow)
    if deny:
        return ~matches_patterns(url, deny)
    raise ValueError("give an allow or a deny list")


def filter_url_patterns(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None,
                        col: str = "url") -> DataFrame:
    return df.filter(url_allowed(F.col(col), allow, deny))


def explain_url(df: DataFrame, patterns: list[str], col: str = "url") -> DataFrame:
    """Adds ``pattern``: the first pattern that fits, or NULL."""
    return df.withColumn("pattern", F.coalesce(
        *[F.when(matches_patterns(F.col(col), [p]), p) for p in patterns], F.lit(None).cast("string")))


def tld_allowed(url: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    if bool(allow) == bool(deny):
        raise ValueError("give either an allow or a deny list of top-level domains")
    label = urls.last_label(url)
    fits = label.isin(*allow) if allow else (label != "") & ~label.isin(*deny)
    return F.lower(url).startswith("http") & fits


def filter_tlds(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None,
                col: str = "url") -> DataFrame:
    return df.filter(tld_allowed(F.col(col), allow, deny))


def filter_mimetypes(df: DataFrame, allowed: list[str] = config.ALLOWED_MIMETYPES,
                     default: str = config.DEFAULT_MIMETYPE, col: str = "url") -> DataFrame:
    unknown = [m for m in [*allowed, default] if m not in urls.known_types().values()]
    if unknown or not allowed:
        raise ValueError(f"unknown content types: {unknown}" if unknown else "give at least one content type")
    return df.filter(urls.has_mimetype(F.col(col), allowed, default))


def fingerprint(url: Column, normalised: Column) -> Column:
    """A request to the normal form of a URL counts as another request than the one it replaced."""
    return F.concat(F.sha2(urls.canonical_url(url), 256), F.when(normalised, "00").otherwise(""))


def dedupe_requests(df: DataFrame, order: list[str]) -> DataFrame:
    """First request per fingerprint; requests marked ``dont_filter`` all pass.

    A grouped minimum combines before the shuffle, so one much-linked URL does not become one large group.
    """
    marked = df.withColumn("__fp", fingerprint(F.col("url"), F.col("normalised")))
    firsts = marked.filter(~F.col("dont_filter")).groupBy("__fp").agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return firsts.unionByName(marked.filter("dont_filter").drop("__fp"))
