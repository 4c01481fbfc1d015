"""Which fetched pages become records, in the order of the checks: cheap ones on the URL first, those on the markup last."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom import config
from fathom.functions import urls
from fathom.operators.extract import Rule, template_action
from fathom.operators.url_filters import filter_mimetypes, filter_tlds, filter_url_patterns


@dataclass(frozen=True)
class CrawlRules:
    """The checks; None leaves one out."""

    allow: list[str] | None = None
    deny: list[str] | None = field(default_factory=lambda: config.DENIED_URLS)
    tlds: list[str] | None = field(default_factory=lambda: config.ALLOWED_TLDS)
    mimetypes: list[str] | None = field(default_factory=lambda: config.ALLOWED_MIMETYPES)
    templates: list[Rule] | None = field(default_factory=lambda: config.TEMPLATE_RULES)
    max_depth: int | None = config.DEPTH_LIMIT


def screened(fetches: DataFrame, rules: CrawlRules, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Pages to be extracted, and requests (url) for root pages in place of pages that a template rule sends there."""
    kept = fetches.filter(urls.is_valid_url(F.col("url")))
    if rules.allow is not None or rules.deny is not None:
        kept = filter_url_patterns(kept, rules.allow, rules.deny)
    if rules.tlds is not None:
        kept = filter_tlds(kept, allow=rules.tlds)
    if rules.mimetypes is not None:
        kept = filter_mimetypes(kept, rules.mimetypes)
    if rules.max_depth is not None and "depth" in kept.columns:
        kept = kept.filter(F.coalesce(F.col("depth"), F.lit(0)) <= rules.max_depth)
    if rules.templates is None:
        return kept, kept.select("url").limit(0)
    marked = template_action(kept, rules.templates, body)
    instead = marked.filter("action = 'to_root'").select(F.concat(urls.site(F.col("url")), F.lit("/")).alias("url")).distinct()
    return marked.filter("action = 'keep'").drop("rule", "action"), instead
