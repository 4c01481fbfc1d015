"""Registered queries: URL functions, URL filters and page extraction over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.catalog import inputs as inp
from fathom.catalog.inputs import q
from fathom.functions import urls
from fathom.operators import extract, url_filters
from fathom.sources import tables

RULES = [("index", r'(?i)<div\b[^>]*\bclass="ad">[^<]*\bder\b', True), ("footer", r"(?i)<footer>&copy; m\.", False),
         ("english", r'(?i)<html lang="en">.*<h1>A', True)]
DENY = [r"www\.", r"m\.[a-z]+\.example\.(com|net)/de/.*"]
ALLOW = [r"[a-z]+\.example\.org/.*", r"blog\."]


def _with(spark, sf, **cols):
    return inp.table(spark, sf, "pages").withColumns({n: F.expr(e) for n, e in cols.items()})


BROKEN = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url || ' x' WHEN 2 THEN replace(url, '://', ':/')
  WHEN 3 THEN url || '%zz' WHEN 4 THEN url || '%4a[' ELSE '//' || url END"""
MESSY = """CASE WHEN page_id % 11 = 7 THEN 'MailTo:a' || page_id || '@b.geek' ELSE CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'HTTP') WHEN 1 THEN url || '?b=2&a=1&&c&b=1'
  WHEN 2 THEN replace(url, '/en/', '/é n/') WHEN 3 THEN regexp_extract(url, '^[a-z]+://[^/]*', 0) ELSE url END END"""
ORIGINS = """CASE page_id % 6 WHEN 0 THEN replace(url, '.com/', '.com:80/') WHEN 1 THEN 'mailto:a@b.geek'
  WHEN 2 THEN replace(url, '.example', '.Example') WHEN 3 THEN substring(url, 9) WHEN 4 THEN replace(url, '://', '://u:p@')
  ELSE replace(url, '.net/', '.net:8080/') END"""
HREF = """CASE page_id % 9 WHEN 0 THEN '/a/b' WHEN 1 THEN '../x' WHEN 2 THEN './y?z=1' WHEN 3 THEN '?q=1' WHEN 4 THEN '#f'
  WHEN 5 THEN '//other.geek/p' WHEN 6 THEN 'http://abs.geek/p#q' WHEN 7 THEN 'a/b/../c/./d' ELSE '' END"""
NAMES = """regexp_extract(url, '^[^?#]*', 0) || CASE page_id % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.tar.gz' WHEN 2 THEN
  '.TXT' WHEN 3 THEN '.xml' WHEN 4 THEN '.tgz' WHEN 5 THEN '.unknown' WHEN 6 THEN '.html?a=b.png' ELSE '' END"""
IP = """CASE WHEN user_id % 7 = 0 THEN '300.1.2.3' WHEN user_id % 7 = 1 THEN 'x' ELSE user_id || '.' || (event_id % 256)
  || '.0.' || (event_id % 10) END"""


def u1(spark, sf):
    df = _with(spark, sf, u=BROKEN)
    return df.select("page_id", "u", urls.is_valid_url(F.col("u")).alias("valid"))


def u2(spark, sf):
    df = _with(spark, sf, u=MESSY)
    return df.select("page_id", urls.canonical_url(F.col("u")).alias("u"))


def u3(spark, sf):
    df = _with(spark, sf, u=ORIGINS)
    return df.select("page_id", "u", urls.url_origin(F.col("u")).alias("origin"))


def u4(spark, sf):
    u = F.col("url")
    return inp.table(spark, sf, "pages").select(
        "page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"),
        urls.site(u).alias("site"), urls.is_root(u).alias("is_root"))


def u5(spark, sf):
    df = _with(spark, sf, href=HREF)
    return df.select("page_id", "href", urls.resolve_url(F.col("url"), F.col("href")).alias("u"))


def u6_deny(spark, sf):
    return url_filters.filter_url_patterns(inp.table(spark, sf, "pages"), deny=DENY).select("page_id", "url")


def u6_allow(spark, sf):
    return url_filters.filter_url_patterns(inp.table(spark, sf, "pages"), ALLOW, DENY).select("page_id", "url")


def u6_explain(spark, sf):
    return url_filters.explain_url(inp.table(spark, sf, "pages"), DENY).select("page_id", "pattern")


def u7(spark, sf):
    pages = inp.table(spark, sf, "pages")
    allowed = url_filters.filter_tlds(pages, allow=["org", "net"]).select("page_id", F.lit("allow").alias("mode"))
    denied = url_filters.filter_tlds(pages, deny=["org"]).select("page_id", F.lit("deny").alias("mode"))
    return allowed.unionByName(denied)


def u8(spark, sf):
    df = _with(spark, sf, u=NAMES)
    return df.select("page_id", "u", urls.guess_mimetype(F.col("u")).alias("mimetype"))


def u8_filter(spark, sf):
    return url_filters.filter_mimetypes(_with(spark, sf, u=NAMES), col="u").select("page_id", "u")


def u9(spark, sf):
    return url_filters.dedupe_requests(requests(spark, sf), ["seq"]).select("seq", "url", "normalised", "dont_filter")


def requests(spark, sf):
    """Each page asked for three times: as it is, in another spelling, and in normal form."""
    pages = inp.table(spark, sf, "pages")
    spelled = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), u.alias("u")) for i, u in enumerate((
        F.col("url"), F.concat("url", F.lit("#again")), urls.canonical_url(F.col("url"))))]))
    return pages.select("page_id", spelled.alias("r")).select(
        (F.col("page_id") * 3 + F.col("r.k")).alias("seq"), F.col("r.u").alias("url"),
        (F.col("r.k") == 2).alias("normalised"), ((F.col("page_id") % 7 == 0) & (F.col("r.k") == 1)).alias("dont_filter"))


REQUESTS_SQL = f"""(SELECT page_id * 3 + k AS seq, CASE k WHEN 0 THEN url WHEN 1 THEN url || '#again'
  ELSE {inp.sql_canonical('url')} END AS url, k = 2 AS normalised, page_id % 7 = 0 AND k = 1 AS dont_filter
  FROM pages, (VALUES (0), (1), (2)) AS v(k))"""


def u10(spark, sf):
    df = _with(spark, sf, u="CASE WHEN page_id % 3 = 0 THEN 'ftp://a.geek' WHEN page_id % 3 = 1 THEN url "
                            "ELSE regexp_extract(url, '^[a-z]+://[^/]*', 0) END")
    return df.select("page_id", urls.is_submittable(F.col("u")).alias("ok"))


def u11(spark, sf):
    df = inp.table(spark, sf, "events").withColumn("ip", F.expr(IP))
    return df.select("event_id", "ip", urls.ipv4_to_long(F.col("ip")).alias("n"))


def e1(spark, sf):
    pages = inp.fetches(spark, sf).withColumn("body", F.when(
        F.col("page_id") % 5 == 1, F.regexp_replace("body", r"(?is)<title>.*?</title>", "")).when(
        F.col("page_id") % 5 == 2, F.lit("<p>none</p>")).otherwise(F.col("body")))
    return extract.with_title(pages).select("page_id", "title")


def e2(spark, sf):
    return extract.with_text(extract.with_title(inp.fetches(spark, sf))).select("page_id", "content")


def e3(spark, sf):
    return extract.with_description(inp.fetches(spark, sf)).select("page_id", "description")


def e4(spark, sf):
    return extract.extract_links(inp.fetches(spark, sf))


def e5(spark, sf):
    return extract.with_dead_since(inp.fetches(spark, sf), F.lit(inp.NOW).cast("timestamp")).select(
        "page_id", "status", "dead_since")


def e6(spark, sf):
    pages = inp.table(spark, sf, "pages").withColumn(
        "url", F.when(F.col("page_id") % 3 == 0, F.concat(urls.site(F.col("url")), F.lit("/"))).otherwise(F.col("url")))
    return extract.template_action(pages, RULES, "html").select("page_id", "rule", "action")


# Markup, and the rule that it fits: each rule, then pages that have the elements but not inside each other.
MARKUPS = [
    ("""<span class=a id='lib'>x <b>y</b></span> <span id="reddit">z</span>""", "reddit frontend"),
    ("""<div class="x" id="page-header"><p class="menu apache">a</p></div>""", "apache manual"),
    ("""<div class='main_page'><div\nclass="floating_element page_header x"><img src=a class="floating_element"></div></div>""", "apache default page"),
    ("""<div id=cgit><table id="header"><tbody><tr><td class="logo"><a href=b><img></a></td></tr></tbody></table></div>""", "cgit"),
    ("""<footer><div class="ui container"><div class="ui x left"><a title="a>b" href='http://gitea.io'>g</a></div></div></footer>""", "gitea"),
    ("""<footer><a href="http://gitea.io">g</a></footer>""", None),
    ("""<div id="page-header"><div>h</div></div><div><p class="apache">after it</p></div>""", None),
    ("""<div id="page-header"><div><div>h</div></div><p class="apache">deep</p></div>""", "apache manual"),
    ("""<span id="lib">x</span><b>y</b><span id="reddit">z</span>""", None),
    ("""<div id="page-header"></div><!-- <div id="page-header"> --><p class="apache">a</p>""", None),
    ("""<div id="page-header"></div><p class="apaches">""", None),
    ("""<footer><div class="ui container"></div><div class="ui left"><a href="gitea">g</a></div></footer>""", None),
    ("", None),
]
MARKUP = f"CASE page_id % {len(MARKUPS)} " + " ".join(f"WHEN {i} THEN {inp.q(m)}" for i, (m, _) in enumerate(MARKUPS)) + " END"


def e6_shipped(spark, sf):
    """The rules that the library brings, over pages with such markup added."""
    pages = inp.table(spark, sf, "pages").select("page_id", F.concat("html", F.expr(MARKUP)).alias("html"), F.when(
        F.col("page_id") % 3 == 0, F.concat(urls.site(F.col("url")), F.lit("/"))).otherwise(F.col("url")).alias("url"))
    return extract.template_action(pages, body="html").select("page_id", "rule", "action")


def e6_report(spark, sf):
    return extract.template_action(inp.table(spark, sf, "pages"), RULES, "html").groupBy("rule", "action").agg(
        F.count("*").alias("n"))


def e7(spark, sf):
    return extract.text_responses(_with(spark, sf, u=NAMES).withColumn("url", F.col("u"))).select("page_id", "url")


def e8(spark, sf):
    return extract.extract_pages(inp.fetches(spark, sf))


def s2(spark, sf):
    found = tables.read_fetches(spark, f"{sf}/pages.parquet", columns={
        "url": "url", "body": "html", "status": "CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END"})
    return found.select("url", "status", "body")


QUERIES = {
    "u1_is_valid_url": u1, "u2_canonical_url": u2, "u3_url_origin": u3, "u4_url_parts": u4, "u5_resolve_url": u5,
    "u6_url_deny": u6_deny, "u6_url_allow": u6_allow, "u6_explain_url": u6_explain, "u7_filter_tlds": u7,
    "u8_guess_mimetype": u8, "u8_filter_mimetypes": u8_filter, "u9_dedupe_requests": u9, "u10_is_submittable": u10,
    "u11_ipv4_to_long": u11, "e1_title": e1, "e2_text": e2, "e3_description": e3, "e4_extract_links": e4,
    "e5_dead_since": e5, "e6_template_action": e6, "e6_template_report": e6_report, "e6_shipped_rules": e6_shipped, "e7_text_responses": e7,
    "e8_extract_pages": e8, "s2_read_fetches": s2,
}


def _like(patterns: list[str]) -> str:
    return f"regexp_matches(url, {q('^https?://(?:' + '|'.join(patterns) + ')')})"


def _dots(p: str) -> str:
    p = f"regexp_replace({p}, '/\\./', '/', 'g')"
    for _ in range(3):
        p = f"regexp_replace({p}, '/[^/]+/\\.\\./', '/')"
    return p


_TYPES = inp.values([(e, t) for e, t in urls.known_types().items()], "ext, mimetype")
_NAME = f"""nm AS (SELECT page_id, {NAMES} AS u FROM pages), ne AS (SELECT page_id, u, lower(regexp_extract(
  replace(replace(regexp_extract({inp.sql_part('u', 3)}, '[^/]*$'), '.tgz', '.tar.gz'), '.tar.gz', '.tar'),
  '[^.](\\.[^.]*)$', 1)) AS ext FROM nm),
nt AS (SELECT page_id, u, coalesce(mimetype, 'text/html') AS mimetype FROM ne LEFT JOIN {_TYPES} USING (ext))"""
_HOST = f"regexp_extract(u, {q(urls.HOST_PORT)}, 1)"
_PORT = f"regexp_extract(u, {q(urls.HOST_PORT)}, 2)"
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(html, {q(p)}) THEN '{n}'" for n, p, _ in RULES) + " END"


def _actions(pages: str) -> str:
    return f"""SELECT page_id, rule, CASE WHEN rule IS NULL THEN 'keep' WHEN rule = 'footer' THEN 'drop'
        WHEN {inp.sql_part('url', 3)} IN ('', '/') THEN 'keep' ELSE 'to_root' END AS action
        FROM (SELECT *, {_RULE} AS rule FROM {pages})"""


_E1_FETCHES = f"""(SELECT * REPLACE (CASE WHEN page_id % 5 = 1 THEN regexp_replace(body, '(?is)<title>.*?</title>', '', 'g')
  WHEN page_id % 5 = 2 THEN '<p>none</p>' ELSE body END AS body) FROM {inp.FETCHES_SQL})"""

ORACLE = {
    "u1_is_valid_url": f"""SELECT page_id, u, NOT contains(regexp_replace(u, {q(urls.ESCAPE)}, '', 'g'), '%')
        AND regexp_matches(u, '^[a-z]+:') AND NOT regexp_matches(regexp_replace(u, '^[a-z]+://[^/]*', ''), '[\\[ ]')
        AS valid FROM (SELECT page_id, {BROKEN} AS u FROM pages)""",
    "u2_canonical_url": f"SELECT page_id, {inp.sql_canonical('u')} AS u FROM (SELECT page_id, {MESSY} AS u FROM pages)",
    "u3_url_origin": f"""SELECT page_id, u, CASE WHEN u LIKE 'mailto:%' THEN 'null' WHEN u NOT LIKE 'http%' THEN NULL ELSE
        regexp_extract(u, '^[a-z]+') || '://' || lower({_HOST}) || CASE WHEN {_PORT} IN ('', CASE WHEN u LIKE 'https%'
        THEN '443' ELSE '80' END) THEN '' ELSE ':' || {_PORT} END END AS origin
        FROM (SELECT page_id, {ORIGINS} AS u FROM pages)""",
    "u4_url_parts": f"""SELECT page_id, split_part(url, '://', 1) AS scheme, {inp.sql_part('url', 2)} AS netloc,
        {inp.sql_part('url', 3)} AS path, split_part(url, '://', 1) || '://' || {inp.sql_part('url', 2)} AS site,
        {inp.sql_part('url', 3)} IN ('', '/') AS is_root FROM pages""",
    "u5_resolve_url": f"""SELECT page_id, href, CASE page_id % 9 WHEN 0 THEN {inp.sql_site('url')} || href
        WHEN 3 THEN regexp_extract(url, '^[^?#]*') || href WHEN 4 THEN regexp_extract(url, '^[^#]*') || href
        WHEN 5 THEN split_part(url, '//', 1) || href WHEN 6 THEN href WHEN 8 THEN url ELSE {inp.sql_site('url')} ||
        {_dots(f"regexp_extract({inp.sql_part('url', 3)}, '^.*/') || href")} END AS u
        FROM (SELECT *, {HREF} AS href FROM pages)""",
    "u6_url_deny": f"SELECT page_id, url FROM pages WHERE NOT {_like(DENY)}",
    "u6_url_allow": f"SELECT page_id, url FROM pages WHERE {_like(ALLOW)}",
    "u6_explain_url": f"""SELECT page_id, CASE WHEN {_like(DENY[:1])} THEN {q(DENY[0])} WHEN {_like(DENY[1:])}
        THEN {q(DENY[1])} END AS pattern FROM pages""",
    "u7_filter_tlds": f"""SELECT page_id, 'allow' AS mode FROM pages WHERE {inp.sql_label('url')} IN ('org', 'net')
        UNION ALL SELECT page_id, 'deny' FROM pages WHERE {inp.sql_label('url')} <> 'org'""",
    "u8_guess_mimetype": f"WITH {_NAME} SELECT page_id, u, mimetype FROM nt",
    "u8_filter_mimetypes": f"""WITH {_NAME} SELECT page_id, u FROM nt
        WHERE mimetype IN ('text/html', 'text/xml', 'text/plain')""",
    "u9_dedupe_requests": f"""WITH r AS (SELECT *, {inp.sql_canonical('url')} AS c FROM {REQUESTS_SQL})
        SELECT seq, url, normalised, dont_filter FROM (SELECT *, row_number() OVER (PARTITION BY c, normalised ORDER BY seq)
          AS rn FROM r WHERE NOT dont_filter) WHERE rn = 1
        UNION ALL SELECT seq, url, normalised, dont_filter FROM r WHERE dont_filter""",
    "u10_is_submittable": """SELECT page_id, page_id % 3 = 2 OR (page_id % 3 = 1 AND
        regexp_full_match(url, 'https?://.+\\.[a-zA-Z]+')) AS ok FROM pages""",
    "u11_ipv4_to_long": f"""SELECT event_id, ip, CASE WHEN user_id % 7 > 1 AND user_id < 256 THEN user_id * 16777216
        + (event_id % 256) * 65536 + event_id % 10 END AS n FROM (SELECT *, {IP} AS ip FROM events)""",
    "e1_title": f"WITH {inp.extract_ctes(_E1_FETCHES)} SELECT page_id, title FROM ex",
    "e2_text": f"WITH {inp.extract_ctes()} SELECT page_id, content FROM ex",
    "e3_description": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'about ' || page_id || ' & more' ELSE '' END
        AS description FROM pages""",
    "e4_extract_links": f"WITH {inp.extract_ctes()}, {inp.LINKS_CTES} SELECT referrer, n, url FROM lk",
    "e5_dead_since": f"""SELECT page_id, status, CASE WHEN status >= 400 THEN TIMESTAMP '{inp.NOW}' END AS dead_since
        FROM {inp.FETCHES_SQL}""",
    "e6_template_action": _actions(f"""(SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN {inp.sql_site('url')} || '/'
        ELSE url END AS url FROM pages)"""),
    "e6_shipped_rules": f"""SELECT page_id, rule, CASE WHEN rule IS NULL THEN 'keep' WHEN rule LIKE 'apache%' THEN 'drop'
        WHEN page_id % 3 = 0 THEN 'keep' ELSE 'to_root' END AS action FROM (SELECT page_id, CASE page_id % {len(MARKUPS)} {' '.join(
            f"WHEN {i} THEN {q(rule)}" for i, (_, rule) in enumerate(MARKUPS) if rule)} END AS rule FROM pages
        WHERE NOT regexp_matches(html, 'id="?(lib|reddit|page-header|cgit)|_page"|ui container'))""",
    "e6_template_report": f"SELECT rule, action, count(*) AS n FROM ({_actions('pages')}) GROUP BY rule, action",
    "e7_text_responses": f"""WITH {_NAME} SELECT page_id, u AS url FROM nt
        WHERE mimetype IN ('text/html', 'text/xml', 'text/plain')""",
    "e8_extract_pages": f"""WITH {inp.extract_ctes()} SELECT url, depth, title, content, description,
        fetched_at AS created_at, fetched_at AS last_updated, CASE WHEN status >= 400 THEN fetched_at END AS dead_since
        FROM ex""",
    "s2_read_fetches": """SELECT url, CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS status,
        html AS body FROM pages""",
}
