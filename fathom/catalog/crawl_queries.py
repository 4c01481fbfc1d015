"""Registered queries: link graph, robots rules, page upserts, submissions, accounting and table sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.catalog import inputs as inp
from fathom.catalog.inputs import FETCHES_SQL, NOW, START, q
from fathom.functions import urls
from fathom.operators import pages as pg
from fathom.operators import accounting, extract, graph, robots, search, submissions
from fathom.operators.index import build_postings
from fathom.plans.lineage import checkpoint_folder
from fathom.plans.packed import joined
from fathom.sources import page_store, tables

QUIET = "https://m.tionsh.example.net"  # its group for the crawler has a delay only, so the crawler may go anywhere
SITES = ["http://ththin.example.com", "https://www.therwh.example.org", "https://blog.tionsh.example.net"]
RULES = [(SITES[0], "*", False, "/en/"), (SITES[0], "*", True, "/en/9"), (SITES[0], "bot", True, "/"),
         (SITES[1], "crawler", False, "/*/2"), (SITES[1], "*", False, "/"), (SITES[2], "*", False, "/*e"),
         (SITES[2], "*", False, "/de"), (SITES[2], "*", True, "/en/*1$"), (SITES[2], "*", False, ""),
         (QUIET, "crawler", None, None), (QUIET, "*", False, "/")]
AGENT = "My-Crawler/1.0"
# What the rules above say for the agent, as one test per URL path.
_RULES_SQL = f"""CASE {inp.sql_site('url')} WHEN {q(SITES[0])} THEN NOT (starts_with(path, '/en/')
    AND NOT starts_with(path, '/en/9')) WHEN {q(SITES[1])} THEN NOT regexp_matches(path, '^/.*/2')
    WHEN {q(SITES[2])} THEN regexp_matches(path, '^/en/.*1$') OR NOT (starts_with(path, '/de')
    OR regexp_matches(path, '^/.*e')) ELSE true END"""
_PATHS = f"(SELECT *, regexp_replace(url, {q(urls.SITE)}, '') AS full_path, split_part(regexp_replace(url, " \
         f"{q(urls.SITE)}, ''), '#', 1) AS path FROM pages)"


def _rules(spark):
    return spark.createDataFrame(RULES, "site string, agent string, allow boolean, pattern string")


def g1(spark, sf):
    return graph.link_edges(inp.fetches(spark, sf))


def _part_graph(spark, sf):
    part = inp.table(spark, sf, "part")
    n = part.count()
    p = F.col("p_partkey")
    to = F.array(p + 1, p + 3, F.when(p % 97 == 5, (p * 37 + 11) % n))
    edges = part.select(p.alias("p"), F.explode(to).alias("d")).filter((F.col("d") < n))
    name = lambda c: F.concat(F.lit("http://s"), F.floor(c / 100).cast("string"), F.lit(".geek/"),
                              F.when(c % 100 == 0, "").otherwise(F.concat(F.lit("p"), c.cast("string"))))
    starts = part.filter(p % 100 == 0).select(name(p).alias("url"))
    return starts, edges.select(name(F.col("p")).alias("src"), name(F.col("d")).alias("dst"))


def g2(spark, sf):
    starts, edges = _part_graph(spark, sf)
    return graph.intra_site_depth(starts, edges)


def _records(spark, sf):
    return extract.extract_pages(inp.fetches(spark, sf))


def g3(spark, sf):
    return graph.start_pages(_records(spark, sf), F.lit(NOW).cast("timestamp"), 3 * 24 * 3600).select("url", "depth")


def g4(spark, sf):
    pages = inp.table(spark, sf, "pages")
    labels = pages.select(F.regexp_replace("url", "^https?://", "").alias("label"))
    return graph.seed_urls(labels, "http://{}", pages)


def g5(spark, sf):
    pages = inp.table(spark, sf, "pages")
    asked = pages.select("page_id", F.expr("explode(array(url, concat(url, '!')))").alias("url"))
    return graph.urls_exist(asked, pages.filter("page_id % 3 > 0")).select("page_id", "url", "known")


def g6(spark, sf):
    pages = inp.table(spark, sf, "pages")
    seeds, starts = pages.filter("page_id % 3 = 0"), pages.filter("page_id % 2 = 0")
    subs = _submissions(spark, sf).select(urls.url_origin(F.col("url")).alias("url"))
    return graph.build_frontier(seeds, starts, subs).select(
        "url", "priority", "dont_filter", "normalised", "refresh_robots")


ROBOTS_TEXT = """'User-agent: A' || chr(10) || 'user-agent: bot' || page_id % 3 || chr(10) || 'Disallow: /x' || page_id
  || ' # why' || chr(13) || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: /s' || chr(10) || chr(10) || 'User-agent: *'
  || chr(10) || 'Crawl-delay: 2.5' || chr(10) || 'Disallow:' || chr(10) || 'User-agent: slow' || chr(10) || 'Crawl-delay: 9'"""


def g7(spark, sf):
    files = inp.table(spark, sf, "pages").select(F.col("url").alias("site"), F.expr(ROBOTS_TEXT).alias("body"))
    return robots.parse_robots(files)


def g8(spark, sf):
    return robots.robots_allowed(inp.table(spark, sf, "pages"), _rules(spark), AGENT).select("page_id", "url", "allowed")


def g9(spark, sf):
    sites = spark.createDataFrame([(s,) for s in SITES[1:]], "site string")
    return robots.purge_disallowed(inp.table(spark, sf, "pages"), _rules(spark), sites, AGENT).select("page_id", "url")


def _robots_log(spark, sf):
    return inp.table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"),
        F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_id").alias("snapshot"))


def g10(spark, sf):
    log = _robots_log(spark, sf)
    refresh = spark.createDataFrame([("h3",)], "host string")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return robots.stale_robots(log, now, 7200, refresh)


def g11(spark, sf):
    pages = inp.table(spark, sf, "pages")
    kept, gone = graph.cleanup_pages(pages, deny=[r"www\."], tlds=["org", "net"])
    return kept.select("page_id", F.lit("kept").alias("fate")).unionByName(
        gone.select("page_id", F.lit("deleted").alias("fate")))


def g12(spark, sf):
    requests = inp.table(spark, sf, "events").filter("event_type <> 'signup'").select(
        "event_id", F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"),
        F.col("ts").cast("timestamp").alias("ts"))
    return robots.robots_as_of(requests, _robots_log(spark, sf)).select("event_id", "host", "ts", "snapshot")


def _batch(spark, sf):
    """Second fetch of every third page, some dead, and some pages not seen before."""
    n = F.col("page_id")
    f = inp.fetches(spark, sf).filter("page_id % 3 = 0").withColumn("seq", n)
    return f.select(
        F.when(n % 5 == 0, F.concat("url", F.lit("#new"))).otherwise(F.col("url")).alias("url"),
        ((n + 3) % 7).cast("int").alias("depth"), F.concat(F.lit("again "), n.cast("string")).alias("title"),
        F.lit("new text").alias("content"), F.lit("").alias("description"), inp.hours_after(n + 1000).alias("created_at"),
        inp.hours_after(n + 1000).alias("last_updated"),
        F.when(n % 4 == 0, inp.hours_after(n + 1000)).alias("dead_since"))


_BATCH_SQL = f"""(SELECT CASE WHEN page_id % 5 = 0 THEN url || '#new' ELSE url END AS url,
  CAST((page_id + 3) % 7 AS INTEGER) AS depth, 'again ' || page_id AS title, 'new text' AS content, '' AS description,
  TIMESTAMP '{START}' + INTERVAL 1 HOUR * (page_id + 1000) AS at, page_id % 4 = 0 AS dead
  FROM pages WHERE page_id % 3 = 0)"""


def _upsert_sql(known_dead: str = "n.at", depth: str = "least(o.depth, n.depth)", title: str = "n.title") -> str:
    return f"""WITH {inp.extract_ctes()}, o AS (SELECT *, CASE WHEN status >= 400 THEN fetched_at END AS dead_since FROM ex),
        n AS {_BATCH_SQL}
        SELECT coalesce(o.url, n.url) AS url,
          CASE WHEN n.url IS NULL OR (o.url IS NOT NULL AND dead) THEN o.depth ELSE {depth} END AS depth,
          CASE WHEN n.url IS NULL OR (o.url IS NOT NULL AND dead) THEN o.title ELSE {title} END AS title,
          CASE WHEN n.url IS NULL OR (o.url IS NOT NULL AND dead) THEN o.content ELSE n.content END AS content,
          CASE WHEN n.url IS NULL OR (o.url IS NOT NULL AND dead) THEN o.description ELSE n.description END AS description,
          coalesce(fetched_at, n.at) AS created_at, coalesce(n.at, fetched_at) AS last_updated,
          CASE WHEN n.url IS NULL THEN dead_since WHEN dead THEN {known_dead} END AS dead_since
        FROM o FULL JOIN n ON o.url = n.url"""


def p1(spark, sf):
    return pg.upsert_pages(_records(spark, sf), _batch(spark, sf))


def p1_keep(spark, sf):
    return pg.upsert_pages(_records(spark, sf), _batch(spark, sf), keep_first_dead=True)


def p4(spark, sf):
    """Other choices per field: the larger depth, the longer title."""
    longer = lambda a, b: F.when(F.length(a) >= F.length(b), a).otherwise(b)
    merged = pg.upsert_pages(_records(spark, sf), _batch(spark, sf), {"depth": F.greatest, "title": longer})
    return merged


def _event_fetches(spark, sf):
    """Events as page records: many fetches per URL."""
    e = inp.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("http://u.geek/"), (F.col("user_id") % 100).cast("string")).alias(
            "url"), (F.col("event_id") % 6).cast("int").alias("depth"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.col("props").alias("content"),
        F.col("event_type").alias("description"), ts.alias("created_at"), ts.alias("last_updated"),
        F.when(F.col("event_type") == "error", ts).alias("dead_since"))


def p2(spark, sf):
    return pg.collapse_fetches(_event_fetches(spark, sf))


def p5(spark, sf):
    pages = inp.table(spark, sf, "pages").select("page_id", "url")
    return pg.delete_pages(pages, pages.filter("page_id % 4 = 1"))


def s1(spark, sf):
    return tables.scan_pages(spark, f"{sf}/pages.parquet", F.col("url").startswith("https://"), columns=["page_id", "url"])


def s4(spark, sf):
    """Write the pages, upsert a batch into the stored table, read it back."""
    path = new_folder(spark, "pages")
    page_store.write_pages(_records(spark, sf), path, buckets=8)
    page_store.upsert_into(_batch(spark, sf), path)
    return page_store.read_pages(spark, path)


def new_folder(spark, name):
    """Name of a folder, not made yet, in the checkpoint folder, which all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def s6(spark, sf):
    """Write the index of the documents; read postings and dictionary back."""
    path = new_folder(spark, "index")
    page_store.write_index(build_postings(inp.doc_pages(spark, sf), fields=("title", "content"), main=True), path, buckets=8)
    ix = page_store.read_index(spark, path)
    return joined(ix.postings.select("field", "term", "doc", "tf", "field_len"),
                  ix.dictionary.select("field", "term", "df", "total_tf"), ["field", "term"])


SUB_URL = "CASE WHEN event_id % 13 = 0 THEN 'no url' ELSE 'http://H' || (event_id % 50) || '.geek/x' END"


def _submissions(spark, sf):
    return tables.read_submissions(spark, f"{sf}/events.parquet", columns={
        "id": "event_id", "url": SUB_URL, "ip": "user_id", "timestamp": "unix_seconds(cast(ts as timestamp))"})


_SUBS_SQL = f"(SELECT event_id AS id, {SUB_URL} AS url, user_id AS ip, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
_ORIGIN = "CASE WHEN url = 'no url' THEN NULL ELSE lower(regexp_extract(url, '^http://[^/]*')) END"


def s3(spark, sf):
    return _submissions(spark, sf)


def s5(spark, sf):
    subs = _submissions(spark, sf)
    return submissions.drain_submissions(subs, subs.filter("timestamp < 1705000000")).select("id", "url")


def b1(spark, sf):
    return submissions.rate_limit(_submissions(spark, sf), 7200).select("id", "ip", "accepted", "wait_s")


def b1_drain(spark, sf):
    return submissions.rate_limit(_submissions(spark, sf), 3600, 5400).select("id", "accepted", "wait_s")


def b2(spark, sf):
    return submissions.unique_pending(_submissions(spark, sf)).select("id", "url", "duplicate")


def b3(spark, sf):
    return submissions.submit_urls(_submissions(spark, sf))


def b4(spark, sf):
    return submissions.last_seen(_submissions(spark, sf))


def crawl_log(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "scheduled").when(
        F.col("event_type") == "error", "dropped").when(F.col("event_type") == "signup", "robots").otherwise("response")
    return inp.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("netloc"), kind.alias("kind"),
        F.floor(F.col("value") * 100).alias("in_bytes"), (F.col("event_id") % 97).alias("out_bytes"))


_LOG_SQL = """(SELECT event_id AS id, ts, 'h' || (user_id % 8) AS netloc, CASE WHEN event_type IN ('view', 'click')
  THEN 'scheduled' WHEN event_type = 'error' THEN 'dropped' WHEN event_type = 'signup' THEN 'robots' ELSE 'response' END
  AS kind, CAST(floor(value * 100) AS BIGINT) AS in_bytes, event_id % 97 AS out_bytes,
  CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-30 12:00:00')) / 604800000000) AS BIGINT) AS interval_no
  FROM events)"""
CRAWL_START = "2023-12-30 12:00:00"


def _start():
    return F.lit(CRAWL_START).cast("timestamp")


def a1(spark, sf):
    return accounting.bandwidth_report(crawl_log(spark, sf), _start(), 3_000_000)


def a1_running(spark, sf):
    return accounting.bandwidth_running(crawl_log(spark, sf), _start(), 3_000_000).select(
        "id", "interval_no", "running_bytes", "over_limit", "seconds_left")


def a2(spark, sf):
    return accounting.queue_totals(crawl_log(spark, sf))


def a2_running(spark, sf):
    return accounting.queue_running(crawl_log(spark, sf)).select("id", "netloc", "total")


def a3(spark, sf):
    return accounting.crawl_counts(inp.fetches(spark, sf), crawl_log(spark, sf))


def q12(spark, sf):
    """Pages under a batch of site prefixes."""
    pages = inp.table(spark, sf, "pages")
    return search.url_prefix(pages.filter("page_id % 10 = 0"), pages).select("page_id", "url")


QUERIES = {
    "g1_link_edges": g1, "g2_intra_site_depth": g2, "g3_start_pages": g3, "g4_seed_urls": g4, "g5_urls_exist": g5,
    "g6_build_frontier": g6, "g7_parse_robots": g7, "g8_robots_allowed": g8, "g9_purge_disallowed": g9,
    "g10_stale_robots": g10, "g11_cleanup_pages": g11, "g12_robots_as_of": g12, "p1_upsert_pages": p1,
    "p1_upsert_keep_first_dead": p1_keep, "p2_collapse_fetches": p2, "p4_policies": p4, "p5_delete_pages": p5,
    "s1_scan_pages": s1, "s3_read_submissions": s3, "s4_write_pages": s4, "s5_drain_submissions": s5,
    "s6_write_index": s6, "b1_rate_limit": b1, "b1_rate_limit_drained": b1_drain, "b2_unique_pending": b2,
    "b3_submit_urls": b3, "b4_last_seen": b4, "a1_bandwidth_report": a1, "a1_bandwidth_running": a1_running,
    "a2_queue_totals": a2, "a2_queue_running": a2_running, "a3_crawl_counts": a3, "q12_url_prefix": q12,
}


def _limit_sql(limit: int, source: str, drain: int | None = None) -> str:
    """Rate limit, one row after the other."""
    key = "ip" if drain is None else f"ip, t // {drain}"
    return f"""RECURSIVE sub AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, id) AS rn,
        dense_rank() OVER (ORDER BY {key}) AS k FROM {source}),
      lim AS (SELECT k, rn, id, t AS last_ok, true AS accepted, 0::BIGINT AS wait_s FROM sub WHERE rn = 1
        UNION ALL SELECT s.k, s.rn, s.id, CASE WHEN s.t - l.last_ok >= {limit} THEN s.t ELSE l.last_ok END,
          s.t - l.last_ok >= {limit}, CASE WHEN s.t - l.last_ok >= {limit} THEN 0 ELSE {limit} - (s.t - l.last_ok) END
        FROM lim l JOIN sub s ON s.k = l.k AND s.rn = l.rn + 1)"""


_URL = "'http://s' || ({0} // 100) || '.geek/' || CASE WHEN {0} % 100 = 0 THEN '' ELSE 'p' || {0} END"

ORACLE = {
    "g1_link_edges": f"""WITH {inp.extract_ctes()}, {inp.LINKS_CTES} SELECT DISTINCT referrer, url,
        {inp.sql_site('referrer')} <> {inp.sql_site('url')} AS cross_site FROM lk""",
    "g2_intra_site_depth": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
        ed AS (SELECT p, d FROM (SELECT p_partkey AS p, unnest([p_partkey + 1, p_partkey + 3, CASE WHEN p_partkey % 97 = 5
          THEN (p_partkey * 37 + 11) % (SELECT n FROM n) END]) AS d FROM part) WHERE d < (SELECT n FROM n)),
        r AS (SELECT p_partkey AS p, 0 AS depth FROM part WHERE p_partkey % 100 = 0
          UNION SELECT d, CASE WHEN d // 100 <> r.p // 100 OR d % 100 = 0 THEN 0 ELSE depth + 1 END FROM r JOIN ed
          ON ed.p = r.p WHERE d // 100 <> r.p // 100 OR d % 100 = 0 OR depth < 5)
        SELECT {_URL.format('p')} AS url, min(depth) AS depth FROM r GROUP BY p""",
    "g3_start_pages": f"""SELECT url, depth FROM {FETCHES_SQL} WHERE depth = 0
        AND fetched_at <= TIMESTAMP '{NOW}' - INTERVAL 3 DAY""",
    "g4_seed_urls": """SELECT DISTINCT 'http://' || regexp_replace(url, '^https?://', '') AS url FROM pages
        EXCEPT SELECT url FROM pages""",
    "g5_urls_exist": """SELECT page_id, u AS url, k = 0 AND page_id % 3 > 0 AS known
        FROM (SELECT page_id, k, CASE k WHEN 0 THEN url ELSE url || '!' END AS u FROM pages, (VALUES (0), (1)) v(k))""",
    "g6_build_frontier": f"""WITH r AS (SELECT url, {inp.sql_canonical('url')} AS c, 0 AS s FROM pages WHERE page_id % 3 = 0
          UNION ALL SELECT url, {inp.sql_canonical('url')}, 1 FROM pages WHERE page_id % 2 = 0)
        SELECT url, 0 AS priority, false AS dont_filter, false AS normalised, false AS refresh_robots FROM (
          SELECT *, row_number() OVER (PARTITION BY c ORDER BY s, url) AS rn FROM r) WHERE rn = 1
        UNION ALL SELECT {_ORIGIN}, 1, true, false, true FROM {_SUBS_SQL}""",
    "g7_parse_robots": """SELECT url AS site, agent, r.allow, r.pattern, NULL::DOUBLE AS crawl_delay FROM (
          SELECT url, unnest(['a', 'bot' || page_id % 3]) AS agent, page_id FROM pages) p,
          (VALUES (false, '/x'), (true, '/')) AS v(allow, pattern),
          LATERAL (SELECT v.allow, CASE WHEN v.allow THEN '/' ELSE '/x' || page_id END AS pattern) r
        UNION ALL SELECT url, '*', false, '', 2.5 FROM pages UNION ALL SELECT url, 'slow', NULL, NULL, 9 FROM pages""",
    "g8_robots_allowed": f"SELECT page_id, url, {_RULES_SQL} AS allowed FROM {_PATHS}",
    "g9_purge_disallowed": f"""SELECT page_id, url FROM {_PATHS} WHERE {_RULES_SQL}
        OR {inp.sql_site('url')} = {q(SITES[0])}""",
    "g10_stale_robots": """SELECT 'h' || (user_id % 8) AS host, max(ts) AS fetched_at FROM events
        WHERE event_type = 'signup' GROUP BY 1
        HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 7200 SECOND OR host = 'h3'""",
    "g11_cleanup_pages": f"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://www\\.')
        AND {inp.sql_label('url')} IN ('org', 'net') THEN 'kept' ELSE 'deleted' END AS fate FROM pages""",
    "g12_robots_as_of": """WITH r AS (SELECT event_id, 'h' || (user_id % 8) AS host, ts FROM events
          WHERE event_type <> 'signup'),
        s AS (SELECT event_id AS snapshot, 'h' || (user_id % 8) AS host, ts AS got FROM events WHERE event_type = 'signup')
        SELECT event_id, r.host, ts, CASE WHEN ts - got <= INTERVAL 7200 SECOND THEN snapshot END AS snapshot
        FROM r ASOF LEFT JOIN s ON r.host = s.host AND r.ts >= s.got""",
    "p1_upsert_pages": _upsert_sql(),
    "p1_upsert_keep_first_dead": _upsert_sql("coalesce(dead_since, n.at)"),
    "p2_collapse_fetches": """WITH e AS (SELECT *, 'http://u.geek/' || (user_id % 100) AS url, event_type <> 'error' AS alive,
          CAST(event_id % 6 AS INTEGER) AS depth FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS rn,
          row_number() OVER (PARTITION BY url ORDER BY alive DESC, CASE WHEN alive THEN ts END DESC, ts) AS pick FROM e)
        SELECT url, min(depth) FILTER (alive OR rn = 1) AS depth, max('t' || event_id) FILTER (pick = 1) AS title,
          max(props) FILTER (pick = 1) AS content, max(event_type) FILTER (pick = 1) AS description,
          min(ts) AS created_at, max(ts) AS last_updated, CASE WHEN arg_max(alive, rn) THEN NULL ELSE max(ts) END AS dead_since,
          bool_or(alive) AS has_alive, min(depth) FILTER (alive) AS alive_depth FROM r GROUP BY url""",
    "p4_policies": _upsert_sql(depth="greatest(o.depth, n.depth)", title="""CASE WHEN o.url IS NOT NULL
          AND length(o.title) >= length(n.title) THEN o.title ELSE n.title END"""),
    "p5_delete_pages": "SELECT page_id, url FROM pages WHERE page_id % 4 <> 1",
    "s1_scan_pages": "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')",
    "s3_read_submissions": f"SELECT id, url, ip, t AS timestamp FROM {_SUBS_SQL}",
    "s4_write_pages": _upsert_sql(),
    "s5_drain_submissions": f"SELECT id, url FROM {_SUBS_SQL} WHERE t >= 1705000000",
    "s6_write_index": f"""WITH {inp.postings_ctes(fields=('title', 'content'))} SELECT field, term, doc, tf,
        CAST(field_len AS INTEGER) AS field_len, count(*) OVER (PARTITION BY field, term) AS df,
        CAST(sum(tf) OVER (PARTITION BY field, term) AS BIGINT) AS total_tf FROM po""",
    "b1_rate_limit": f"WITH {_limit_sql(7200, _SUBS_SQL)} SELECT id, ip, accepted, wait_s FROM lim JOIN sub USING (id)",
    "b1_rate_limit_drained": f"WITH {_limit_sql(3600, _SUBS_SQL, 5400)} SELECT id, accepted, wait_s FROM lim",
    "b2_unique_pending": f"""SELECT id, url, row_number() OVER (PARTITION BY url ORDER BY t, id) > 1 AS duplicate
        FROM {_SUBS_SQL}""",
    "b3_submit_urls": f"""WITH {_limit_sql(3600, f'(SELECT id, {_ORIGIN} AS url, ip, t FROM {_SUBS_SQL} WHERE url <> '
                                                 "'no url')")},
        u AS (SELECT id, row_number() OVER (PARTITION BY url ORDER BY t, id) AS nth FROM lim JOIN sub USING (id)
          WHERE accepted)
        SELECT id, url, CASE WHEN NOT accepted THEN 'rate_limited' WHEN nth > 1 THEN 'duplicate' ELSE 'accepted' END AS status,
          wait_s FROM lim JOIN (SELECT id, url FROM sub) USING (id) LEFT JOIN u USING (id)
        UNION ALL SELECT id, NULL, 'bad_url', 0 FROM {_SUBS_SQL} WHERE url = 'no url'""",
    "b4_last_seen": f"SELECT ip, max(t) AS last_timestamp FROM {_SUBS_SQL} GROUP BY ip",
    "a1_bandwidth_report": f"""SELECT interval_no, TIMESTAMP '{CRAWL_START}' + INTERVAL 7 DAY * interval_no AS interval_start,
        sum(in_bytes)::BIGINT AS in_bytes, sum(out_bytes)::BIGINT AS out_bytes,
        sum(in_bytes + out_bytes)::BIGINT AS total_bytes, sum(in_bytes + out_bytes) > 3000000 AS over_limit
        FROM {_LOG_SQL} GROUP BY interval_no""",
    "a1_bandwidth_running": f"""SELECT id, interval_no, running_bytes, running_bytes > 3000000 AS over_limit,
        CAST(floor((epoch_us(TIMESTAMP '{CRAWL_START}') + (interval_no + 1) * 604800000000 - epoch_us(ts)) / 1000000)
          AS BIGINT) AS seconds_left FROM (SELECT *, sum(in_bytes + out_bytes) OVER (PARTITION BY interval_no
          ORDER BY ts, id)::BIGINT AS running_bytes FROM {_LOG_SQL})""",
    "a2_queue_totals": f"""SELECT netloc, sum(CASE kind WHEN 'scheduled' THEN 1 ELSE -1 END)::BIGINT AS total
        FROM {_LOG_SQL} WHERE kind IN ('scheduled', 'dropped') GROUP BY netloc""",
    "a2_queue_running": f"""SELECT id, netloc, sum(CASE kind WHEN 'scheduled' THEN 1 ELSE -1 END) OVER (PARTITION BY netloc
        ORDER BY ts, id)::BIGINT AS total FROM {_LOG_SQL} WHERE kind IN ('scheduled', 'dropped')""",
    "a3_crawl_counts": f"""SELECT 'depth_0_pages' AS counter, count(*) AS n FROM pages WHERE page_id % 6 = 0
        UNION ALL SELECT 'robots_fetches', count(*) FROM {_LOG_SQL} WHERE kind = 'robots'""",
    "q12_url_prefix": f"""SELECT page_id, url FROM pages WHERE {inp.sql_site('url')} IN (SELECT {inp.sql_site('url')}
        FROM pages WHERE page_id % 10 = 0)""",
}
