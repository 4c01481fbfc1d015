"""Own decisions and edge cases on inline rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import config
from fathom.catalog import stream_queries
from fathom.functions import html, urls
from fathom.functions import text as tx
from fathom.operators import analysis, extract, graph, robots, search, snippets, submissions, url_filters
from fathom.operators import pages as pg
from fathom.operators.index import build_postings, make_index
from fathom.operators.ingest import CrawlRules, screened
from fathom.plans import skew
from fathom.schemas import PAGE, SchemaMismatch, check_schema
from fathom.sources import page_store, tables
from fathom.streaming import jobs, keyed


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0][0]


def col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_tokens_keep_offsets(spark):
    text = "  hello.. wi-fi  fooBar9x don't ---\tÉa_b "
    df = spark.createDataFrame([(text,)], "t string")
    rows = analysis.analyze(df, "t", []).collect()
    assert [r.term for r in rows if r.kind == "original"] == ["hello", "wi-fi", "foobar9x", "don't", "ea_b"]
    assert [r.term for r in rows if r.pos == 1] == ["wi-fi", "wifi", "wi", "fi"]
    for r in rows:
        if r.kind != "joined":
            assert text[r.start:r.end].lower().replace("é", "e") == r.term


def test_offsets_in_a_long_text(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(5000)]
    text = "".join(w + rng.choice([" ", " - ", "\n\n", ", "]) for w in words)
    df = spark.createDataFrame([(text,)], "t string")
    rows = analysis.tokenize(df, "t", []).orderBy("pos").collect()
    assert [text[r.start:r.end] for r in rows] == words == [r.text for r in rows]


def test_repeats_collapse_in_titles_only(spark):
    df = spark.createDataFrame([("Foo foo Foo",)], "t string")
    assert [r.term for r in analysis.analyze(df, "t", []).collect()] == ["foo", "foo", "foo"]
    assert [r.term for r in analysis.analyze(df, "t", [], offsets=False).collect()] == ["foo", "foo"]


def test_empty_text_has_no_tokens(spark):
    df = spark.createDataFrame([("",), ("--- !",), (None,)], "t string")
    assert analysis.analyze(df, "t", []).count() == 0
    assert tx.term_list(df, "t", "x").select(F.explode("x")).count() == 0


def test_validity_and_origin(spark):
    given = ["http://a.geek/x?y#z", "http://a b/", "http://[::1]:80/", "no url", "http://a/%zz", "http:x", None]
    assert col(spark, given, urls.is_valid_url) == [True, False, True, False, False, True, False]
    origins = col(spark, ["http://example.geek/?q=1", "http://example.geek/#fragment", "https://U@Example.geek:443/d/",
                          "mailto:a@b", "geek", "http://a:81"], urls.url_origin)
    assert origins == ["http://example.geek"] * 2 + ["https://example.geek", "null", None, "http://a:81"]


def test_canonical_is_stable(spark):
    given = ["HTTP://A.geek", "http://a.geek/é?b=2&a=1&a=0&&c#f", "http://a.geek/p?x"]
    once = col(spark, given, urls.canonical_url)
    assert once == ["http://a.geek/", "http://a.geek/%C3%A9?a=0&a=1&b=2&c=", "http://a.geek/p?x="]
    assert col(spark, once, urls.canonical_url) == once


def test_resolve(spark):
    base = F.lit("http://a/b/c/d?q")
    given = ["g", "./g", "g/", "/g", "//g", "?y", "#s", "", "..", "../../g", "../../../g", "g;x=1/../y", "mailto:x"]
    assert col(spark, given, lambda h: urls.resolve_url(base, h)) == [
        "http://a/b/c/g", "http://a/b/c/g", "http://a/b/c/g/", "http://a/g", "http://g", "http://a/b/c/d?y",
        "http://a/b/c/d?q#s", "http://a/b/c/d?q", "http://a/b/", "http://a/g", "http://a/g", "http://a/b/c/y", "mailto:x"]


def test_filters(spark):
    df = spark.createDataFrame([(u,) for u in (
        "http://grep.geek/?q=x&s=DRP", "http://grep.geek/?q=x", "http://a.libre:8080/", "http://a.com/", "ftp://a.libre/")],
        "url string")
    urls_of = lambda d: [r.url for r in d.select("url").collect()]
    assert "http://grep.geek/?q=x&s=DRP" not in urls_of(url_filters.filter_url_patterns(df, deny=config.DENIED_URLS))
    assert len(urls_of(url_filters.filter_tlds(df, config.ALLOWED_TLDS))) == 3
    with pytest.raises(ValueError):
        url_filters.filter_tlds(df, ["a"], ["b"])
    with pytest.raises(ValueError):
        url_filters.filter_url_patterns(df)
    with pytest.raises(ValueError):
        url_filters.filter_mimetypes(df, ["text/none"])
    types = spark.createDataFrame([("http://a/x.png",), ("http://a/x.html",), ("http://a/x",)], "url string")
    assert urls_of(url_filters.filter_mimetypes(types)) == ["http://a/x.html", "http://a/x"]


def test_entities(spark):
    assert col(spark, ["a &amp;lt; &#233;&#xE9; &eacute; &nope; & b"], html.decode_entities) == [
        "a &lt; éé é &nope; & b"]


def test_template_rules(spark):
    page = """<html><footer><div class='ui container'><div class="ui left"><a href='http://x/gitea'>g</a></div></div></footer></html>"""
    df = spark.createDataFrame([("http://a/", page), ("http://a/x", page), ("http://a/y", "<p>")], "url string, body string")
    rows = {r.url: r.action for r in extract.template_action(df).collect()}
    assert rows == {"http://a/": "keep", "http://a/x": "to_root", "http://a/y": "keep"}


def test_elements_inside_each_other(spark):
    apache, reddit = config.TEMPLATE_RULES[1][1], config.TEMPLATE_RULES[0][1]
    head = '<DIV id="page-header">'
    pages = [(f"{head}<p class='a apache'></div>", apache, True), (f"{head}</div><p class=apache>", apache, False),
             (f"{head}<div><div></div></div><p class=apache></div>", apache, True), (f"{head}<div></div></div><div><p class=apache>", apache, False),
             (f"{head}<p><b title='</div>'><p class=apache >", apache, True), (f"{head}<script>'</div>'</script><p class=apache>", apache, True),
             (f"</div></div>{head}</div>{head}x<p class=apache>", apache, True), (f"<p class=apache>{head}</div>", apache, False),
             ("<span id=lib><span>x</span></span> text <span class=y id='reddit'>", reddit, True), ("<span id=lib><span id=reddit>", reddit, False),
             ("<span id=lib></span><i></i><span id=reddit>", reddit, False), ("<spanx id=lib></spanx><span id=reddit>", reddit, False),
             (None, apache, False), ("", apache, False), (head * 300 + "</div>" * 300 + "<p class=apache>", apache, False)]
    for body, steps, want in pages:
        df = spark.createDataFrame([(body,)], "body string")
        assert bool(df.select(html.has_nested(F.col("body"), steps)).first()[0]) == want, body


def test_totals(spark):
    scores = spark.createDataFrame([(1, f"d{i:02}", float(-i)) for i in range(23)], "query_id int, doc string, score double")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "*")], "query_id int, q string")
    want = {1: (30, False, 1), 2: (30, False, 2), 3: (23, True, 3), 9: (23, True, 3)}
    for page, expected in want.items():
        rows = {r.query_id: r for r in search.page_totals(queries, scores, page).collect()}
        assert (rows[1].total, rows[1].is_last, rows[1].pagenum) == expected
        assert (rows[2].total, rows[2].exact, rows[2].maxpage, rows[2].pagenum, rows[2].valid) == (0, True, 0, 0, True)
        assert not rows[3].valid
    seen = [r.doc for p in (1, 2, 3) for r in search.search_page(scores, p).orderBy("rn").collect()]
    assert seen == [f"d{i:02}" for i in range(23)]
    assert [r.rn for r in search.search_page(scores, 9).orderBy("rn").collect()] == [21, 22, 23]


def test_ranking_spreads_frequent_terms(spark):
    """Broadcast terms and shuffled terms give the same scores, also where a frequent term's postings are split."""
    rng = random.Random(7)
    rows = [(f"d{i}", " ".join(rng.choices("the a cat dog wi-fi X1".split(), k=rng.randint(1, 30)))) for i in range(120)]
    pages = spark.createDataFrame(rows, "url string, content string")
    ix = make_index(pages, fields=("content",))
    terms = search.query_terms(spark.createDataFrame([(1, "the wi-fi"), (2, "x1 dog nothing")], "query_id int, q string"))
    ways = [search.rank(terms, ix.postings, ix.dictionary, ix.stats, **how).select("query_id", "doc", "score", "matched")
            for how in ({"small": True}, {})]
    results = [sorted(map(tuple, w.collect())) for w in ways]
    assert len(results[0]) > 100 and results[0] == results[1]


def test_wildcards(spark):
    dictionary = spark.createDataFrame([("content", t) for t in ("cat", "cart", "c.t", "act", "dog")], "field string, term string")
    patterns = spark.createDataFrame([(1, "content", "c?t"), (2, "content", "*t"), (3, "content", "c.t"),
                                      (4, "content", "*"), (5, "content", "car*")], "query_id int, field string, pattern string")
    found = {}
    for r in search.wildcard_terms(patterns, dictionary).collect():
        found.setdefault(r.query_id, set()).add(r.term)
    assert found == {1: {"cat", "c.t"}, 2: {"cat", "cart", "c.t", "act"}, 3: {"c.t"},
                     4: {"cat", "cart", "c.t", "act", "dog"}, 5: {"cart"}}


def test_snippet(spark):
    body = "x" * 40 + " the <cat> & wi-fi " + "y" * 300 + " the end"
    df = spark.createDataFrame([(body, ["the", "wi", "wi-fi"])], "content string, words array<string>")
    got = snippets.with_snippet(df, "content", "words", "s").collect()[0].s
    assert got == ("x" * 24 + " <strong>the</strong> &lt;cat&gt; &amp; <strong>wi-fi</strong> " + "y" * 24 + "..."
                   + "y" * 24 + " <strong>the</strong> end")
    phrase = df.withColumn("words", F.array(F.lit("the"), F.lit("end")))
    strict = snippets.with_snippet(phrase, "content", "words", "s", strict_phrase=True).collect()[0].s
    assert strict == "y" * 24 + " <strong>the</strong> <strong>end</strong>"


def test_robots_empty_disallow(spark):
    files = spark.createDataFrame([("http://a", "User-agent: *\nDisallow: \nCrawl-delay: 1\n")], "site string, body string")
    rules = robots.parse_robots(files)
    assert [tuple(r) for r in rules.collect()] == [("http://a", "*", False, "", 1.0)]
    pages = spark.createDataFrame([("http://a/x",), ("http://b/x",)], "url string")
    assert robots.robots_allowed(pages, rules, "any").filter("allowed").count() == 2


def _by_hand(rows, limit, last=None):
    out, last = {}, dict(last or {})
    for i, ip, t in sorted(rows, key=lambda r: (r[2], r[0])):
        wait = limit - (t - last[ip]) if ip in last and t - last[ip] < limit else 0
        if not wait:
            last[ip] = t
        out[i] = (wait == 0, wait)
    return out, last


def test_rate_limit_example(spark):
    subs = spark.createDataFrame([(i, "u", 1, t) for i, t in enumerate((0, 10, 3599, 3600))],
                                 "id bigint, url string, ip bigint, timestamp bigint")
    rows = {r.id: (r.accepted, r.wait_s) for r in submissions.rate_limit(subs).collect()}
    assert rows == {0: (True, 0), 1: (False, 3590), 2: (False, 1), 3: (True, 0)}


def test_rate_limit_of_one_busy_client(spark):
    """One client sends most rows, densely and over many stretches; compared with the plain loop."""
    rng = random.Random(3)
    rows = [(i, 1 if rng.random() < 0.8 else rng.randint(2, 9), rng.randint(0, 60_000)) for i in range(20_000)]
    rows += [(20_000 + i, 1, 200_000 + 97 * i) for i in range(200)]
    subs = spark.createDataFrame([(i, "u", ip, t) for i, ip, t in rows],
                                 "id bigint, url string, ip bigint, timestamp bigint")
    for limit in (50, 700):
        got = {r.id: (r.accepted, r.wait_s) for r in submissions.rate_limit(subs, limit).collect()}
        assert got == _by_hand(rows, limit)[0]
    early, late = [r for r in rows if r[2] < 30_000], [r for r in rows if r[2] >= 30_000]
    _, last = _by_hand(early, 700)
    before = spark.createDataFrame(list(last.items()), "ip bigint, last_timestamp bigint")
    got = {r.id: (r.accepted, r.wait_s) for r in submissions.rate_limit(
        subs.filter("timestamp >= 30000"), 700, last=before).collect()}
    assert got == _by_hand(late, 700, last)[0]


def test_rate_limit_over_many_stretches(spark):
    """Clients over some thousand stretches: three levels of families, with and without earlier rows."""
    rng = random.Random(12)
    rows = []
    for ip, gap in ((1, 5000), (2, 300), (3, 40_000)):
        t = rng.randint(0, 4000)
        for _ in range(1500):
            t += rng.choice([0, 1, rng.randint(1, gap), rng.randint(1, gap) * rng.choice([1, 30])])
            rows.append((len(rows), ip, t))
    limit = 600
    df = spark.createDataFrame([(i, "u", ip, t) for i, ip, t in rows], "id bigint, url string, ip bigint, timestamp bigint")
    assert max(t for *_, t in rows) > limit * submissions.CHUNK_LIMITS << submissions.FAN * 2
    got = {r.id: (r.accepted, r.wait_s) for r in submissions.rate_limit(df, limit).collect()}
    assert got == _by_hand(rows, limit)[0]
    last = {1: rows[100][2], 2: 10**9}
    late = spark.createDataFrame(list(last.items()), "ip bigint, last_timestamp bigint")
    later = [r for r in rows if r[2] > last.get(r[1], 0) or r[1] == 2]
    accepted = {r.id for r in submissions.rate_limit(df.join(spark.createDataFrame([(r[0],) for r in later], "id bigint"), "id"), limit, last=late)
                .filter("accepted").collect()}
    want, free = set(), {ip: t + limit for ip, t in last.items()}
    for i, ip, t in sorted(later, key=lambda r: (r[2], r[0])):
        if t >= free.get(ip, 0):
            want.add(i)
            free[ip] = t + limit
    assert accepted == want
    assert submissions.rate_limit(df.limit(0), limit).count() == 0


def test_equal_rows_of_one_key_are_split(spark, tmp_path):
    """A URL that very many rows ask for is dealt to several tasks at run time."""
    asked = spark.range(60_000).select(F.when(F.col("id") < 50_000, "http://hot.geek/").otherwise(
        F.concat(F.lit("http://h"), F.col("id").cast("string"))).alias("url"), "id")
    pages = spark.range(50_000, 55_000).select(F.concat(F.lit("http://h"), F.col("id").cast("string")).alias("url")).union(
        spark.createDataFrame([("http://hot.geek/",)], "url string"))
    asked.write.parquet(str(tmp_path / "a"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "-1" if "Broadcast" in k else "16k")
        df = graph.urls_exist(spark.read.parquet(str(tmp_path / "a")), pages)
        rows = df.groupBy("known").count().collect()
        found = df.filter("id >= 0")
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r["known"]: r["count"] for r in rows} == {True: 55_000, False: 5_000}


def test_running_sum(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    for slots in ([70], [700, 70], [1000, 100, 10]):
        run = skew.running_sum(big, ["k"], [F.floor(F.col("id") / n) for n in slots], [F.col("id")], F.col("id"), "s")
        total = {}
        for r in sorted(run.collect(), key=lambda r: r.id):
            total[r.k] = total.get(r.k, 0) + r.id
            assert r.s == total[r.k]


def test_as_of_in_a_busy_slot(spark):
    requests = spark.range(2000).select(F.lit("h").alias("host"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    robots_log = spark.createDataFrame([("h", 100, "a"), ("h", 1500, "b"), ("x", 0, "c")], "host string, s int, snapshot string").select(
        "host", F.timestamp_seconds("s").alias("fetched_at"), "snapshot")
    got = {r.id: r.snapshot for r in robots.robots_as_of(requests, robots_log, 700, slot_s=90).collect()}
    assert got == {i: "b" if i >= 1500 else "a" if 100 <= i <= 800 else None for i in range(2000)}


def test_depth_with_a_hub(spark):
    hub = [("http://a.geek/h", f"http://a.geek/{i}") for i in range(300)]
    chain = [("http://a.geek/", "http://a.geek/h")] + [(f"http://a.geek/{i}", f"http://a.geek/{i + 1000}") for i in range(9)]
    other = [("http://a.geek/1000", "http://b.geek/x"), ("http://b.geek/x", "http://a.geek/5")]
    edges = spark.createDataFrame(hub + chain + other, "src string, dst string")
    starts = spark.createDataFrame([("http://a.geek/",)], "url string")
    got = {r.url: r.depth for r in graph.intra_site_depth(starts, edges, 3).collect()}
    assert got["http://a.geek/h"] == 1 and got["http://a.geek/7"] == 2 and got["http://a.geek/1000"] == 3
    assert got["http://b.geek/x"] == 0 and got["http://a.geek/5"] == 0 and got["http://a.geek/1005"] == 1


RECORD = "url string, depth int, title string, content string, description string, created_at timestamp, " \
         "last_updated timestamp, dead_since timestamp"


def _records(spark, rows):
    """(url, depth, title, hour, dead)"""
    df = spark.createDataFrame(rows, "url string, depth int, title string, h int, dead boolean")
    at = F.timestamp_seconds(F.col("h") * 3600)
    return df.select("url", "depth", "title", F.col("title").alias("content"), F.lit("").alias("description"),
                     at.alias("created_at"), at.alias("last_updated"), F.when(F.col("dead"), at).alias("dead_since"))


def test_upserts_in_parts_and_twice(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.randint(0, 8)}", rng.randint(0, 6), f"t{i}", i, rng.random() < 0.4) for i in range(80)]
    empty = spark.createDataFrame([], PAGE)

    def apply(current, part):
        return pg.upsert_pages(current, pg.collapse_fetches(_records(spark, part).withColumn("seq", F.lit(0))))

    key = lambda df: sorted(map(str, df.select(PAGE.fieldNames()).collect()))
    whole = apply(empty, rows)
    parts = apply(apply(empty, rows[:37]), rows[37:])
    serial = {}
    for url, depth, title, h, dead in rows:
        old = serial.get(url)
        if old is None:
            serial[url] = (depth, title, h, h, dead and h)
        else:
            serial[url] = (old[0] if dead else min(old[0], depth), old[1] if dead else title, old[2], h, dead and h)
    assert key(whole) == key(parts) == key(apply(whole, rows[60:]))
    assert {r.url: (r.depth, r.title) for r in whole.collect()} == {u: v[:2] for u, v in serial.items()}
    assert {r.url for r in whole.filter("dead_since is not null").collect()} == {u for u, v in serial.items() if v[4]}


def test_schema_check(spark):
    with pytest.raises(SchemaMismatch, match="missing fields: .'depth'.; extra fields: .'x'."):
        check_schema(spark.createDataFrame([], PAGE).withColumnRenamed("depth", "x"), PAGE)
    check_schema(spark.createDataFrame([], PAGE).withColumn("phrase_title", F.lit("")), PAGE)


def test_page_store(spark, tmp_path):
    path = str(tmp_path / "pages")
    page_store.write_pages(_records(spark, [(f"u{i}", 1, "a", 1, False) for i in range(20)]), path, buckets=4)
    batch = _records(spark, [("u3", 0, "b", 2, False), ("new", 2, "c", 2, False)])
    page_store.upsert_into(batch, path)
    page_store.upsert_into(batch, path)  # the same batch again
    got = {r.url: (r.depth, r.title) for r in page_store.read_pages(spark, path).collect()}
    assert len(got) == 21 and got["u3"] == (0, "b") and got["new"] == (2, "c") and got["u4"] == (1, "a")
    page_store.delete_from(spark.createDataFrame([(f"u{i}",) for i in range(20)], "url string"), path)
    assert [r.url for r in page_store.read_pages(spark, path).collect()] == ["new"]


def test_page_store_loses_nothing(spark, tmp_path):
    """Batches one after the other, a smaller rebuild, another number of buckets, removal of old builds, emptied buckets."""
    path = str(tmp_path / "pages")
    urls_of = lambda: sorted(r.url for r in page_store.read_pages(spark, path).collect())
    for url in ("u1", "u2", "u3", "u4"):
        page_store.upsert_into(_records(spark, [(url, 1, "a", 1, False)]), path, buckets=4)
    assert urls_of() == ["u1", "u2", "u3", "u4"] and page_store.page_buckets(spark, path) == 4
    page_store.write_pages(_records(spark, [(f"v{i}", 1, "a", 1, False) for i in range(9)]), path, buckets=8)
    page_store.write_pages(_records(spark, [("v1", 1, "a", 1, False)]), path, buckets=2)
    assert urls_of() == ["v1"]
    page_store.upsert_into(_records(spark, [("v2", 1, "a", 1, False)]), path, buckets=64)  # the table's own number counts
    assert urls_of() == ["v1", "v2"] and page_store.page_buckets(spark, path) == 2
    assert len(list((tmp_path / "pages").glob("build=*"))) == 1
    page_store.delete_from(spark.createDataFrame([("v1",)], "url string"), path)
    assert urls_of() == ["v2"]
    page_store.delete_from(spark.createDataFrame([("v2",)], "url string"), path)
    assert urls_of() == []
    page_store.upsert_into(_records(spark, [("v3", 1, "a", 1, False)]), path)
    assert urls_of() == ["v3"]


def test_index_store_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    page = lambda rows: spark.createDataFrame(rows, "url string, content string")
    posts = lambda rows: build_postings(page(rows), fields=("content",))
    docs = {f"d{i}": f"word{i} common" for i in range(12)}
    page_store.write_index(posts(list(docs.items())), path, buckets=4)
    docs = {"d1": "word1 common", "d2": "other"}
    page_store.write_index(posts(list(docs.items())), path, buckets=2)  # smaller, with other buckets

    def check():
        want = make_index(page(list(docs.items())), fields=("content",))
        asked = search.query_terms(spark.createDataFrame([(1, "common"), (2, "word1 other new3")], "query_id int, q string"))
        for ix in (page_store.read_index(spark, path), page_store.read_index(spark, path).lookup(asked)):
            rows = [sorted(map(tuple, search.rank(asked, i.postings, i.dictionary, i.stats).select("query_id", "doc", "score").collect()))
                    for i in (want, ix)]
            assert rows[0] == rows[1]
        for part, columns in (("dictionary", ["field", "term", "df", "total_tf"]), ("stats", ["field", "n_docs", "avg_len"])):
            a, b = (sorted(map(tuple, getattr(i, part).select(*columns).collect())) for i in (want, page_store.read_index(spark, path)))
            assert a == b

    check()
    for k in range(3):
        change = {"d1": f"common new{k}", f"e{k}": "other common"}
        docs |= change
        touched = spark.createDataFrame([(d,) for d in change], "doc string")
        for _ in range(2):  # run again after a failure
            page_store.update_index(posts(list(change.items())), touched, path)
        check()
    page_store.delete_from_index(spark.createDataFrame([("d1",), ("e0",)], "url string"), path)
    docs = {d: t for d, t in docs.items() if d not in ("d1", "e0")}
    check()


def test_stored_search_reads_only_its_partitions(spark, tmp_path):
    place = str(tmp_path)
    pages = _records(spark, [(f"http://a/{i}", 0, f"word{i} common", 1, False) for i in range(60)])
    page_store.write_pages(pages, f"{place}/p", buckets=16)
    page_store.write_index(build_postings(pages, fields=("content",)), f"{place}/i", buckets=16)
    ix = page_store.read_index(spark, f"{place}/i")
    terms = search.query_terms(spark.createDataFrame([(1, "word7")], "query_id int, q string"))
    plan = ix.lookup(terms).postings._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [" in plan and "word7" in plan
    assert len(ix.lookup(terms).postings.inputFiles()) < len(ix.postings.inputFiles())
    of = lambda keys: page_store.read_pages_of(spark, f"{place}/p", keys)
    found = of(spark.createDataFrame([("http://a/7",)], "url string"))
    assert len(found.inputFiles()) == 1 and "EqualTo(url,http://a/7)" in found._jdf.queryExecution().toString()
    hits = search.search(spark.createDataFrame([(1, "word7"), (2, "nothing")], "query_id int, q string"), of, index=ix).collect()
    # "word" is a part of every page's token, so other pages follow; the page with the whole token comes first.
    assert {h.query_id for h in hits} == {1}
    assert [(h.url, h.snippet) for h in hits if h.rn == 1] == [("http://a/7", "<strong>word7</strong> common")]


def test_robots_groups_without_rules(spark):
    files = spark.createDataFrame([("http://a.geek", "User-agent: bot\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /")], "site string, body string")
    rules = robots.parse_robots(files)
    assert {(r.agent, r.allow, r.pattern, r.crawl_delay) for r in rules.collect()} == {("bot", None, None, 5.0), ("*", False, "/", None)}
    asked = spark.createDataFrame([("http://a.geek/x",)], "url string")
    assert [robots.robots_allowed(asked, rules, agent).first().allowed for agent in ("my bot", "other")] == [True, False]


def test_purged_pages_are_not_found(spark, tmp_path):
    place = str(tmp_path)
    pages = _records(spark, [("http://a.geek/x", 0, "cat", 1, False), ("http://a.geek/y", 0, "cat", 1, False), ("http://b.geek/x", 0, "cat", 1, False)])
    page_store.write_pages(pages, f"{place}/p", buckets=2)
    page_store.write_index(build_postings(pages, fields=("content",)), f"{place}/i", buckets=2)
    rules = spark.createDataFrame([("http://a.geek", "*", False, "/x"), ("http://b.geek", "*", False, "/x")],
                                  "site string, agent string, allow boolean, pattern string")
    gone = robots.disallowed_urls(pages, rules, spark.createDataFrame([("http://a.geek",)], "site string"), "bot")
    page_store.delete_from(gone, f"{place}/p")
    page_store.delete_from_index(gone, f"{place}/i")
    hits = search.search(spark.createDataFrame([(1, "cat")], "query_id int, q string"), page_store.read_pages(spark, f"{place}/p"),
                         index=page_store.read_index(spark, f"{place}/i")).collect()
    assert [h.url for h in hits] == ["http://a.geek/y", "http://b.geek/x"]


def test_ingest_filters_in_order(spark):
    page = """<div id='page-header'><p class="apache">x</p></div>"""
    gitea = "<footer><div class='ui container'><div class='left ui'><a href=http://gitea.io>g</a></div></div></footer>"
    rows = [("http://a.geek/1", "ok"), ("http://a.com/1", "other TLD"), ("http://a.geek/1.png", "image"), ("not a url", "x"),
            ("http://grep.geek/?q=x&s=DRP", "denied"), ("http://a.geek/manual", page), ("http://a.geek/repo/x", gitea), ("http://b.geek/", gitea)]
    kept, instead = screened(spark.createDataFrame(rows, "url string, body string"), CrawlRules())
    assert sorted(r.url for r in kept.collect()) == ["http://a.geek/1", "http://b.geek/"]
    assert [r.url for r in instead.collect()] == ["http://a.geek/"]


def test_unknown_fields_are_errors(spark):
    pages = spark.createDataFrame([("u", "t")], "url string, content string")
    asked = spark.createDataFrame([(1, "a", "titel")], "query_id int, q string, field string")
    with pytest.raises(ValueError, match="titel"):
        search.search(asked, pages)


def test_scan_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "p")
    page_store.write_pages(_records(spark, [("http://a", 0, "a", 1, False)]), path, buckets=2)
    plan = tables.scan_pages(spark, path, F.col("url").startswith("http:"), columns=["url"])._jdf.queryExecution().toString()
    assert "StringStartsWith(url,http:)" in plan and "ReadSchema: struct<url:string>" in plan


def test_streams_in_many_batches(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.geek/", i % 4, 37 * i) for i in range(300)]
    subs = spark.createDataFrame(rows, "id bigint, url string, ip bigint, timestamp bigint")
    for k in range(3):
        subs.filter(F.col("id").between(100 * k, 100 * k + 99)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = tables.stream_submissions(spark, str(tmp_path / "in/*"), max_files=1)
    jobs.stream_rate_limit(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "c"), 500).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out/batch=*"))
    assert len(list((tmp_path / "out").iterdir())) == 3
    assert {r.id: (r.accepted, r.wait_s) for r in out.collect()} == _by_hand([(i, ip, t) for i, _, ip, t in rows], 500)[0]


def test_ingest_with_index(spark, tmp_path):
    rows = [("http://a/1", 200, "<title>One</title><p>red cat</p>", "", 0, 1), ("http://a/2", 200, "<p>blue cat</p>", "", 1, 1),
            ("http://a/1", 200, "<title>One</title><p>green dog</p>", "", 0, 2)]
    schema = "url string, status int, body string, referrer string, depth int, h int"
    for k, part in enumerate((rows[:2], rows[2:])):
        df = spark.createDataFrame(part, schema).withColumn("fetched_at", F.timestamp_seconds(F.col("h") * 3600))
        df.drop("h").withColumn("in_bytes", F.lit(0).cast("bigint")).withColumn(
            "out_bytes", F.lit(0).cast("bigint")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = tables.stream_fetches(spark, str(tmp_path / "in/*"), max_files=1)
    pages, index = str(tmp_path / "pages"), str(tmp_path / "index")
    jobs.stream_ingest(stream, pages, str(tmp_path / "c"), index, buckets=2).awaitTermination()
    stored = page_store.read_index(spark, index)
    queries = spark.createDataFrame([(1, "cat"), (2, "Dog"), (3, "red")], "query_id int, q string")
    hits = search.search(queries, page_store.read_pages(spark, pages), index=stored).collect()
    assert sorted((h.query_id, h.url) for h in hits) == [(1, "http://a/2"), (2, "http://a/1")]
    assert [h.snippet for h in hits if h.query_id == 2] == ["green <strong>dog</strong>"]


def test_streams_over_empty_tables(spark, tmp_path):
    for name in ("events", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {name: run for name, run in stream_queries.QUERIES.items()}
    assert {name: run(spark, str(tmp_path)).count() for name, run in found.items()} == dict.fromkeys(found, 0)


def test_stream_source_has_many_files_and_one_order(spark, tmp_path):
    """Micro-batches follow each other in time, each of several files; no row is lost, null keys included."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = stream_queries._source(spark, str(tmp_path), "events")
    named = stream.withColumn("file", F.input_file_name())
    jobs.start(named, lambda df, n: seen.append([(r.file, r.ts) for r in df.select("file", "ts").collect()]), str(tmp_path / "c")).awaitTermination()
    assert len(seen) == stream_queries.PARTS and all(len({f for f, _ in part}) > 1 for part in seen)
    seen = [(part, [ts for _, ts in part]) for part in seen]
    assert sum(len(ts) for _, ts in seen) == events.count() + 3
    spans = [(min(t for t in ts if t), max(t for t in ts if t)) for _, ts in seen]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_keyed_rate_limit_resumes_and_forgets(spark, tmp_path):
    """Two runs of one stream: the second goes on from the first one's state, of which clients that no longer matter are gone."""
    rows = [(i, f"u{i}", 1 + i % 5 if i < 300 else 9, 1000 + 37 * i) for i in range(600)]
    subs = spark.createDataFrame(rows, "id bigint, url string, ip bigint, timestamp bigint")
    for run in range(2):
        subs.filter(F.col("id").between(300 * run, 300 * run + 299)).coalesce(1).write.parquet(str(tmp_path / f"in/{run}"))
        stream = spark.readStream.schema(subs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        jobs.start(keyed.keyed_rate_limit(stream, 500, 100), jobs.into_parquet(str(tmp_path / "out")), str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out/batch=*"))
    assert {r.id: (r.accepted, r.wait_s) for r in out.collect()} == _by_hand([(i, ip, t) for i, _, ip, t in rows], 500)[0]
    accepted, wait, last = keyed.decided(np.array([1, 2, 3]), np.array([10, 10, 700]), 100, 500)
    assert accepted.tolist() == [False, False, True] and wait.tolist() == [500, 500, 0] and last == 700
