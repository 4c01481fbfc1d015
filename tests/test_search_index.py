"""Nested queries, query text, and the index parts for best results, phrases and wildcards, against plain evaluation."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fathom.operators import index, phrases, query_trees, search, term_grams, top_blocks
from fathom.sources import page_store

FIELDS = {"url": "exact", "depth": "number", "title": "text", "content": "text", "description": "text"}


@pytest.fixture(scope="module")
def corpus(spark):
    """Few words, so that queries of all shapes have hits; repeated texts, so that scores tie."""
    rng = random.Random(11)
    words = ["red", "blue", "cat", "dog", "of", "the", "tree", "a-b", "étoile", "x1"]
    weights = [3, 3, 2, 2, 30, 40, 1, 1, 1, 1]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 8, 20, 60])))
        rows.append((f"http://h{i % 5}/{i:03d}", i % 4, " ".join(rng.choices(words, k=3)), text if i % 9 else "red cat of the tree", f"d {i % 3}"))
    rows.append(("http://h/none", 0, None, None, None))
    return spark.createDataFrame(rows, "url string, depth int, title string, content string, description string").cache()


@pytest.fixture(scope="module")
def full(corpus):
    return index.make_index(corpus, fields=("title", "content", "url"), positions=True)


# ---- query text -----------------------------------------------------------------------------------------------------------

def shape(text):
    """The tree of a text in brackets: each child behind a sign for what it is to its parent."""
    rows = query_trees.parse(text, FIELDS, "content")
    sign = {"must": "+", "should": "", "filter": "~", "must_not": "-"}

    def show(node):
        kind, field, value = next(r[3:] for r in rows if r[0] == node)
        if kind == "group":
            return "(" + " ".join(sign[r[2]] + show(r[0]) for r in rows if r[1] == node) + ")"
        return ("" if field == "content" else f"{field}:") + {"phrase": f'"{value}"', "term": value}.get(kind, f"{kind}={value}")

    return show(0) if rows else ""


@pytest.mark.parametrize("text, want", [
    ("a b", "(a b)"), ("+a -b c", "(+a -b c)"), ("a AND b", "(+a +b)"), ("a AND b AND c", "(+a +b +c)"), ("a OR b", "(a b)"),
    ("a AND b OR c d", "(((+a +b) c) d)"), ("a & b | c", "((+a +b) c)"), ("a ANDNOT b", "(+a -b)"), ("a &! b", "(+a -b)"),
    ("a &~ b", "(+a b)"), ("a REQUIRE b", "(+a ~b)"), ("a ANDMAYBE (b REQUIRE c)", "(+a (+b ~c))"), ("NOT a", "(-a)"),
    ("a AND NOT b", "(+a -b)"), ("a OR NOT b", "(a -b)"), ("-(a b) c", "(-(a b) c)"), ('"a b" c', '("a b" c)'), ('"a b', '("a b")'),
    ("'a b' it's", "(a b it's)"), ("title:a", "(title:a)"), ("title:(a b) c", "((title:a title:b) c)"), ('title:"a b"', '(title:"a b")'),
    ("depth:3", "(depth:number=3)"), ("url:http://x/y", "(url:exact=http://x/y)"), ("http://x:80/y", "(http://x:80/y)"),
    ("w* th?s", "(wildcard=w* wildcard=th?s)"), ("url:http*", "(url:wildcard=http*)"), ("((a", "(a)"), ("a)) b", "(a b)"), ("()", ""),
    ("AND a OR", "(a)"), ("a AND OR b", "(a b)"), ("and or", "(and or)"), ("*** ... -", "(wildcard=***)"), ("", ""), (None, ""), ("a-b +c", "(a-b +c)"),
])
def test_query_text(text, want):
    assert shape(text) == want


def test_deep_brackets_do_not_overflow():
    text = "(" * 5000 + "a b" + ")" * 5000
    assert shape(text) == "(a b)" and len(query_trees.parse("(a " * 3000, FIELDS, "content")) > 3000


# ---- trees ------------------------------------------------------------------------------------------------------------------

def leaf_hits(node, postings, rows):
    """Documents of a leaf and how many of its units match."""
    _, _, _, kind, field, text = node
    if kind == "number":
        return {r.url: 1 for r in rows if r.depth == int(text)}
    if kind == "exact":
        return {d: 1 for d in postings.get((field, text), {})}
    if kind == "wildcard":
        pattern = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in text), re.DOTALL)
        return {d: 1 for (f, t), docs in postings.items() if f == field and pattern.fullmatch(t) for d in docs}
    words = text.split()
    if kind == "phrase":
        places = [{(d, p - i) for d, at in postings.get((field, w), {}).items() for p in at} for i, w in enumerate(words)]
        return {d: 1 for d, _ in set.intersection(*places)}
    out = {}
    for w in words:
        for d in postings.get((field, w), {}):
            out[d] = out.get(d, 0) + 1
    return out


def tree_hits(rows, node, postings, pages):
    own = next(r for r in rows if r[0] == node)
    if own[3] != "group":
        return leaf_hits(own, postings, pages)
    parts = [(r[2], tree_hits(rows, r[0], postings, pages)) for r in rows if r[1] == node]
    needed = [h for o, h in parts if o in ("must", "filter")]
    docs = set.intersection(*map(set, needed)) if needed else set().union(*[h for o, h in parts if o == "should"])
    docs -= set().union(*[h for o, h in parts if o == "must_not"])
    return {d: sum(h.get(d, 0) for o, h in parts if o in ("must", "should")) for d in docs}


def test_random_trees(spark, corpus, full):
    rng = random.Random(3)
    leaves = [("term", "content", "red"), ("term", "content", "cat"), ("term", "content", "tree"), ("term", "title", "dog"), ("term", "content", "blue dog"),
              ("phrase", "content", "of the"), ("phrase", "title", "red cat"), ("wildcard", "content", "?tree*"), ("wildcard", "title", "b*e"),
              ("number", "depth", "2"), ("exact", "url", "http://h1/001"), ("term", "content", "missing")]

    def grow(rows, parent, occur, depth):
        node = len(rows)
        if depth and (parent is None or rng.random() < 0.6):
            rows.append((node, parent, occur, "group", None, None))
            for _ in range(rng.randint(1, 3)):
                grow(rows, node, rng.choices(query_trees.OCCURS, [3, 4, 1, 2])[0], depth - 1)
        else:
            rows.append((node, parent, occur, *rng.choice(leaves)))

    trees = {}
    for query_id in range(40):
        trees[query_id] = []
        grow(trees[query_id], None, "should", rng.randint(1, 4))
    nodes = spark.createDataFrame([(q, *r) for q, rows in trees.items() for r in rows], query_trees.NODE)
    postings = {}
    for r in full.postings.collect():
        postings.setdefault((r.field, r.term), {})[r.doc] = r.positions
    pages = corpus.collect()
    scores, _ = query_trees.tree_scores(nodes, corpus, full)
    got = {}
    for r in scores.collect():
        got.setdefault(r.query_id, {})[r.doc] = r.matched
    want = {q: tree_hits(rows, 0, postings, pages) for q, rows in trees.items()}
    # A query all of whose scoring leaves are under filters or exclusions has nothing to rank by.
    live = {}
    for q, rows in trees.items():
        adds = {None: True}
        for node, parent, occur, kind, *_ in rows:
            adds[node] = adds[parent] and occur in ("must", "should")
            live[q] = live.get(q, False) or kind != "group" and adds[node]
    assert got == {q: hits for q, hits in want.items() if hits and live[q]} and len(got) > 15


def test_broken_trees_are_errors(spark, corpus, full):
    def run(rows):
        return query_trees.tree_scores(spark.createDataFrame(rows, query_trees.NODE), corpus, full)[0].count()

    with pytest.raises(ValueError, match="no group above"):
        run([(1, 0, None, "should", "group", None, None), (1, 1, 5, "should", "term", "content", "red")])
    with pytest.raises(ValueError, match="kinds"):
        run([(1, 0, None, "should", "group", None, None), (1, 1, 0, "should", "near", "content", "red")])
    with pytest.raises(ValueError, match="root"):
        run([(1, 0, None, "should", "term", "content", "red")])
    assert query_trees.tree_scores(spark.createDataFrame([], query_trees.NODE), corpus, full)[0].count() == 0


def test_reply_to_query_text(spark, corpus):
    asked = spark.createDataFrame([(1, '"red cat"'), (2, "***"), (3, "missing"), (4, "the &! of"), (5, None)], "query_id int, q string")
    reply = {r.query_id: r for r in query_trees.search_text(asked, corpus).collect()}
    assert [reply[i].valid for i in range(1, 6)] == [True, False, True, True, False]
    assert not reply[2].results and not reply[3].results and reply[3].total == 0 and reply[3].is_last
    texts = {r.url: r.content for r in corpus.collect()}
    hits = [u for u, t in texts.items() if t and re.search(r"\bred cat\b", t)]
    assert len(reply[1].results) == 10 and not reply[1].exact and reply[1].maxpage == -(-len(hits) // 10) and reply[1].total == reply[1].maxpage * 10
    assert [r.rn for r in reply[1].results] == list(range(1, 11))
    for r in reply[1].results:  # only where the whole phrase stands
        marked = re.findall(r"<strong>(\w+)</strong>", r.snippet)
        assert r.url in hits and marked and marked[::2] == ["red"] * (len(marked) // 2) and marked[1::2] == ["cat"] * (len(marked) // 2)
    only = [u for u, t in texts.items() if t and " the " in f" {t} " and " of " not in f" {t} "]
    assert {r.url for r in reply[4].results} <= set(only) and reply[4].maxpage == -(-len(only) // 10)
    last = query_trees.search_text(asked, corpus, pagenum=1000).filter("query_id = 1").first()
    assert last.is_last and last.exact and last.total == len(hits) and last.pagenum == last.maxpage and len(last.results) == (len(hits) - 1) % 10 + 1


# ---- best results by blocks ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("index"))
    postings = index.build_postings(corpus, fields=("title", "content")).cache()
    stats = index.field_stats(index.doc_lengths(postings))
    frequent = phrases.frequent_terms(index.term_stats(postings), stats, share=0.6)
    page_store.write_index(postings, place, buckets=4, extras=True, pairs=phrases.pair_postings(corpus, frequent, fields=("title", "content")))
    return page_store.read_index(spark, place)


@pytest.mark.parametrize("k", [1, 10, 500])
def test_blocks_give_the_best_results(spark, stored, k):
    asked = search.query_terms(spark.createDataFrame([
        (1, "should", "content", "the of"), (2, "should", "content", "red tree"), (2, "must", "content", "the"), (2, "must_not", "content", "blue"),
        (3, "should", "title", "cat"), (3, "should", "content", "cat dog étoile"), (4, "should", "content", "missing"), (5, "must_not", "content", "the"),
        (6, "must", "content", "missing"), (6, "should", "content", "red")], "query_id int, occur string, field string, q string"))
    want = search.rank(asked, stored.postings, stored.dictionary, stored.stats).join(
        search.match_clauses(asked, stored.postings), ["query_id", "doc"], "left_semi")
    got, chosen = top_blocks.top_scores(asked, stored.lookup(asked), k)
    pages = [sorted((r.query_id, r.rn, r.doc, r.score) for r in search.search_page(s.select("query_id", "doc", "score"), 1, k).collect()) for s in (want, got)]
    assert pages[0] == pages[1] and {p[0] for p in pages[0]} == {1, 2, 3}
    read = {r.query_id: (r.scored, r.matching) for r in top_blocks.postings_read(asked, stored, chosen).collect()}
    if k == 500:
        assert read[1][0] == read[1][1]  # all are wanted


def test_blocks_leave_most_postings_unread(spark):
    """Words that every page has, much more of them in some."""
    rng = random.Random(1)
    rows = [(f"u{i:05d}", " ".join(["the"] * rng.randint(1, 3 + 40 * (i % 50 == 0)) + ["of"] * rng.randint(1, 3) + [f"w{rng.randint(0, 400)}" for _ in range(30)]))
            for i in range(3000)]
    postings = index.build_frequencies(spark.createDataFrame(rows, "url string, content string")).cache()
    ix = index.Index(postings, index.term_stats(postings), index.field_stats(index.doc_lengths(postings)))
    ix = replace(ix, blocks=top_blocks.build_blocks(postings, ix.stats).cache())
    asked = search.query_terms(spark.createDataFrame([(1, "the of"), (2, "the")], "query_id int, q string"))
    got, chosen = top_blocks.top_scores(asked, ix, 10)
    want = search.rank(asked, ix.postings, ix.dictionary, ix.stats)
    pages = [sorted(map(tuple, search.search_page(s.select("query_id", "doc", "score")).collect())) for s in (want, got)]
    assert pages[0] == pages[1]
    read = {r.query_id: (r.scored, r.matching) for r in top_blocks.postings_read(asked, ix, chosen).collect()}
    assert read[1][1] == 6000 and read[1][0] < 2000 and read[2][1] == 3000 and read[2][0] < 600
    assert ix.blocks.filter(F.size("postings") > 1 << top_blocks.BLOCK_BITS).count() == 0


# ---- phrases --------------------------------------------------------------------------------------------------------------------

def test_phrases_by_pairs(spark, corpus, stored):
    asked = search.phrase_terms(spark.createDataFrame([
        (1, "of the"), (2, "the the"), (3, "red cat of the tree"), (4, "étoile"), (5, "a-b the"), (6, "of the of"), (7, "missing the"),
        (8, "the the the of of"), (9, "tree étoile"), (10, "of missing")], "query_id int, q string"))
    for field in ("content", "title"):
        want = search.phrase(asked, stored.postings, field)
        got = phrases.phrase(asked, stored.postings, stored.dictionary, stored.pairs, field)
        rows = [sorted(map(tuple, x.select("query_id", "doc", "places").collect())) for x in (want, got)]
        assert rows[0] == rows[1] and len(rows[0]) > 50
        # Pairs of more words give the same.
        every = phrases.pair_postings(corpus, phrases.frequent_terms(stored.dictionary, stored.stats, 0.01), fields=(field,))
        got = phrases.phrase(asked, stored.postings, stored.dictionary, phrases.Pairs(every, phrases.pair_counts(every)), field)
        assert sorted(map(tuple, got.select("query_id", "doc", "places").collect())) == rows[0]
    units = {(r.query_id, r.first, r.second) for r in phrases.phrase_units(asked, stored.dictionary, stored.pairs).collect()}
    assert {u for u in units if u[0] in (1, 3)} == {(1, "of", "the"), (3, "red", None), (3, "cat", None), (3, "of", "the"), (3, "tree", None)}


def test_probing_a_frequent_word_only_in_the_documents_of_a_rare_one(spark, stored):
    asked = search.phrase_terms(spark.createDataFrame([(1, "étoile the")], "query_id int, q string"))
    units = phrases.phrase_units(asked, stored.dictionary, stored.pairs).collect()
    assert [u.first for u in sorted(units, key=lambda u: u.rn)] == ["etoile", "the"]


# ---- wildcards --------------------------------------------------------------------------------------------------------------------

def test_wildcards_by_grams(spark):
    rng = random.Random(8)
    terms = {"".join(rng.choices("abcé\U0001F600x.", k=rng.randint(1, 7))) for _ in range(900)} | {"a", "less", "endless", "lessen", "x" * 3000}
    dictionary = spark.createDataFrame([(f, t) for f in ("content", "title") for t in sorted(terms)], "field string, term string")
    grams = term_grams.term_grams(dictionary).cache()
    ix = term_grams.TermGrams(grams, term_grams.gram_counts(grams).cache())
    patterns = ["*less", "less*", "a?*b", "?", "??", "*", "*a*", "a*a", "?b?", "abc", "*.*", "*é", "zzz*", "*\U0001F600x*", "x*x*x", "**", "a*?"]
    asked = spark.createDataFrame([(i, "content" if i % 2 else "title", p) for i, p in enumerate(patterns)], "query_id int, field string, pattern string")
    got = sorted((r.query_id, r.field, r.term) for r in term_grams.wildcard_terms(asked, ix, dictionary).collect())
    as_regex = lambda p: re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p), re.DOTALL)
    assert got == sorted((i, "content" if i % 2 else "title", t) for i, p in enumerate(patterns) for t in terms if as_regex(p).fullmatch(t))
    few = term_grams.candidates(asked.filter("pattern = '*less'"), ix).count()
    assert few <= 4
    free = asked.select("pattern", F.size(term_grams.pattern_grams(F.col("pattern"))).alias("n")).filter("n = 0").collect()
    assert {r.pattern for r in free} == {"*", "**"}


def test_stored_grams_are_read_by_bucket(spark, stored):
    asked = spark.createDataFrame([(1, "content", "?tree*"), (2, "content", "tr?e"), (3, "content", "zz*")], "query_id int, field string, pattern string")
    got = term_grams.wildcard_terms(asked, stored.grams, stored.dictionary.limit(0)).collect()  # the dictionary is not needed
    assert [(r.query_id, r.term) for r in got] == [(2, "tree")]
    rows = stored.grams.rows_of(spark.createDataFrame([("content", "tre")], "field string, gram string"))
    plan = rows._jdf.queryExecution().toString()
    assert "EqualTo(gram,tre)" in plan and len(rows.inputFiles()) < len(stored.grams.grams.inputFiles())


def test_updates_leave_no_stale_extras(spark, corpus, tmp_path):
    place = str(tmp_path / "i")
    page_store.write_index(index.build_frequencies(corpus), place, buckets=2, extras=True)
    assert page_store.read_index(spark, place).blocks is not None
    new = index.build_frequencies(spark.createDataFrame([("http://h0/000", "zebra")], "url string, content string"))
    page_store.update_index(new, new.select("doc"), place)
    ix = page_store.read_index(spark, place)
    assert ix.blocks is None and ix.grams is None and ix.pairs is None
    hits = search.search(spark.createDataFrame([(1, "zebra")], "query_id int, q string"), corpus, index=ix).collect()
    assert [h.url for h in hits] == ["http://h0/000"]
