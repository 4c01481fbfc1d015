"""Text analysis in batches gives the tokens of the column expressions, and an index made for queries holds their terms alone."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from fathom.functions import batches
from fathom.functions import text as tx
from fathom.operators import index, phrases, query_trees, search, snippets

LETTERS = list("aAbB1_-. ,\t\néÉßİΣσς中  \x85\x1cǅʰ٠Ⅰ\U0001d400\U0001f600éx's")


def _texts():
    pick = random.Random(1)
    odd = ["".join(pick.choice(LETTERS) for _ in range(pick.choice([0, 1, 2, 5, 30, 80]))) for _ in range(400)]
    return [*odd, None, "", "...", "Wi-Fi wi-fi WIFI a-a A-a x_ _ab", "the The THE the the-the"]


def test_batches_are_as_the_column_expressions(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for offsets in (True, False):
        want = {r.i: sorted((x.pos, x.start, x.end, x.term, x.kind == "part") for x in r.x) for r in tx.analyzed(df, "t", "x", offsets).collect()}
        t = batches.analyzed(pa.array(texts, pa.string()), offsets)
        got = {i: [] for i in range(len(texts))}
        for doc, *rest, part, code in zip(*(a.tolist() for a in (t.doc, t.pos, t.start, t.end, t.part, t.code))):
            got[doc].append((*rest, t.terms[code], part if offsets else None))
        want = want if offsets else {i: [(*x[:4], None) for x in rows] for i, rows in want.items()}
        assert {i: sorted(x, key=str) for i, x in got.items()} == {i: sorted(x, key=str) for i, x in want.items()}
        assert t.lengths.tolist() == [len(want[i]) for i in range(len(texts))]


def test_broken_utf8_and_pieces_of_one_text():
    broken = pa.array([b"ab \xff cd", b"ef"], pa.binary()).view(pa.string())
    assert batches.analyzed(broken).terms == ["ab", "cd", "ef"]
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "b", "cc"]})
    assert [p.num_rows for p in batches.pieces([batch], ["t"], 2)] == [1, 2, 1]


def _pages(spark):
    rows = [("http://a/1", 1, "the cat", "the old cat sat on worthy mats", ""), ("http://a/2", 2, "dogs", "old the cat", "about"),
            ("http://a/3", 1, "", "worth the old the old cat", ""), ("http://a/4", 0, None, None, None)]
    return spark.createDataFrame(rows, "url string, depth int, title string, content string, description string")


def test_index_of_clauses_holds_what_they_name(spark):
    pages = _pages(spark)
    rows = [(1, 1, 1, "must", "content", "phrase", "the old"), (1, 1, 2, "should", "content", "wildcard", "wor?h*"), (2, 1, 3, "must", "title", "term", "dogs"),
            (3, 1, 4, "should", "url", "exact", "http://a/4"), (3, 1, 5, "should", "url", "wildcard", "*/3")]
    clauses = spark.createDataFrame(rows, "query_id int, grp int, clause int, occur string, field string, kind string, text string")
    fields = ("title", "content", "url")
    few, whole = search.index_of_clauses(clauses, pages, fields), index.make_index(pages, fields=fields, positions=True)
    assert {r.term for r in few.postings.collect()} == {"the", "old", "worth", "worthy", "dogs", "http://a/4", "http://a/3"}
    assert sorted(few.stats.collect()) == sorted(whole.stats.collect())
    answers = [sorted(search.clause_scores(clauses, pages, ix)[0].collect()) for ix in (few, whole)]
    assert answers[0] == answers[1] and {(r.query_id, r.doc) for r in answers[0]} == {
        (1, "http://a/1"), (1, "http://a/3"), (2, "http://a/2"), (3, "http://a/3"), (3, "http://a/4")}


def test_trees_without_phrases_need_no_other_index(spark):
    pages = _pages(spark)
    hits = query_trees.search_text(spark.createDataFrame([(1, "cat -sat")], "query_id int, q string"), pages).first()
    assert [h.url for h in hits.results] == ["http://a/2", "http://a/3"]


def test_scores_of_the_catalog_index_the_queries_terms_alone(spark):
    from fathom.catalog import inputs, search_queries

    ix = search_queries._index(spark, "/root/testdata/sf0.001")
    asked = {r.term for r in search.query_terms(inputs.queries_table(spark)).collect()}
    assert {r.term for r in ix.postings.select("term").distinct().collect()} <= asked


def test_pairs_and_fragments_are_made_in_batches(spark):
    pages = _pages(spark).withColumn("words", F.array(F.lit("old"), F.lit("cat"), F.lit("none")))
    known = spark.createDataFrame([("content", "the", 3), ("content", "old", 3), ("content", "cat", 3)], "field string, term string, df int")
    found = phrases.pair_postings(pages, known)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc[-1], r.first, r.second): r.positions for r in found.select("doc", F.col("first"), "second", "positions").collect() for r in [type("R", (), r.asDict())]}
    assert got == {("1", "the", "old"): [0], ("1", "old", "cat"): [1], ("2", "old", "the"): [0], ("2", "the", "cat"): [1],
                   ("3", "the", "old"): [1, 3], ("3", "old", "the"): [2], ("3", "old", "cat"): [4]}
    shown = {r.url[-1]: [[m.term for m in f] for f in r.frags] for r in snippets.with_fragments(pages, "content", "words", "frags").collect()}
    assert shown == {"1": [["old", "cat"]], "2": [["old", "cat"]], "3": [["old", "old", "cat"]], "4": []}
    plan = snippets.with_fragments(pages, "content", "words", "frags")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
