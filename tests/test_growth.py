"""Work that has to grow no faster than the input: the shape of plans, and their results on odd rows."""

from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import analysis, graph, index, search, top_blocks
from fathom.plans import packed
from fathom.sources import page_store

ODD = ["", "  ...", "wi-fi WiFi wi-fi a.b a.b", "x x X 1a2 _ __ 9", "don't Don't éaux-é ONE", None]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _first_of(rows, key):
    seen, out = set(), []
    for r in rows:
        if key(r) not in seen:
            seen.add(key(r))
            out.append(r)
    return out


def test_variants_of_odd_texts_and_no_sort_of_a_text(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    every = {i: [tuple(v) for v in a] for i, a in docs.select(
        "id", F.flatten(F.transform(tx.tokens(F.col("t")), lambda t: tx.variants(t)))).collect() if a}
    plain = {i: [tuple(v) for v in a] for i, a in docs.select("id", F.flatten(F.transform(
        tx.tokens_without_offsets(F.col("t")), lambda t: tx.variants(t, False)))).collect() if a}

    def found(df):
        out = {}
        for r in df.collect():
            out.setdefault(r[0], []).append(tuple(r)[1:])
        return out

    assert found(analysis.with_variants(docs, "t", ["id"])) == every
    deduped = analysis.dedupe_tokens(docs, "t", ["id"])
    assert found(deduped) == {i: _first_of(a, lambda v: v[1:4]) for i, a in every.items()}
    assert found(analysis.dedupe_tokens(docs, "t", ["id"], offsets=False)) == {
        i: _first_of(a, lambda v: v[3]) for i, a in plain.items()}
    # Only variants of one token are compared; common tokens are not taken apart.
    assert "sort_array" not in _plan(deduped)
    assert "RLIKE" in _plan(analysis.with_variants(docs, "t", ["id"]))


def test_marked_postings_give_the_same_store(spark, tmp_path):
    texts = {"u1": "the cat the dog", "u2": "wi-fi wi-fi cat", "u3": "", "u4": "b a", "u5": "dog"}
    pages = spark.createDataFrame([(u, t, t[:3]) for u, t in texts.items()], "url string, content string, title string")
    both, stores = ("title", "content"), []
    for name, marked in (("plain", False), ("marked", True)):
        postings = index.build_postings(pages, fields=both, main=marked)
        page_store.write_index(postings, f"{tmp_path}/{name}", buckets=2, extras=True)
        stores.append(page_store.read_index(spark, f"{tmp_path}/{name}"))
    plain, marked = stores
    rows = lambda df: sorted(map(repr, df.collect()))
    for part in ("postings", "dictionary", "stats"):
        columns = getattr(plain, part).columns
        assert getattr(marked, part).columns == columns and rows(getattr(marked, part)) == rows(getattr(plain, part).select(columns))
    assert rows(marked.grams.grams) == rows(plain.grams.grams)
    inside = lambda ix: ix.blocks.select("field", "term", "best", "n", "postings")
    assert rows(inside(marked)) == rows(inside(plain))
    marks = index.build_frequencies(pages, fields=both, main=True).filter("main").collect()
    assert {(m.doc, m.field): m.term for m in marks if m.field == "content"} == {
        ("u1", "content"): "the", ("u2", "content"): "wifi", ("u4", "content"): "b", ("u5", "content"): "dog"}
    frequencies = index.build_frequencies(pages, fields=both)
    assert "Aggregate" not in _plan(frequencies)  # counted inside the row: no shuffle
    same = index.build_postings(pages, fields=both).select(frequencies.columns)
    assert rows(frequencies) == rows(same)


def test_depth_search_broadcasts_no_urls(spark, monkeypatch):
    plans, cut = [], graph.cut_lineage

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", recorded)
    name = lambda i: f"http://s{i // 4}.geek/" + (f"p{i}" if i % 4 else "")
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(11)] + [(name(5), name(5)), (name(2), name(10))], "src string, dst string")
    found = graph.intra_site_depth(spark.createDataFrame([(name(0),)], "url string"), edges, 2)
    assert {r.url: r.depth for r in found.collect()} == {name(0): 0, name(1): 1, name(2): 2, name(10): 0, name(11): 1}
    joins = [p for p in plans if "Join" in p]
    assert joins and not any("Broadcast" in p for p in joins)


def test_phrase_keeps_places_in_arrays(spark):
    texts = {"a": "x y x y x", "b": "y x", "c": "x x x", "d": "x y z x y"}
    pages = spark.createDataFrame(list(texts.items()), "url string, content string")
    phrases = [(1, "x y"), (2, "x x"), (3, "x"), (4, "x y z"), (5, "x q")]
    terms = search.phrase_terms(spark.createDataFrame(phrases, "query_id int, q string"))
    found = search.phrase(terms, index.build_postings(pages, fields=("content",)))
    want = {}
    for query_id, q in phrases:
        for doc, t in texts.items():
            words, own = t.split(), q.split()
            n = sum(words[i:i + len(own)] == own for i in range(len(words)))
            if n:
                want[query_id, doc] = n
    assert {(r.query_id, r.doc): r.places for r in found.collect()} == want
    rows = spark.createDataFrame([(1, 1, 0, "x")], "query_id int, n int, i int, term string")
    stored = spark.createDataFrame([("content", "x", "a", [0])], "field string, term string, doc string, positions array<int>")
    assert "Generate" not in _plan(search.phrase(rows, stored))


def test_packed_rows_come_back(spark, monkeypatch):
    monkeypatch.setattr(packed, "PACK_BYTES", 200)
    rows = [(i % 3, f, t, d, tf, n, places, start, [x + 3 for x in start] if start is not None else None, i % 2 == 0) for i, (f, t, d, tf, n, places, start) in enumerate([
        ("a", "éaux", "u1", 1, 5, [4], [9]), ("a", "", "u2", 300, 70000, [], []), (None, "x", "u1", -1, 5, [7, 3, 3], [70000, 1, 2]), ("b", None, None, 2, 1, None, None),
        ("b", "x", "u1", None, 5, [1], [2]), ("b", "x", "u3", 2**31 - 1, None, [1, 2**31 - 1], [-5, 0]), ("a", "x", "u9", 1, 1, [1, None], [0, 1])] * 5)]
    df = spark.createDataFrame(rows, "k int, field string, term string, doc string, tf int, field_len int, positions array<int>, start array<int>, end array<int>, main boolean")
    back = packed.unpacked(packed.packed(df, ["k"]), ["k"], df.schema)
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    numbered = df.filter("doc IS NOT NULL").select(F.substring("doc", 2, 1).cast("long").alias("doc"), "k", "field", "field_len", "tf")
    back = packed.unpacked(packed.packed(numbered, ["k"]), ["k"], numbered.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, numbered.collect()))


def test_packed_join_is_a_join(spark):
    left = spark.createDataFrame([("a", t, f"d{i}", i) for i in range(40) for t in ("x", "y", None, f"t{i % 7}")] + [("b", "x", "d", 0)],
                                 "field string, term string, doc string, tf int")
    right = spark.createDataFrame([("a", "x", 1), ("a", "t3", 2), ("b", "x", 3), ("b", "y", 4), ("a", None, 5)], "field string, term string, df int")
    want, on, size = sorted(map(repr, left.join(right, ["field", "term"]).collect())), ["field", "term"], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        found = packed.joined(left, right, on)
        assert "Join" not in _plan(found) and sorted(map(repr, found.collect())) == want and found.columns == left.join(right, on).columns
    finally:
        spark.conf.set(size, before)
    assert sorted(map(repr, packed.joined(left, right, on).collect())) == want


def test_builds_shuffle_packed_postings_and_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(f"u{i}", f"w{i % 5} w{i % 7} and {i}") for i in range(50)], "url string, content string")
    dealt, hint = [], type(pages).hint
    monkeypatch.setattr(type(pages), "hint", lambda df, name, *a: (dealt.append(df.columns) if name == "rebalance" else None, hint(df, name, *a))[1])
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle" in f.getName()}
    there = files()
    page_store.write_index(index.build_postings(pages, fields=("content",), main=True), f"{tmp_path}/i", buckets=2)
    assert dealt[0] == ["term_bucket", "piece"] and files() <= there
    stored = page_store.read_index(spark, f"{tmp_path}/i")
    blocks = top_blocks.build_blocks(stored.postings, stored.stats, lambda term: page_store.bucket(2, term), 2)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" not in plan and "SortMergeJoin" not in plan
    assert sum(r.n for r in blocks.collect()) == stored.postings.count()
