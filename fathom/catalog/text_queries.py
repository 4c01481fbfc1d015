"""Registered queries: text analysis and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.catalog import inputs as inp
from fathom.functions import text as tx
from fathom.operators import analysis, index

SPAN = {"doc_id": "doc_id", "pos": "pos", "start": "start_char", "end": "end_char"}


def _spans(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", "pos", F.col("start").alias("start_char"), F.col("end").alias("end_char"), *more)


def t1(spark, sf):
    return _spans(analysis.tokenize(inp.table(spark, sf, "documents"), "text", ["doc_id"]), "text")


def t2(spark, sf):
    toks = analysis.tokenize(inp.table(spark, sf, "documents"), "text", ["doc_id"])
    return toks.select("doc_id", "pos", "text", tx.strip_punct(F.col("text")).alias("joined"))


def t3(spark, sf):
    toks = analysis.tokenize(inp.table(spark, sf, "documents"), "text", ["doc_id"])
    return toks.select("doc_id", "pos", F.posexplode(tx.intraword(F.col("text"))).alias("n", "part"))


def t4(spark, sf):
    return _spans(analysis.with_variants(inp.table(spark, sf, "documents"), "text", ["doc_id"]), "text", "kind")


def t5(spark, sf):
    return _spans(analysis.dedupe_tokens(inp.table(spark, sf, "documents"), "text", ["doc_id"]), "text", "kind")


def t5_title(spark, sf):
    docs = inp.table(spark, sf, "documents")
    return analysis.dedupe_tokens(docs, "text", ["doc_id"], offsets=False).select("doc_id", "pos", "text", "kind")


def t6(spark, sf):
    toks = analysis.tokenize(inp.table(spark, sf, "documents"), "text", ["doc_id"])
    return toks.select("doc_id", "pos", F.lower("text").alias("term"))


def t7(spark, sf):
    toks = analysis.tokenize(inp.table(spark, sf, "documents"), "text", ["doc_id"])
    return toks.select("doc_id", "pos", tx.fold_accents(F.lower("text")).alias("term"))


def t8(spark, sf):
    return _spans(analysis.analyze(inp.table(spark, sf, "documents"), "text", ["doc_id"]), "term", "kind")


def _joined(postings: DataFrame) -> DataFrame:
    """Array columns as text, so that results compare as plain values."""
    spans = F.transform("offsets", lambda o: F.concat_ws("-", o["start"], o["end"]))
    return postings.select("doc", "field", "term", "tf", "field_len",
                           F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"),
                           F.array_join(spans, " ").alias("offsets"))


def i1(spark, sf):
    return _joined(index.build_postings(inp.doc_pages(spark, sf)))


def i1_counts(spark, sf):
    return index.build_frequencies(inp.doc_pages(spark, sf), fields=("title", "content", "description"))


def i2(spark, sf):
    urls = index.exact_terms(inp.table(spark, sf, "pages"))
    return _joined(urls)


def _content(spark, sf):
    return index.build_frequencies(inp.doc_pages(spark, sf), fields=("content",))


def i3(spark, sf):
    return index.doc_lengths(_content(spark, sf)).select("field", "doc", F.col("field_len"))


def i3_fields(spark, sf):
    s = index.field_stats(index.doc_lengths(index.build_frequencies(inp.doc_pages(spark, sf), fields=("title", "content", "description"))))
    return s.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def i4(spark, sf):
    return index.term_stats(_content(spark, sf))


def i5(spark, sf):
    """The index of one half, then the other half and changed pages of the first merged into it."""
    pages = inp.doc_pages(spark, sf)
    old = pages.filter("depth < 4").withColumn(
        "content", F.when(F.col("depth") == 3, F.lit("stale words")).otherwise(F.col("content")))
    batch = pages.filter("depth >= 3")
    build = lambda p: index.build_frequencies(p, fields=("content",))
    merged = index.merge_postings(build(old), batch.select(F.col("url").alias("doc")), build(batch))
    return merged.select("doc", "field", "term", "tf", "field_len")


def i6(spark, sf):
    shadowed = index.shadow_field(inp.doc_pages(spark, sf), "title")
    p = index.build_postings(shadowed, fields=("title", "phrase_title"))
    return p.select("doc", "field", "term", "tf")


QUERIES = {
    "t1_tokenize": t1, "t2_strip_punct": t2, "t3_intraword": t3, "t4_with_variants": t4, "t5_dedupe_tokens": t5,
    "t5_dedupe_tokens_title": t5_title, "t6_lower": t6, "t7_fold_accents": t7, "t8_analyze": t8,
    "i1_build_postings": i1, "i1_build_frequencies": i1_counts,
    "i2_exact_terms": i2, "i3_doc_lengths": i3, "i3_field_stats": i3_fields,
    "i4_term_stats": i4, "i5_merge_postings": i5, "i6_shadow_field": i6,
}

_DOC = inp.tokens_ctes("documents", "doc_id", "text")
_DOC_TITLE = inp.tokens_ctes("documents", "doc_id", "text", offsets=False)
_CONTENT = inp.postings_ctes()
_ALL = inp.postings_ctes(fields=("title", "content", "description"))


def _postings_sql(field: str) -> str:
    return f"""SELECT doc, '{field}' AS field, term, CAST(count(*) AS INTEGER) AS tf,
  CAST(sum(count(*)) OVER (PARTITION BY doc) AS INTEGER) AS field_len,
  string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos, start_char, end_char) AS positions,
  string_agg(start_char || '-' || end_char, ' ' ORDER BY pos, start_char, end_char) AS offsets
  FROM {field}_an GROUP BY doc, term"""


ORACLE = {
    "t1_tokenize": f"WITH {_DOC} SELECT doc AS doc_id, pos, start_char, end_char, text FROM tk",
    "t2_strip_punct": f"""WITH {_DOC} SELECT doc AS doc_id, pos, text,
        regexp_replace(text, {inp.q(tx.NON_WORD)}, '', 'g') AS joined FROM tk""",
    "t3_intraword": f"WITH {_DOC} SELECT doc AS doc_id, pos, CAST(n - 1 AS INTEGER) AS n, part FROM pa",
    "t4_with_variants": f"WITH {_DOC} SELECT doc AS doc_id, pos, start_char, end_char, text, kind FROM va",
    "t5_dedupe_tokens": f"WITH {_DOC} SELECT doc AS doc_id, pos, start_char, end_char, text, kind FROM dd",
    "t5_dedupe_tokens_title": f"WITH {_DOC_TITLE} SELECT doc AS doc_id, pos, text, kind FROM dd",
    "t6_lower": f"WITH {_DOC} SELECT doc AS doc_id, pos, lower(text) AS term FROM tk",
    "t7_fold_accents": f"""WITH {_DOC} SELECT doc AS doc_id, pos,
        translate(lower(text), {inp.q(tx.FOLD_FROM)}, {inp.q(tx.FOLD_TO)}) AS term FROM tk""",
    "t8_analyze": f"WITH {_DOC} SELECT doc AS doc_id, pos, start_char, end_char, term, kind FROM an",
    "i1_build_postings": f"WITH {_ALL} " + " UNION ALL ".join(
        f"({_postings_sql(f)})" for f in ("title", "content", "description")),
    "i1_build_frequencies": f"WITH {_ALL} SELECT doc, field, term, tf, field_len FROM po",
    "i2_exact_terms": """SELECT url AS doc, 'url' AS field, url AS term, 1 AS tf, 1 AS field_len, '0' AS positions,
        '0-' || length(url) AS offsets FROM pages""",
    "i3_doc_lengths": f"WITH {_CONTENT} SELECT field, doc, sum(tf)::BIGINT AS field_len FROM po GROUP BY field, doc",
    "i3_field_stats": f"""WITH {_ALL} SELECT field, count(*) AS n_docs, round(avg(field_len), 6) AS avg_len
        FROM (SELECT DISTINCT field, doc, field_len FROM po) GROUP BY field""",
    "i4_term_stats": f"""WITH {_CONTENT} SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS total_tf
        FROM po GROUP BY field, term""",
    "i5_merge_postings": f"WITH {_CONTENT} SELECT doc, field, term, tf, field_len FROM po",
    "i6_shadow_field": "WITH " + inp.postings_ctes(fields=("title",)) + """
        SELECT doc, f.field, term, tf FROM po, (VALUES ('title'), ('phrase_title')) AS f(field)""",
}
