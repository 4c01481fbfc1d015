"""Input tables of the registered queries, derived from the given tables in Spark and, alike, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import html, urls
from fathom.functions import text as tx

START = "2024-01-01 00:00:00"
NOW = "2024-01-09 00:00:00"

# Queries as a table. The fourth has no word, the fifth no hit.
QUERIES = [(1, "The and thion"), (2, "le la éaux qui"), (3, "worthless wi-fi"), (4, "*** ..."), (5, "zzzzzz"),
           (6, "und der EIN"), (7, "de la que")]


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """SQL sub-select of literal rows."""
    def cell(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries_table(spark: SparkSession, rows: list[tuple] | None = None, schema: str = "query_id int, q string"):
    return spark.createDataFrame(rows or QUERIES, schema)


QUERIES_SQL = values(QUERIES, "query_id, q")


# ---- documents as page records ---------------------------------------------------------------------------------------

def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records from ``documents``. There is no title in the table: the field is derived as the text's first 60
    characters; the content is the whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("http://"), "source", F.lit(".geek/"), F.col("doc_id").cast("string")).alias("url"),
        (F.col("doc_id") % 6).cast("int").alias("depth"),
        F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), "lang")).otherwise("").alias("description"))


DOC_PAGES_SQL = """(SELECT 'http://' || source || '.geek/' || CAST(doc_id AS VARCHAR) AS url,
  CAST(doc_id % 6 AS INTEGER) AS depth, substring(text, 1, 60) AS title, text AS content,
  CASE WHEN doc_id % 2 = 0 THEN 'about ' || lang ELSE '' END AS description FROM documents)"""


# ---- text analysis in SQL ---------------------------------------------------------------------------------------------

def tokens_ctes(source: str, key: str, text: str, p: str = "", offsets: bool = True) -> str:
    """CTEs {p}tk: tokens, {p}va: variants, {p}dd: without repeats, {p}an: analysed terms."""
    tg, gap = q(tx.TOKEN_AND_GAP), q(tx.LEADING_GAP)
    pg, pgap = q(tx.PART_AND_GAP), q(tx.PART_LEADING_GAP)
    same = "doc, pos, start_char, end_char, text" if offsets else "doc, text"
    return f"""
{p}b AS (SELECT {key} AS doc, {text} AS text, length(regexp_extract({text}, {gap})) AS lead FROM {source} AS src),
{p}pc AS (SELECT doc, lead, unnest(regexp_extract_all(text, {tg}, 0)) AS piece,
  unnest(regexp_extract_all(text, {tg}, 1)) AS word,
  generate_subscripts(regexp_extract_all(text, {tg}, 0), 1) - 1 AS pos FROM {p}b),
{p}tk0 AS (SELECT doc, pos, word AS text, lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {p}pc),
{p}tk AS (SELECT doc, CAST(pos AS INTEGER) AS pos, CAST({'s' if offsets else '0'} AS INTEGER) AS start_char,
  CAST({'s + length(text)' if offsets else '0'} AS INTEGER) AS end_char, text FROM {p}tk0),
{p}pp AS (SELECT doc, pos, start_char, end_char, length(regexp_extract(text, {pgap})) AS lead,
  unnest(regexp_extract_all(text, {pg}, 0)) AS piece, unnest(regexp_extract_all(text, {pg}, 1)) AS part,
  generate_subscripts(regexp_extract_all(text, {pg}, 0), 1) AS n FROM {p}tk),
{p}pa AS (SELECT doc, pos, start_char, end_char, part, n, lead + coalesce(sum(length(piece)) OVER (
  PARTITION BY doc, pos ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {p}pp),
{p}va AS (SELECT doc, pos, start_char, end_char, text, 'original' AS kind, -1 AS n FROM {p}tk
  UNION ALL SELECT doc, pos, start_char, end_char, regexp_replace(text, {q(tx.NON_WORD)}, '', 'g'), 'joined', 0 FROM {p}tk
  UNION ALL SELECT doc, pos, CAST({'start_char + s' if offsets else '0'} AS INTEGER),
    CAST({'start_char + s + length(part)' if offsets else '0'} AS INTEGER), part, 'part', n FROM {p}pa),
{p}dd AS (SELECT doc, pos, start_char, end_char, text, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY {same} ORDER BY pos, n) AS rn FROM {p}va) WHERE rn = 1),
{p}an AS (SELECT doc, pos, start_char, end_char, kind,
  translate(lower(text), {q(tx.FOLD_FROM)}, {q(tx.FOLD_TO)}) AS term FROM {p}dd)"""


def postings_ctes(source: str = DOC_PAGES_SQL, fields: tuple[str, ...] = ("content",), key: str = "url") -> str:
    """CTE po: (field, term, doc, tf, field_len), plus {field}_an token tables."""
    parts, unions = [], []
    for f in fields:
        parts.append(tokens_ctes(source, key, f, f"{f}_", offsets=f in ("content", "description")))
        unions.append(f"SELECT doc, '{f}' AS field, term, CAST(count(*) AS INTEGER) AS tf, CAST(sum(count(*)) OVER "
                      f"(PARTITION BY doc) AS INTEGER) AS field_len FROM {f}_an GROUP BY doc, term")
    return ",".join(parts) + ",\npo AS (" + " UNION ALL ".join(unions) + ")"


def query_terms_ctes(source: str = QUERIES_SQL) -> str:
    """CTE qt: distinct (query_id, term)."""
    return tokens_ctes(source, "query_id", "q", "q_") + ",\nqt AS (SELECT DISTINCT doc AS query_id, term FROM q_an)"


SCORES_CTES = """
st AS (SELECT field, count(*) AS n_docs, avg(field_len) AS avg_len
  FROM (SELECT DISTINCT field, doc, field_len FROM po) GROUP BY field),
dc AS (SELECT field, term, count(*) AS df FROM po GROUP BY field, term),
sc0 AS (SELECT query_id, doc, count(*) AS matched, (sum(
    (CASE po.field WHEN 'title' THEN 1.5 WHEN 'url' THEN 0.5 ELSE 1.0 END)
    * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * field_len / avg_len)))) AS score
  FROM qt JOIN po ON qt.term = po.term AND po.field = 'content' JOIN dc ON dc.term = po.term AND dc.field = po.field
  JOIN st ON st.field = po.field GROUP BY query_id, doc),
tot AS (SELECT query_id, count(*) AS total FROM qt GROUP BY query_id),
sc AS (SELECT query_id, doc, matched, round(score * (0.1::DOUBLE + 0.9::DOUBLE * matched / total), 6) AS score
  FROM sc0 JOIN tot USING (query_id))"""


# ---- URLs in SQL -------------------------------------------------------------------------------------------------------

def sql_part(u: str, group: int) -> str:
    return f"regexp_extract({u}, {q(urls.URL)}, {group})"


def sql_site(u: str) -> str:
    return f"regexp_extract({u}, {q(urls.SITE)})"


def sql_escape(u: str) -> str:
    runs = "regexp_extract_all(" + u + r", '[\x21-\x7E]+|[^\x21-\x7E]+')"
    return (f"list_aggregate(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[\\x21-\\x7E]') THEN r "
            f"ELSE replace(url_encode(r), '+', '%20') END), 'string_agg', '')")


def sql_canonical(u: str) -> str:
    e = sql_escape(u)
    query = sql_part(e, 4)
    pairs = (f"list_sort(list_transform(list_filter(string_split({query}, '&'), lambda a: a <> ''), lambda a: "
             "{'k': split_part(a, '=', 1), 'v': CASE WHEN contains(a, '=') THEN substring(a, instr(a, '=') + 1) ELSE '' END}))")
    joined = f"list_aggregate(list_transform({pairs}, lambda p: p.k || '=' || p.v), 'string_agg', '&')"
    placed = f"regexp_matches({e}, '^[^:/?#]+://')"
    return (f"(lower({sql_part(e, 1)}) || CASE WHEN {placed} THEN '://' WHEN {sql_part(e, 1)} = '' THEN '' ELSE ':' END "
            f"|| lower({sql_part(e, 2)}) || CASE WHEN {placed} AND {sql_part(e, 3)} = '' THEN '/' ELSE {sql_part(e, 3)} END || CASE {query} WHEN '' THEN '' ELSE '?' || coalesce({joined}, '') END)")


def sql_label(u: str) -> str:
    return f"lower(regexp_extract({sql_part(u, 2)}, '\\.([^.:@]+)(?::[0-9]*)?$', 1))"


def sql_list(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


# ---- pages as fetches --------------------------------------------------------------------------------------------------

def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a status, a time and a referrer, and a description tag on every second page."""
    p = table(spark, sf_dir, "pages")
    tag = F.concat(F.lit("<meta name=\"description\" content=\" about "), F.col("page_id").cast("string"),
                   F.lit(" &amp; more \"><title>"))
    return p.select(
        "page_id", "url",
        F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 17 == 0, 503).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<title>"), tag)).otherwise(F.col("html"))
        .alias("body"),
        (F.col("page_id") % 6).cast("int").alias("depth"),
        hours_after(F.col("page_id")).alias("fetched_at"))


def hours_after(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + n * 3600)


FETCHES_SQL = """(SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 17 = 0 THEN 503 ELSE 200 END
  AS status, CASE WHEN page_id % 2 = 0 THEN replace(html, '<title>', '<meta name="description" content=" about '
  || CAST(page_id AS VARCHAR) || ' &amp; more "><title>') ELSE html END AS body, CAST(page_id % 6 AS INTEGER) AS depth,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * page_id AS fetched_at FROM pages)"""


def sql_decode(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                         ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _sql_clean(body: str) -> str:
    for pattern in (html.COMMENT, html.SCRIPT, html.STYLE):
        body = f"regexp_replace({body}, {q(pattern)}, '', 'g')"
    return body


def _sql_first(pattern: str) -> str:
    return sql_decode(f"nullif(regexp_extract(clean, {q(pattern)}, 1), '')")


def extract_ctes(source: str = FETCHES_SQL) -> str:
    """CTE ex: page_id, url, status, depth, fetched_at, clean, title, content, description."""
    blanks = q(html.BLANKS)
    pieces = (f"list_filter(list_transform(string_split(regexp_replace(clean, {q(html.TAG)}, chr(1), 'g'), chr(1)), "
              f"lambda p: trim({sql_decode('p')}, {blanks})), lambda p: p <> '')")
    meta = (f"list_filter(regexp_extract_all(clean, {q(html.META)}), lambda t: regexp_matches(t, {q(html.META_NAME)}))[1]")
    return f"""c0 AS (SELECT *, {_sql_clean('body')} AS clean FROM {source} AS f),
c1 AS (SELECT *, coalesce({_sql_first(html.TITLE)}, {_sql_first(html.HEADING)}, url) AS title,
  list_aggregate({pieces}, 'string_agg', ' ') AS body_text,
  regexp_extract({meta}, {q(html.META_CONTENT)}, 1) AS meta FROM c0),
ex AS (SELECT * EXCLUDE (body_text, meta), ltrim(CASE WHEN starts_with(body_text, title)
    THEN substring(body_text, length(title) + 1) ELSE body_text END, {blanks}) AS content,
  coalesce(trim({sql_decode("trim(meta, '\"''')")}, {blanks}), '') AS description FROM c1)"""


LINKS_CTES = f"""lh AS (SELECT url AS referrer, unnest(regexp_extract_all(clean, {q(html.HREF)}, 1)) AS href,
  generate_subscripts(regexp_extract_all(clean, {q(html.HREF)}, 1), 1) - 1 AS n FROM ex),
lk AS (SELECT referrer, CAST(n AS INTEGER) AS n, {sql_site('referrer')} || {sql_decode("trim(href, '\"''')")} AS url
  FROM lh)"""
