"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import (bpe, centroids, codebooks, decontam, hamming, licenses, linededup, lmscore, neardup, packing, quality,
                        secrets, sharding)
from fathom.llm.shared import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), with_ids=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"),
        F.col("__kept").alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every row whose id is divisible by 20, among all rows."""
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming.nearest(codes, codes.filter(F.col("id") % 20 == 0))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__removed").alias("n_removed"), F.md5("__text").alias("text_md5"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_near_duplicates, op4_top_k, op5_decontamination, op6_licenses,
                                op7_secrets, op8_lm_score, op9_packing, op10_line_dedup, op11_centroids, op12_codebooks,
                                op13_sharding)}

def _centroids_sql(rounds: int = centroids.ROUNDS, k: int = centroids.K, dims: int = centroids.DIMS) -> str:
    """The rounds of k-means one after the other."""
    ctes = [f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, embedding
        FROM embeddings WHERE len(embedding) = {dims}
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS c, v AS m
        FROM (SELECT *, sha256('3:' || vec_id) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h, embedding LIMIT {k}))"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
        SELECT r, min((d, c)) AS best FROM (
            SELECT r, c, CAST(list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, {dims + 1})]) AS BIGINT) AS d FROM kept, c{i})
        GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
        SELECT c, CASE WHEN c IN (SELECT best[2] FROM a{i}) THEN new ELSE m END AS m FROM c{i} LEFT JOIN (
            SELECT of, list(CAST(floor_mean AS BIGINT) ORDER BY d) AS new FROM (
                SELECT best[2] AS of, d, (sum(v[d]) - ((sum(v[d]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                FROM a{i} JOIN kept USING (r), range(1, {dims + 1}) AS t(d) GROUP BY 1, 2) GROUP BY of) ON c = of)""")
    return f"""WITH {", ".join(ctes)}
        SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
               CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c = best[2]"""


def _codebooks_sql(rounds: int = codebooks.ROUNDS, entries: int = codebooks.ENTRIES, parts: int = codebooks.PARTS,
                   dims: int = codebooks.DIMS) -> str:
    """The rounds of all codebooks one after the other. Products of whole numbers are exact in DOUBLE."""
    width = dims // parts
    ctes = [f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, label, embedding, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
        FROM embeddings WHERE len(embedding) = {dims}
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""x AS MATERIALIZED (
        SELECT r, p, v[p * {width} + 1:(p + 1) * {width}] AS u FROM kept, range({parts}) AS t(p))""",
            f"""b0 AS MATERIALIZED (
        SELECT e, p, v[p * {width} + 1:(p + 1) * {width}] AS m FROM (
            SELECT v, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS e FROM kept WHERE vec_id IS NOT NULL
            ORDER BY vec_id, embedding LIMIT {entries}), range({parts}) AS t(p))"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
        SELECT r, p, min((list_inner_product(u, u) - 2 * list_inner_product(u, m) + list_inner_product(m, m), e)) AS best
        FROM x JOIN b{i} USING (p) GROUP BY r, p)""")
        if i < rounds:
            ctes.append(f"""b{i + 1} AS MATERIALIZED (
        SELECT b{i}.e, b{i}.p, coalesce(new, m) AS m FROM b{i} LEFT JOIN (
            SELECT p, of, list(floor_mean ORDER BY d) AS new FROM (
                SELECT p, best[2] AS of, d, CAST((sum(CAST(u[d] AS BIGINT)) - ((sum(CAST(u[d] AS BIGINT)) % count(*)) + count(*)) % count(*)) // count(*) AS DOUBLE) AS floor_mean
                FROM a{i} JOIN x USING (r, p), range(1, {width + 1}) AS t(d) GROUP BY 1, 2, 3) GROUP BY p, of) n ON n.p = b{i}.p AND n.of = b{i}.e)""")
    return f"""WITH {", ".join(ctes)},
        coded AS (SELECT r, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
                  FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) FOR y IN m], ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (r)"""


ORACLE = {
    "op11_centroids": _centroids_sql(),
    "op12_codebooks": _codebooks_sql(),
    "op4_top_k": """
        WITH codes AS (SELECT DISTINCT vec_id, [x > 0 FOR x IN embedding] AS bits FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
        pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
                         CAST(len(list_filter(range(1, 65), lambda i: coalesce(q.bits[i], false) <> coalesce(v.bits[i], false))) AS INTEGER) AS distance
                  FROM codes q JOIN codes v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10""",
    "op10_line_dedup": """
        WITH texts AS (SELECT doc_id, text, md5(text) AS of, string_split(text, chr(10)) AS lines FROM documents),
        starts AS (SELECT doc_id, of, [trim(x) FOR x IN lines] AS lines, unnest(range(greatest(len(lines) - 2, 1))) AS line
                   FROM texts WHERE length(text) > 0),
        windows AS (SELECT doc_id, of, line, lines[line + 1:line + 3] AS key FROM starts),
        ranked AS (SELECT *, min((doc_id, of, line)) OVER (PARTITION BY key) AS first FROM windows
                   WHERE array_to_string(key, '') <> ''),
        gone AS (SELECT doc_id, of, list_distinct(flatten(list([line, line + 1, line + 2]))) AS covered
                 FROM ranked WHERE (doc_id, of, line) <> first GROUP BY doc_id, of),
        done AS (SELECT t.doc_id, t.text, lines, covered,
                        list_filter(range(len(lines)), lambda i: NOT list_contains(covered, i)) AS kept
                 FROM texts t LEFT JOIN gone g ON t.doc_id IS NOT DISTINCT FROM g.doc_id AND t.of = g.of)
        SELECT doc_id, CASE WHEN covered IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_removed,
               CASE WHEN covered IS NULL THEN md5(text)
                    ELSE md5(coalesce(array_to_string([lines[i + 1] FOR i IN kept], chr(10)), '')) END AS text_md5
        FROM done""",
}
