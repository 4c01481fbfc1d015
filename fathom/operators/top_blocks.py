"""The best results of a query without scoring all its matches.

Documents are numbered so that those alike stand together, the ones with most of their main word first, and cut into blocks of
``BLOCK_DOCS``. A row of the block table holds the postings of one term in one block, and the highest weight among them. For
a query, the sum of its terms' highest weights in a block bounds every score in it. So the blocks with the highest bounds are
scored first; the score of the last result wanted is then a threshold, and only blocks that can reach it are scored as well.
All others are known by their bounds alone: a number for each term and block, instead of its postings.

The results are those of scoring everything, ties by document included: a block whose bound equals the threshold is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fathom.operators.index import BOOSTS, Index
from fathom.operators.ranking import COORD, KEYS, bm25_weight, idf_weight, tf_weight
from fathom.plans import packed
from fathom.plans.lineage import cut_lineage

#: Documents of a block, as a power of two.
BLOCK_BITS = 5
#: Blocks of each query that are scored for the threshold, for each result wanted.
FIRST_PER_RESULT = 1
#: Bounds and scores are summed in different orders, and scores are rounded to 6 places.
SLACK = 2e-6
#: Postings that a task gathers into blocks at once, on average.
GROUP_ROWS = 500_000
POSTING = "array<struct<doc:string,tf:int,field_len:int>>"


def numbered(postings: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """doc, block: documents by their most frequent term and its share of the text, cut into blocks."""
    best = postings.filter("main") if "main" in postings.columns else postings
    main = best.groupBy("doc").agg(F.max_by(F.struct(
        F.col("field"), F.col("term"), (F.col("tf") / F.col("field_len")).alias("share")), F.struct("tf", "field", "term")).alias("main"))
    ordered = main.select("doc", "main.field", "main.term", "main.share").repartitionByRange(
        "field", "term", F.desc("share"), "doc").sortWithinPartitions("field", "term", F.desc("share"), "doc")
    # The number is fixed by being written once.
    return cut_lineage(ordered.select("doc", F.shiftright(F.monotonically_increasing_id(), bits).alias("block")))


def build_blocks(postings: DataFrame, stats: DataFrame, bucket: Callable[[str], Column] | None = None, buckets: int = 1,
                 bits: int = BLOCK_BITS) -> DataFrame:
    """field, term, block, best (highest weight, without the term's own factor), n, postings: at most ``2 ** bits``.

    ``postings`` and ``stats`` are those of an index. Weights depend on the average length of a field, so blocks belong to the
    index that they were built with. With ``bucket``, a store's number for a term, there is a column ``term_bucket`` too, and
    rows are dealt by it and slices of blocks, so that they can be written without another shuffle; a frequent term is
    in many slices. Postings travel packed, to the numbers of their documents and to their slices.
    """
    spark, read = postings.sparkSession, postings.select("field", "term", F.col("doc").cast("string").alias("doc"), "tf", "field_len")
    own = read.withColumn("term_bucket", F.lit(0) if bucket is None else bucket("term"))
    blocks = numbered(postings, bits).select(F.col("doc").cast("string").alias("doc"), "block")
    rows, tasks = own.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-4 * tasks // buckets), -(-rows // (GROUP_ROWS * buckets)))
    schemas = to_arrow_schema(own.schema), to_arrow_schema(blocks.schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sliced() -> Iterator[pa.RecordBatch]:
            for table in packed.met(batches, *schemas, ["doc"]):
                block = table.column("block").to_numpy().astype(np.uint64)
                mixed = ((block + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield from table.append_column("slice", pa.array((mixed % np.uint64(slices)).astype(np.int32))).combine_chunks().to_batches()
        return packed.gathered(sliced(), ["term_bucket", "slice"])

    pieces = packed.together(own, blocks, ["doc"], packed.parts_for(spark, rows)).mapInArrow(placed, "term_bucket int, slice int, piece binary")
    kind = f"field string, term string, block long, term_bucket int, postings {POSTING}"
    found = pieces.groupBy("term_bucket", "slice").applyInArrow(_gathered(packed.inner(own.withColumn("block", F.lit(0).cast("long")).schema, ["term_bucket"])), kind)
    best = F.array_max(F.transform("postings", lambda p: tf_weight(p["tf"], p["field_len"])))
    return found.join(F.broadcast(stats), "field").select(
        "field", "term", "block", *([] if bucket is None else ["term_bucket"]), best.alias("best"), F.size("postings").alias("n"), "postings")


def _gathered(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From pieces of postings with one ``term_bucket`` to the rows of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = [], 0
        for batch in batches:
            found += [packed.rows_of(x.as_py(), schema) for x in batch.column("piece")]
            own = batch.column("term_bucket")[0].as_py()
        rows = pa.Table.from_batches(found).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("field", "term", "block", "doc", "tf", "field_len")]))
        same = np.ones(max(len(rows) - 1, 0), bool)
        for c in ("field", "term", "block"):
            column = rows.column(c).combine_chunks()
            same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.append(True, ~same))
        inside = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("doc", "tf", "field_len")], ["doc", "tf", "field_len"])
        first = rows.select(["field", "term", "block"]).take(pa.array(heads)).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(rows)).astype(np.int32)), inside)
        yield from packed.handed_on(pa.RecordBatch.from_arrays([
            *[first.column(c).combine_chunks() for c in ("field", "term", "block")], pa.array(np.full(len(heads), own, np.int32)), lists],
            names=["field", "term", "block", "term_bucket", "postings"]))

    return run


def weighed_terms(terms: DataFrame, dictionary: DataFrame, stats: DataFrame) -> DataFrame:
    """Terms (query_id, occur, field, term) with their own factor, and what the clauses of their query ask for."""
    must = (F.col("occur") == "must").cast("int")
    asked = terms.groupBy("query_id").agg(F.sum(must).alias("n_must"), F.sum((F.col("occur") != "must_not").cast("int")).alias("total"))
    own = dictionary.select("field", "term", "df").join(F.broadcast(stats.select("field", "n_docs", "avg_len")), "field")
    return terms.join(asked, "query_id").join(own, ["field", "term"]).withColumn("idf", idf_weight(BOOSTS))


def bounds(weighed: DataFrame, blocks: DataFrame, c: float = COORD) -> DataFrame:
    """query_id, block, bound: no document of the block can score more. Blocks that can't fit the clauses are left out."""
    good = F.col("occur") != "must_not"
    met = weighed.join(blocks.select("field", "term", "block", "best"), ["field", "term"]).groupBy("query_id", "block").agg(
        F.sum(F.when(good, F.col("idf") * F.col("best")).otherwise(0.0)).alias("most"), F.sum(good.cast("int")).alias("matched"),
        F.sum((F.col("occur") == "must").cast("int")).alias("must"), F.max("n_must").alias("n_must"), F.max("total").alias("total"))
    share = F.lit(round(1 - c, 9)) + c * F.col("matched") / F.col("total")
    return met.filter("must = n_must AND matched > 0").select("query_id", "block", (F.col("most") * share).alias("bound"))


def scored(weighed: DataFrame, blocks: DataFrame, chosen: DataFrame, c: float = COORD) -> DataFrame:
    """query_id, doc, score, matched of the documents in the ``chosen`` blocks (query_id, block) that fit the clauses."""
    good = F.col("occur") != "must_not"
    rows = weighed.join(chosen, "query_id").join(blocks.select("field", "term", "block", "postings"), ["field", "term", "block"])
    hits = rows.select("query_id", "occur", "field", "df", "n_docs", "avg_len", "n_must", "total", F.inline("postings")).withColumn(
        "weight", bm25_weight(BOOSTS))
    met = hits.groupBy(*KEYS).agg(
        F.sum(F.when(good, F.col("weight")).otherwise(0.0)).alias("score"), F.sum(good.cast("int")).alias("matched"),
        F.sum((F.col("occur") == "must").cast("int")).alias("must"), F.sum((F.col("occur") == "must_not").cast("int")).alias("no"),
        F.max("n_must").alias("n_must"), F.max("total").alias("total"))
    fit = met.filter("no = 0 AND must = n_must AND matched > 0")
    share = F.lit(round(1 - c, 9)) + c * F.col("matched") / F.col("total")
    return fit.select(*KEYS, F.round(F.col("score") * share, 6).alias("score"), F.col("matched").cast("long").alias("matched"))


def top_scores(terms: DataFrame, index: Index, k: int, c: float = COORD) -> tuple[DataFrame, DataFrame]:
    """Scores that hold at least the ``k`` best documents of each query, and the blocks that were scored (query_id, block)."""
    weighed = cut_lineage(weighed_terms(terms, index.dictionary, index.stats))
    limits = cut_lineage(bounds(weighed, index.blocks, c))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = cut_lineage(limits.withColumn("rn", F.row_number().over(best)).filter(
        F.col("rn") <= k * FIRST_PER_RESULT).select("query_id", "block"))
    known = cut_lineage(scored(weighed, index.blocks, first, c))
    ranked = known.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")))
    threshold = ranked.filter(F.col("rn") == k).select("query_id", F.col("score").alias("least"))
    rest = cut_lineage(limits.join(threshold, "query_id", "left").filter(
        F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "block").join(
        first, ["query_id", "block"], "left_anti"))
    scores = known.unionByName(scored(weighed, index.blocks, rest, c))
    return scores, first.unionByName(rest)


def postings_read(terms: DataFrame, index: Index, chosen: DataFrame) -> DataFrame:
    """query_id, scored, matching: postings in the scored blocks, and all of the query's terms."""
    met = terms.join(index.blocks.select("field", "term", "block", "n"), ["field", "term"]).join(
        chosen.withColumn("here", F.lit(True)), ["query_id", "block"], "left")
    return met.groupBy("query_id").agg(F.sum(F.when(F.col("here"), F.col("n")).otherwise(0)).alias("scored"), F.sum("n").alias("matching"))
