"""Page table and index as plain partitioned Parquet.

A table lies in one folder per full build, partitioned by a hash bucket of the URL or term, and a file ``current`` names the
folder that holds and its number of buckets. A full build writes a new folder, then the file, then removes the old folder. An
upsert, delete or update joins the touched buckets with the change and overwrites just these partitions (Spark's dynamic
partition overwrite). All of them give the same table when they are run a second time, so a batch that a job repeats after a
failure needs no mark. Writers of one table must not run side by side.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.operators.index import Index, merge_postings, term_stats
from fathom.operators.pages import delete_pages, upsert_pages
from fathom.operators.phrases import Pairs, pair_counts
from fathom.operators.term_grams import TermGrams, gram_counts, term_grams
from fathom.operators.top_blocks import build_blocks
from fathom.plans.packed import packed, unpacked
from fathom.schemas import PAGE, check_schema

BUCKETS = 256
#: Bytes that a bucket should hold; ``buckets_for`` derives their number from the size of what is to be stored.
BUCKET_BYTES = 1 << 30
#: Packed postings take about so much less than rows in a shuffle.
PACKED = 8


def bucket(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def buckets_for(n_bytes: int) -> int:
    return max(8, 1 << math.ceil(math.log2(max(n_bytes / BUCKET_BYTES, 1))))


# ---- folders ------------------------------------------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _current(spark: SparkSession, path: str) -> dict | None:
    """{"folder", "buckets"} of the table, or nothing if there is none."""
    fs, at = _files(spark, f"{path}/current")
    if not fs.exists(at):
        return None
    state = json.loads(spark.read.option("wholetext", True).text(f"{path}/current").first()[0])
    return state | {"folder": f"{path}/{state['build']}"}


def _new_build(spark: SparkSession, path: str, buckets: int, fill) -> None:
    """``fill`` writes into a new folder, which then becomes the table."""
    old, build = _current(spark, path), f"build={uuid.uuid4().hex}"
    fill(f"{path}/{build}")
    fs, at = _files(spark, f"{path}/current")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"build": build, "buckets": buckets}).encode()))
    out.close()
    if old is not None:
        fs.delete(_files(spark, old["folder"])[1], True)


@contextmanager
def _shuffling(spark: SparkSession, packed: bool) -> Iterator[None]:
    """The shuffle files of a write go when it ends, not when the driver happens to collect its garbage. ``packed`` rows are
    dealt out in partitions of an eighth of the usual size, as they are about an eighth of the rows."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if packed:
        usual = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
        own[size] = f"{max(usual // PACKED, 1 << 20)}b"
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(df: DataFrame, folder: str, by: str, sort: list[str], dynamic: bool = False, dealt: bool = False, pack: bool = False) -> None:
    """``rebalance`` gives files of even size: small partitions are joined and large ones split at run time. Rows that are
    ``dealt`` out already are written where they lie. Offsets travel as two arrays of numbers, at a third of the size of
    an array of pairs; postings travel ``pack``ed."""
    apart = "offsets" in df.columns
    if apart:
        df = df.withColumns({"start": F.col("offsets.start"), "end": F.col("offsets.end")}).drop("offsets")
    if pack:
        df = unpacked(packed(df, [by]).hint("rebalance", by), [by], df.schema)
    elif not dealt:
        df = df.hint("rebalance", by)
    df = df.sortWithinPartitions(by, *sort)
    if apart:
        df = df.withColumn("offsets", F.arrays_zip("start", "end")).drop("start", "end")
    with _shuffling(df.sparkSession, pack or dealt):
        df.write.partitionBy(by).mode("overwrite").option("compression", "zstd").option(
            "partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(folder)


def _overwrite(df: DataFrame, folder: str, by: str, sort: list[str], touched: list[int]) -> None:
    """Puts ``df`` in the place of the touched buckets. One that has no rows any more is removed."""
    spark = df.sparkSession
    filled = {r[0] for r in df.select(by).distinct().collect()}  # as many numbers as there are touched buckets
    _write(df, folder, by, sort, dynamic=True)
    for b in set(touched) - filled:
        fs, at = _files(spark, f"{folder}/{by}={b}")
        fs.delete(at, True)


def _read(spark: SparkSession, folder: str, by: str, only: list[int] | None = None) -> DataFrame | None:
    """The table, or nothing if none of the buckets asked for exists."""
    names = [n for n in _children(spark, folder) if n.startswith(f"{by}=") and (only is None or int(n.removeprefix(f"{by}=")) in set(only))]
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/{n}" for n in names]) if names else None


def _touched(keys: DataFrame, of: Column) -> list[int]:
    """Numbers of buckets, at most as many as there are."""
    return sorted(r[0] for r in keys.select(of).distinct().collect())


# ---- pages --------------------------------------------------------------------------------------------------------------

def _page_rows(df: DataFrame, buckets: int) -> DataFrame:
    return df.select(*PAGE.fieldNames(), bucket(buckets, "url").alias("url_bucket"))


def write_pages(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the whole table anew; nothing of an earlier one stays, whatever its number of buckets."""
    check_schema(df, PAGE)
    _new_build(df.sparkSession, path.rstrip("/"), buckets,
               lambda folder: _write(_page_rows(df, buckets), f"{folder}/pages", "url_bucket", ["url"]))


def page_buckets(spark: SparkSession, path: str) -> int | None:
    state = _current(spark, path.rstrip("/"))
    return state and state["buckets"]


def read_pages(spark: SparkSession, path: str, only: list[int] | None = None, with_bucket: bool = False) -> DataFrame:
    """The pages; ``only`` names the buckets to be read."""
    state = _current(spark, path.rstrip("/"))
    columns = [*PAGE.fieldNames(), *(["url_bucket"] if with_bucket else [])]
    found = state and _read(spark, f"{state['folder']}/pages", "url_bucket", only)
    if found is None:
        return spark.createDataFrame([], PAGE).withColumn("url_bucket", F.lit(0)).select(*columns)
    return found.select(*columns)


def read_pages_of(spark: SparkSession, path: str, keys: DataFrame, most: int = 1000) -> DataFrame:
    """The pages with these URLs (``url``): only their buckets are read, and of those, if they are few, only the files'
    parts that may hold them."""
    buckets = page_buckets(spark, path)
    pages = read_pages(spark, path, _touched(keys, bucket(buckets, "url")) if buckets else [], with_bucket=True)
    few = [r[0] for r in keys.select("url").distinct().limit(most + 1).collect()]
    if len(few) <= most:
        return pages.filter(F.col("url").isin(few))
    return pages.join(keys.select("url").distinct(), "url", "left_semi")


def upsert_into(batch: DataFrame, path: str, buckets: int = BUCKETS, **options) -> None:
    """Upsert a batch (one record per URL) into the table at ``path``; only the buckets of its URLs are read and written.
    ``buckets`` holds for a new table."""
    spark, path = batch.sparkSession, path.rstrip("/")
    state = _current(spark, path)
    if state is None:
        return write_pages(upsert_pages(read_pages(spark, path), batch, **options), path, buckets)
    touched = _touched(batch, bucket(state["buckets"], "url"))
    merged = upsert_pages(read_pages(spark, path, touched), batch, **options)
    # No upsert empties a bucket.
    _write(_page_rows(merged, state["buckets"]), f"{state['folder']}/pages", "url_bucket", ["url"], dynamic=True)


def delete_from(keys: DataFrame, path: str) -> None:
    """Delete pages by URL; only the buckets of those URLs are read and rewritten."""
    spark, path = keys.sparkSession, path.rstrip("/")
    state = _current(spark, path)
    if state is None:
        return
    touched = _touched(keys, bucket(state["buckets"], "url"))
    kept = _page_rows(delete_pages(read_pages(spark, path, touched), keys), state["buckets"])
    _overwrite(kept, f"{state['folder']}/pages", "url_bucket", ["url"], touched)


# ---- rows by key ---------------------------------------------------------------------------------------------------------

def upsert_rows(batch: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Puts the rows of ``batch``, one for each key, in the place of those with the same key. Only the buckets of the batch's
    keys are read and written; a null is a key like any other."""
    spark, path = batch.sparkSession, path.rstrip("/")
    state = _current(spark, path)
    rows = batch.withColumn("bucket", bucket(state["buckets"] if state else buckets, *keys))
    if state is None:
        return _new_build(spark, path, buckets, lambda folder: _write(rows, f"{folder}/rows", "bucket", keys))
    touched = _touched(rows, F.col("bucket"))
    old = _read(spark, f"{state['folder']}/rows", "bucket", touched)
    if old is not None:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
        rows = rows.unionByName(old.alias("old").join(rows.select(*keys).alias("new"), same, "left_anti"))
    _write(rows, f"{state['folder']}/rows", "bucket", keys, dynamic=True)


def read_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    state = _current(spark, path.rstrip("/"))
    found = state and _read(spark, f"{state['folder']}/rows", "bucket")
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.fieldNames())


# ---- index --------------------------------------------------------------------------------------------------------------

#: Parts of a full build that an update can't bring up to date; search does without them.
EXTRAS = ("blocks", "grams", "gram_counts", "pairs", "pair_counts")


def _put_dictionary(spark: SparkSession, folder: str, only: list[int] | None) -> None:
    """The term dictionary from the stored postings, of all or of the touched buckets."""
    postings = _read(spark, f"{folder}/postings", "term_bucket", only)
    if postings is not None:
        terms = postings.groupBy("field", "term", "term_bucket").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
        _write(terms, f"{folder}/dictionary", "term_bucket", ["field", "term"], dynamic=only is not None)
    for b in only or []:
        if postings is None or f"term_bucket={b}" not in _children(spark, f"{folder}/postings"):
            fs, at = _files(spark, f"{folder}/dictionary/term_bucket={b}")
            fs.delete(at, True)


def _lengths(postings: DataFrame, buckets: int) -> DataFrame:
    """Of postings with the mark ``main`` only the marked rows are read: one for each field and document."""
    if "main" in postings.columns:
        postings = postings.filter("main").select("field", "doc", F.col("field_len").alias("tf"))
    return postings.groupBy("field", "doc").agg(F.sum("tf").alias("field_len")).withColumn("doc_bucket", bucket(buckets, "doc"))


def _put_fields(spark: SparkSession, folder: str) -> None:
    """One row for each field: number of documents and their average length."""
    lengths = _read(spark, f"{folder}/lengths", "doc_bucket")
    rows = (lengths or spark.createDataFrame([], "field string, field_len bigint")).groupBy("field").agg(
        F.count("*").alias("n_docs"), F.avg("field_len").alias("avg_len"))
    with _shuffling(spark, False):
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/fields")


def write_index(postings: DataFrame, path: str, buckets: int = BUCKETS, extras: bool | tuple[str, ...] = False, pairs: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
    """A full build: postings by term hash, sorted by term, so that a query reads few partitions and few row groups.

    The bucket of a very frequent term is split into several files by the rebalance. Nothing of an earlier build stays. With
    ``extras``, also the blocks for the best results and the dictionary's grams for wildcards, or those of them that are named
    (``blocks``, ``grams``); ``pairs`` are the postings of frequent neighbours for phrases (``phrases.pair_postings``), or a function that makes
    them from the stored dictionary and field statistics.
    Postings with the mark ``main`` need not be grouped for lengths and the blocks' order.
    """
    spark, more = postings.sparkSession, ("blocks", "grams") if extras is True else extras or ()

    def fill(folder: str) -> None:
        _write(postings.withColumn("term_bucket", bucket(buckets, "term")), f"{folder}/postings", "term_bucket", ["field", "term"], pack=True)
        _put_dictionary(spark, folder, None)
        stored = _read(spark, f"{folder}/postings", "term_bucket")
        stored = postings.limit(0) if stored is None else stored
        _write(_lengths(stored, buckets), f"{folder}/lengths", "doc_bucket", ["field", "doc"])
        _put_fields(spark, folder)
        if "blocks" in more:
            blocks = build_blocks(stored, spark.read.parquet(f"{folder}/fields"), lambda term: bucket(buckets, term), buckets)
            _write(blocks, f"{folder}/blocks", "term_bucket", ["field", "term", "block"], dealt=True)
        if "grams" in more:
            terms = _read(spark, f"{folder}/dictionary", "term_bucket")
            terms = term_stats(stored) if terms is None else terms
            grams = term_grams(terms.select("field", "term")).withColumn("gram_bucket", bucket(buckets, "gram"))
            _write(grams, f"{folder}/grams", "gram_bucket", ["gram", "field", "term"])
            found = _read(spark, f"{folder}/grams", "gram_bucket")
            gram_counts(grams if found is None else found).write.parquet(f"{folder}/gram_counts")
        if pairs is not None:
            terms = _read(spark, f"{folder}/dictionary", "term_bucket")
            beside = pairs(term_stats(stored) if terms is None else terms, spark.read.parquet(f"{folder}/fields")) if callable(pairs) else pairs
            _write(beside.withColumn("pair_bucket", bucket(buckets, "first", "second")), f"{folder}/pairs", "pair_bucket", ["first", "second", "field"])
            found = _read(spark, f"{folder}/pairs", "pair_bucket")
            pair_counts(beside if found is None else found).write.parquet(f"{folder}/pair_counts")

    _new_build(spark, path.rstrip("/"), buckets, fill)


def _grams(spark: SparkSession, folder: str, buckets: int, most: int = 1000) -> TermGrams | None:
    if "gram_counts" not in _children(spark, folder):
        return None
    whole = _read(spark, f"{folder}/grams", "gram_bucket")
    counts = spark.read.parquet(f"{folder}/gram_counts")
    none = counts.limit(0).select("field", "gram", F.col("gram").alias("term"))

    def rows_of(asked: DataFrame) -> DataFrame:
        found = _read(spark, f"{folder}/grams", "gram_bucket", _touched(asked, bucket(buckets, "gram")))
        if found is None:
            return none
        few = [r[0] for r in asked.select("gram").distinct().limit(most + 1).collect()]
        return found.filter(F.col("gram").isin(few)) if len(few) <= most else found.join(asked, ["field", "gram"], "left_semi")

    return TermGrams(none if whole is None else whole, counts, rows_of)


def read_index(spark: SparkSession, path: str, terms: DataFrame | None = None) -> Index:
    """The index; with ``terms`` (field, term) only the buckets in which they lie (at most as many numbers are collected)."""
    path = path.rstrip("/")
    state = _current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no index at {path}")
    folder, buckets = state["folder"], state["buckets"]
    only = None if terms is None else _touched(terms, bucket(buckets, "term"))
    parts = {name: _read(spark, f"{folder}/{name}", "term_bucket", only) for name in ("postings", "dictionary", "blocks")}
    if only is not None and parts["postings"] is None:  # none of the terms is known: any bucket does, its rows do not join
        return read_index(spark, path).limited_to_none()
    if parts["postings"] is None:
        empty = "field string, term string, doc string, tf int, field_len int, positions array<int>, offsets array<struct<start:int,end:int>>"
        parts |= {"postings": spark.createDataFrame([], empty), "dictionary": spark.createDataFrame([], "field string, term string, df bigint, total_tf bigint")}
    parts["postings"] = parts["postings"].drop("main")
    beside = _read(spark, f"{folder}/pairs", "pair_bucket")
    pairs = None if beside is None else Pairs(beside, spark.read.parquet(f"{folder}/pair_counts"))
    return Index(parts["postings"], parts["dictionary"], spark.read.parquet(f"{folder}/fields"), lambda asked: read_index(spark, path, asked),
                 parts["blocks"], _grams(spark, folder, buckets), pairs)


def update_index(new: DataFrame, touched: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the postings of the documents in ``touched`` (doc) by ``new`` (which may be empty: a delete).

    Read first are the documents' and buckets' columns of the postings; rewritten are the buckets of the documents' old and new
    terms. A batch of many documents touches most buckets, so an index is best brought up to date by few large batches.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    state = _current(spark, path)
    if state is None:
        return write_index(new, path, buckets)
    folder, buckets = state["folder"], state["buckets"]
    new = new.drop("main").withColumn("term_bucket", bucket(buckets, "term"))
    docs = touched.select("doc").distinct()
    whole = _read(spark, f"{folder}/postings", "term_bucket")
    changed = new.select("term_bucket")
    if whole is not None:
        changed = changed.unionByName(whole.join(docs, "doc", "left_semi").select("term_bucket"))
    only = _touched(changed, F.col("term_bucket"))
    old = _read(spark, f"{folder}/postings", "term_bucket", only)
    merged = new if old is None else merge_postings(old.drop("main"), docs, new)
    for name in EXTRAS:
        fs, at = _files(spark, f"{folder}/{name}")
        fs.delete(at, True)
    _overwrite(merged, f"{folder}/postings", "term_bucket", ["field", "term"], only)
    _put_dictionary(spark, folder, only)
    own = bucket(buckets, "doc")
    here = _touched(docs, own)
    lengths = _read(spark, f"{folder}/lengths", "doc_bucket", here)
    fresh = _lengths(new, buckets)
    _overwrite(fresh if lengths is None else lengths.join(docs, "doc", "left_anti").unionByName(fresh),
               f"{folder}/lengths", "doc_bucket", ["field", "doc"], here)
    _put_fields(spark, folder)


def delete_from_index(keys: DataFrame, path: str) -> None:
    """Deleted pages (url) are no longer found."""
    postings = read_index(keys.sparkSession, path).postings.drop("term_bucket")
    update_index(postings.limit(0), keys.select(F.col("url").alias("doc")), path)
