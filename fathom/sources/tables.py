"""Reading and writing page tables, fetches, submissions and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.schemas import FETCH, SUBMISSION
from fathom.sources import page_store


def scan_pages(spark: SparkSession, path: str, where: Column | None = None, limit: int | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """Page records of a stored page table, or of plain parquet; filter, limit and columns reach the parquet scan."""
    stored = page_store.page_buckets(spark, path) is not None
    pages = page_store.read_pages(spark, path) if stored else spark.read.parquet(path)
    if where is not None:
        pages = pages.filter(where)
    if columns is not None:
        pages = pages.select(*columns)
    return pages if limit is None else pages.limit(limit)


def _shaped(df: DataFrame, schema: T.StructType, columns: dict[str, str] | None) -> DataFrame:
    """Map expressions over the input's columns to ``schema``; fields without an expression are NULL."""
    if columns is None:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return df.select(*[
        (F.expr(columns[f.name]) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_fetches(spark: SparkSession, path: str, fmt: str = "parquet",
                 columns: dict[str, str] | None = None) -> DataFrame:
    return _shaped(spark.read.format(fmt).load(path), FETCH, columns)


def stream_fetches(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    return _stream(spark, path, fmt, FETCH, max_files)


def read_submissions(spark: SparkSession, path: str, fmt: str = "parquet",
                     columns: dict[str, str] | None = None) -> DataFrame:
    return _shaped(spark.read.format(fmt).load(path), SUBMISSION, columns)


def stream_submissions(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    return _stream(spark, path, fmt, SUBMISSION, max_files)


def _stream(spark: SparkSession, path: str, fmt: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
