"""Declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("depth", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("last_updated", T.TimestampType()),
    T.StructField("dead_since", T.TimestampType()),
])

FETCH = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("in_bytes", T.LongType()),
    T.StructField("out_bytes", T.LongType()),
])

SUBMISSION = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("ip", T.LongType(), False),
    T.StructField("timestamp", T.LongType()),
])

CRAWL_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("netloc", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("in_bytes", T.LongType()),
    T.StructField("out_bytes", T.LongType()),
])

SHADOW_PREFIX = "phrase_"


class SchemaMismatch(ValueError):
    """A table lacks fields of its schema, or has fields beyond it."""


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df`` if it has exactly the fields of ``schema``; shadow fields may come on top."""
    wanted = set(schema.fieldNames())
    found = {c for c in df.columns if not c.startswith(SHADOW_PREFIX)}
    missing, extra = sorted(wanted - found), sorted(found - wanted)
    if missing or extra:
        raise SchemaMismatch(f"missing fields: {missing}; extra fields: {extra}")
    return df
