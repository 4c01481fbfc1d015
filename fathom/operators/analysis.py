"""Token tables: one row per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.plans.layout import spread


def _rows(df: DataFrame, keep: list[str], toks: Column) -> DataFrame:
    return df.select(*keep, F.inline(toks))


def tokenize(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    return _rows(spread(df), keep, tx.tokens(F.col(col)))


def with_variants(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Every token with all its variants, repeats included."""
    return _rows(spread(df), keep, F.flatten(F.transform(tx.tokens(F.col(col)), lambda t: tx.each_variant(t))))


def dedupe_tokens(df: DataFrame, col: str, keep: list[str], offsets: bool = True) -> DataFrame:
    if offsets:
        return _rows(spread(df), keep, F.flatten(F.transform(tx.tokens(F.col(col)), lambda t: tx.each_new_variant(t))))
    return _rows(spread(df), keep, tx.distinct_variants(tx.tokens_without_offsets(F.col(col))))


def analyze(df: DataFrame, col: str, keep: list[str], offsets: bool = True) -> DataFrame:
    """Analysed tokens; a text without words gives no rows."""
    return _rows(tx.analyzed(spread(df), col, "__toks", offsets), keep, F.col("__toks"))
