"""Corpus pipeline: quality classifier, line dedup, near dedup, benchmark decontamination, encoding.

Each stage gets what the one before it kept, written as Parquet and read again. All but the last return the columns of
``documents``. Rows with a null in any column, repeated rows and empty tables pass through as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, decontam, linededup, neardup, quality
from fathom.llm.shared import stored, table, unused


def _own(docs: DataFrame) -> list:
    """The columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    names = tuple(unused(name, docs) for name in ("perplexity", "threshold", "kept"))
    return quality.judged(docs, table(spark, sf_dir, "labels"), names=names).filter(F.col(names[2])).select(*_own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose windows of lines that occurred before; a text that loses all its lines goes. ``n_chars`` follows the text."""
    left, removed = unused("left", docs), unused("removed", docs)
    changed = F.col(removed) > 0
    done = linededup.without_repeated_lines(docs, left, removed).filter(~changed | (F.col(left) != ""))
    return done.withColumns({
        "text": F.col(left),
        "n_chars": F.when(changed, F.length(left).cast("long")).otherwise(F.col("n_chars")),
    }).select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded text."""
    return bpe.encode_decode(docs)


STAGES = [("quality classifier", good_text), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("encoding", encoding)]

#: The classifier's model and the encoder can't be stated in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
