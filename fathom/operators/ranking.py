"""What a match counts: BM25 per field, boosted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, COORD = 1.2, 0.75, 0.9
KEYS = ["query_id", "doc"]
# Most rows of a table of hits or terms that is broadcast; larger ones are shuffled.
SMALL_ROWS = 100_000


def idf_weight(boosts: dict[str, float]) -> Column:
    """What the term itself counts: how rare it is, times its field's boost."""
    n, df = F.col("n_docs"), F.col("df")
    boost = F.lit(1.0)
    for field, value in boosts.items():
        if value != 1.0:
            boost = F.when(F.col("field") == field, F.lit(value)).otherwise(boost)
    return boost * F.ln(1 + (n - df + 0.5) / (df + 0.5))


def tf_weight(tf: str | Column = "tf", field_len: str | Column = "field_len") -> Column:
    """What its number in a document counts, for the length of the document's field."""
    tf, field_len = (F.col(c) if isinstance(c, str) else c for c in (tf, field_len))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * field_len / F.col("avg_len")))


def bm25_weight(boosts: dict[str, float]) -> Column:
    return idf_weight(boosts) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("field_len") / F.col("avg_len")))
