"""Wildcard search over an index of the dictionary's letters.

Each term is listed under its grams: stretches of one, two and three characters, the longer ones with a mark for the term's
begin and end, and one for its length. A pattern's literal pieces hold grams that any term that fits must have; the rarest of
them are looked up and intersected, and only what is left is compared with the pattern. So ``*less`` reads the terms listed
under ``less``'s rarest letters instead of all terms. Only a pattern of nothing but wildcards, one of them ``*``, has no
gram; it takes every term anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import wildcard_regex
from fathom.plans.lineage import cut_lineage

#: Marks of a term's begin and end, and before its length.
BEGIN, END, LENGTH = "\x02", "\x03", "\x04"
#: Grams of a pattern that are looked up.
PROBES = 3
NO_TERMS = "array<string>"


def _stretches(chars: Column, n: int) -> Column:
    """All stretches of ``n`` characters of an array of characters. Linear, unlike substrings of a text."""
    starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))


def term_grams(dictionary: DataFrame) -> DataFrame:
    """field, gram, term: each gram of each term once."""
    padded = dictionary.select("field", "term", F.split(F.concat(F.lit(BEGIN), "term", F.lit(END)), "").alias("chars"))
    inner = F.slice("chars", 2, F.size("chars") - 2)
    grams = F.array_distinct(F.concat(
        inner, _stretches(F.col("chars"), 2), _stretches(F.col("chars"), 3),
        F.array(F.concat(F.lit(LENGTH), F.length("term").cast("string")))))
    return padded.select("field", F.explode(grams).alias("gram"), "term")


def gram_counts(grams: DataFrame) -> DataFrame:
    """How many terms each gram has: what the rarest gram of a pattern is chosen by."""
    return grams.groupBy("field", "gram").agg(F.count("*").alias("n"))


def pattern_grams(pattern: Column) -> Column:
    """Grams that every term of the pattern has."""
    padded = F.concat(F.lit(BEGIN), pattern, F.lit(END))

    def of_piece(piece: Column) -> Column:
        chars = F.split(piece, "")
        single = F.when(piece.isin(BEGIN, END), F.array().cast(NO_TERMS)).otherwise(F.array(piece))
        return F.when(F.length(piece) >= 3, _stretches(chars, 3)).when(F.length(piece) == 2, F.array(piece)).otherwise(single)

    pieces = F.filter(F.split(padded, "[*?]+"), lambda p: p != "")
    length = F.when(F.contains(pattern, F.lit("*")), F.array().cast(NO_TERMS)).otherwise(
        F.array(F.concat(F.lit(LENGTH), F.length(pattern).cast("string"))))
    return F.array_distinct(F.concat(F.flatten(F.transform(pieces, of_piece)), length))


@dataclass(frozen=True)
class TermGrams:
    """The grams of a dictionary and how often each occurs. A stored one has ``of_grams``: given grams (field, gram), their
    rows, read from the partitions in which they lie."""

    grams: DataFrame
    counts: DataFrame
    of_grams: Callable[[DataFrame], DataFrame] | None = None

    def rows_of(self, probes: DataFrame) -> DataFrame:
        asked = probes.select("field", "gram").distinct()
        return self.of_grams(asked) if self.of_grams else self.grams.join(asked, ["field", "gram"], "left_semi")


def candidates(patterns: DataFrame, index: TermGrams, probes: int = PROBES) -> DataFrame:
    """Patterns (query_id, field, pattern) with the terms that have all of their ``probes`` rarest grams."""
    asked = patterns.select("field", "pattern").distinct().withColumn("gram", F.explode(pattern_grams(F.col("pattern"))))
    counted = asked.join(index.counts, ["field", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A gram that no term has: the pattern has no terms.
    ranked = counted.withColumn("rn", F.row_number().over(Window.partitionBy("field", "pattern").orderBy("n", "gram")))
    chosen = ranked.withColumn("least", F.min("n").over(Window.partitionBy("field", "pattern"))).filter(
        (F.col("rn") <= probes) & (F.col("least") > 0))
    chosen = cut_lineage(chosen.select("field", "pattern", "gram", F.count("*").over(
        Window.partitionBy("field", "pattern")).alias("wanted")))
    met = chosen.join(index.rows_of(chosen), ["field", "gram"]).groupBy("field", "pattern", "term").agg(
        F.count("*").alias("has"), F.max("wanted").alias("wanted"))
    return patterns.select("query_id", "field", "pattern").join(met.filter("has = wanted").drop("has", "wanted"), ["field", "pattern"])


def wildcard_terms(patterns: DataFrame, index: TermGrams, dictionary: DataFrame) -> DataFrame:
    """Terms of patterns (query_id, field, pattern): (query_id, occur, field, term).

    ``dictionary`` is read only for patterns without any gram.
    """
    fits = F.rlike("term", wildcard_regex(F.col("pattern")))
    found = candidates(patterns, index).filter(fits)
    free = patterns.filter(F.size(pattern_grams(F.col("pattern"))) == 0)
    if free.limit(1).count():
        found = found.select("query_id", "field", "pattern", "term").unionByName(
            free.select("query_id", "field", "pattern").join(dictionary.select("field", "term"), "field").filter(fits))
    return found.select("query_id", F.lit("should").alias("occur"), "field", "term").distinct()
