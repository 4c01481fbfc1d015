"""Line dedup: windows of three consecutive lines that occurred earlier are removed. Built-in functions only.

Lines are split at "\\n" and compared after trimming blanks. A text's windows start at each of its lines but the last two; a
text of one or two lines is one window. A window whose lines are all blank is not looked at. Of equal windows
the first by (doc_id, text digest, line) stays; the lines of all later ones go, each line once however many windows cover it.

Windows are made inside the row, hashed to 128 bits and shuffled as digests, never as text. Finding the first of each
window is a partial aggregate, so a window in every document sends one row per task; the join that follows has unique
keys on one side. A text is rebuilt from the array of its remaining lines, in time linear in its lines.

Cases: a null or empty text has no windows and stays as it is; rows that repeat a doc_id with the same text count as
one occurrence and are treated alike; a null doc_id sorts first; a text whose lines all go becomes the empty string; further
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import stored, unused

WIDTH = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, line at which the window starts, digest of the window."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.trim(line))
    rows = docs.filter(F.length("text") > 0).select("doc_id", F.md5("text").alias("of"), lines.alias("lines"))
    marks = rows.select("doc_id", "of", F.transform("lines", lambda line: F.when(line != "", F.md5(line)).otherwise("")).alias("marks"))
    last = F.greatest(F.size("marks") - WIDTH, F.lit(0))
    joined = F.transform(F.sequence(F.lit(0), last), lambda at: F.concat_ws(
        "|", *[F.get("marks", at + k) for k in range(WIDTH)]))
    blank = ["|" * k for k in range(WIDTH)]
    return (marks.select("doc_id", "of", F.posexplode(joined).alias("line", "key")).filter(~F.col("key").isin(blank))
            .select("doc_id", "of", "line", F.unhex(F.md5("key")).alias("key")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, array of the line numbers that later occurrences cover."""
    found = windows(docs)
    place = F.struct(F.col("doc_id"), F.col("of"), F.col("line"))
    first = (found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter(F.col("first") != F.col("last")).select("key", "first"))
    # As a table of its own it leaves the join below free to split a very common window over many tasks.
    first = stored(first, "first-windows")
    later = found.join(first, "key").filter(place != F.col("first"))
    covered = F.array_distinct(F.flatten(F.collect_set(F.array(*[F.col("line") + k for k in range(WIDTH)]))))
    return later.groupBy("doc_id", "of").agg(covered.alias("covered"))


def without_repeated_lines(docs: DataFrame, left: str = "__text", removed: str = "__removed") -> DataFrame:
    """All rows and columns of ``docs``; ``left`` has the text that stays, ``removed`` the number of lines that went. The caller
    names both; ``docs`` must not have columns of these names."""
    at, of, gone_lines = (unused(name, docs) for name in ("id", "of", "covered"))
    gone = repeated_lines(docs).select(F.col("doc_id").alias(at), F.col("of").alias(of), F.col("covered").alias(gone_lines))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(at)) & (F.md5(docs["text"]) == F.col(of)), "left")
    lines = F.split("text", "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_except(every, F.col(gone_lines))
    shorter = F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n")
    changed = F.col(gone_lines).isNotNull()
    return joined.select(
        *[docs[c] for c in docs.columns], F.when(changed, shorter).otherwise(F.col("text")).alias(left),
        F.when(changed, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long").alias(removed))
