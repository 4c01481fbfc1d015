"""Plan shapes that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], slots: list[Column], order: list[Column], value: Column, name: str) -> DataFrame:
    """Running total per key, without one task per key.

    ``slots`` cut the time of a key ever finer; none may decrease along ``order``. Rows are summed per slot first; a
    running sum over the sums of one level inside a slot of the level above gives each slot its opening balance, and
    the sum over single rows stays inside a slot of the finest level.
    """
    levels = [f"__slot{i}" for i in range(len(slots))]
    rows = df.withColumns(dict(zip(levels, slots))).withColumn("__value", value)
    opened = rows.withColumn("__open", F.lit(0))
    for i in range(len(levels)):
        above, here = [*keys, *levels[:i]], [*keys, *levels[:i + 1]]
        sums = rows.groupBy(*here).agg(F.sum("__value").alias("__sum"))
        earlier = Window.partitionBy(*above).orderBy(levels[i]).rowsBetween(Window.unboundedPreceding, -1)
        opening = sums.select(*here, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__more"))
        opened = opened.join(opening, here).withColumn("__open", F.col("__open") + F.col("__more")).drop("__more")
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return opened.withColumn(name, F.col("__open") + F.sum("__value").over(inside)).drop(*levels, "__value", "__open")
