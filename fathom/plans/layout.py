"""Number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work a task per core if the input is a scan of few, small files.

    Looks only at the files that the scan would read (driver metadata), so no job is run while the plan is built. Larger
    inputs, and anything but a batch scan of files, are left as they are.
    """
    if df.isStreaming:
        return df
    files = df._jdf.inputFiles()
    cores = df.sparkSession.sparkContext.defaultParallelism
    optimized = df._jdf.queryExecution().optimizedPlan()
    small = 0 < len(files) < cores and int(str(optimized.stats().sizeInBytes())) < cores * 128e6
    return df.repartition(cores) if small and not _shuffles(optimized) else df


def _shuffles(plan) -> bool:
    text = plan.toString()
    return any(word in text for word in ("Join", "Aggregate", "Window", "Repartition", "Sort", "Deduplicate"))
