"""Input layout: make sure an input of any size uses the cluster in tasks of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of short texts that one task treats: some tens of seconds of detection.
TASK_ROWS = 50_000


def spread(df: DataFrame, parts: int | None = None, rows: int = TASK_ROWS) -> DataFrame:
    """Repartition an input with fewer splits than there are cores, or with more than ``rows`` rows to a split.

    Detection costs far more per byte than moving the byte, so both are worth one shuffle: a columnar split of 128 MB may
    hold millions of short texts, and the longest task would grow with the table. Rows are counted from the files'
    footers. An input with splits enough is left as it is.
    """
    parts = parts or max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def gather(df: DataFrame, splits: int = 16) -> DataFrame:
    """Merge up to ``splits`` splits of an input of very many small files into one, without a shuffle.

    A split holds some 32 small files, as Spark counts each as 4 MB, and a task that detects takes longer to start than to read them.
    Four tasks a core are left at least; an input of fewer splits is left as it is.
    """
    held = df.rdd.getNumPartitions()
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-held // splits))
    return df.coalesce(parts) if parts < held else df
