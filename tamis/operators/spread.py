"""Small tables: spread over the cores, and held in memory while several passes read them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

# By the optimizer's estimate of the files.  A larger table already has enough splits to occupy the cores.
SMALL_BYTES = 256 * 1024**2
# Equal rows compress to almost nothing: a small file may hold billions.
SMALL_ROWS = 5_000_000


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether the optimizer knows the table to be small, and its rows are few."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > limit:
        return False
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def spread(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as there are cores; a larger one as it is.

    A small file is a single split, so a single task would do all the work.
    """
    return _dealt(df) if is_small(df) else df


def _dealt(df: DataFrame) -> DataFrame:
    # In turn, so that equal rows do not meet; Spark orders rows first, so a task run again deals them alike.
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """A small table spread and cached for the duration; a larger one is scanned by each pass."""
    if not is_small(df):
        yield df
        return
    cached = _dealt(df).persist()
    cached.count()  # filled once, before concurrent passes ask for it
    try:
        yield cached
    finally:
        cached.unpersist()
