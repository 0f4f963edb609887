"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.session import written

#: A word: a maximal run of anything but ASCII white space (for Java and DuckDB regular expressions).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows in one Arrow batch. A batch of long texts must fit in a Python worker.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at BATCH_ROWS rows or fewer, so that a Python worker's memory does not follow the partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """All of a table of at most ``rows`` rows, else about so many: those with the smallest hash of ``columns``.

    The share is set by a count, so that no task has to gather the sample.
    """
    count = df.count()
    if count <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) < int(rows / count * (1 << 31)))


def beside(table: DataFrame, label: str, most_rows: int = 100_000) -> DataFrame:
    """A table of a few short columns, written; hinted for broadcast if it has at most ``most_rows`` rows."""
    table = written(table, label)
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table


def word_count(text: Column) -> Column:
    """Words in a text; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd number, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_known: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1), modulo 2 ** 64."""
    powers = _known.get(base, np.ones(1, np.uint64))
    with np.errstate(over="ignore"):
        while len(powers) < count:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), 1 << 64))])
    _known[base] = powers
    return powers[:count]


class Hashed:
    """Karp-Rabin fingerprints of any substring of one buffer, from prefix sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        scaled = (data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(scaled, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of data[start:end] for each pair; equal strings have equal fingerprints."""
        raw = (self.sums[ends] - self.sums[starts]) * _powers(INVERSE, len(self.sums))[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def in_groups(texts: list[str | None], most: int = 1 << 21):
    """Consecutive slices of a list of texts that hold about ``most`` characters (one text at least)."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        length = len(text) if text else 0
        if at > first and size + length > most:
            yield slice(first, at)
            first, size = at, 0
        size += length
    if first < len(texts):
        yield slice(first, len(texts))
