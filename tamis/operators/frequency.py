"""The value-frequency table: every column's distinct values with their number of rows.

Nearly every measure of a profile is a function of (column, value, count), so the rows are
counted once, with a partial aggregate before the single exchange: what moves is distinct
values, not rows, and a value held by a third of the rows moves once per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import fixed, text
from tamis.operators.columns import ColumnRef, melt


# Characters that order texts of equal count first; where they tie, ``profile`` reads the whole texts.
ORDER_LENGTH = 256


def count_values(df: DataFrame, refs: Sequence[ColumnRef]) -> DataFrame:
    """Rows (c, v, n) of columns of one physical family; see ``signed_count`` for missing values."""
    return melt(df, refs).groupBy("c", "v").agg(signed_count("v"))


def signed_count(name: str) -> Column:
    """Number of rows, negative for the row that stands for missing values.

    Consumers tell the two apart by the count.  A filter on the value would be pushed below the
    exchange, each consumer would get an exchange of its own, and none could be reused.
    """
    return F.sum(F.when(F.col(name).isNull(), -1).otherwise(1)).alias("n")


def count_texts(df: DataFrame, refs: Sequence[ColumnRef]) -> DataFrame:
    """Rows (c, v, long, n) of text columns; see ``signed_count`` for missing values.

    ``v`` is the value, or its digest when it is long.  Whatever has to be known about a long
    text is read off the whole text before it is replaced, and kept in ``long``.
    """
    # One projection per step, so that a long text is trimmed, folded and digested once.
    steps = _long_steps()
    rows = melt(df, refs)
    for step in steps[:-1]:
        rows = rows.withColumns(step)
    return rows.groupBy("c", *[column.alias(name) for name, column in steps[-1].items()]).agg(
        signed_count("v")
    )


@lru_cache(maxsize=1)
def _long_steps() -> list[dict[str, Column]]:
    value, stripped, word = F.col("v"), F.col("_stripped"), F.col("_word")
    long = F.col("_long")
    facts = F.struct(
        F.col("_skey").alias("stripped"),
        text.short_key(F.col("_folded")).alias("folded"),
        F.when(~text.is_long(stripped), stripped).alias("readable"),
        F.coalesce(text.matches_pii(stripped, fixed.EMAIL), F.lit(False)).alias("email"),
        F.coalesce(text.is_known_name(word), F.lit(False)).alias("name"),
        F.when(long, text.shown(value)).alias("shown"),
        F.substring(value, 1, ORDER_LENGTH).alias("start"),
    )
    return [
        {"_long": text.is_long(value)},
        {"_stripped": F.when(long, text.strip(value))},
        {"_folded": text.caseless(stripped), "_skey": text.short_key(stripped), "_word": text.first_word(stripped)},
        {"_word": F.when(F.char_length(word) <= 64, word)},
        {"_facts": F.when(long, facts)},
        {"v": F.when(long, text.short_key(value)).otherwise(value), "long": F.col("_facts")},
    ]


# Counters kept per value, and the text of which each is true.
SHAPES = tuple(name for name, _, _ in fixed.DATE_SHAPES)
KINDS = tuple(kind for kind, _ in fixed.PII_PATTERNS)
COUNTERS = (
    *[f"forme_{i}" for i in range(len(SHAPES))],
    "mots_booleens",
    *[f"motif_{i}" for i in range(len(KINDS))],
    "noms",
    "vides",
)


@lru_cache(maxsize=4)
def text_tests(name: str) -> dict[str, Column]:
    """The predicates counted over the stripped values of a text column."""
    stripped = F.col(name)
    tests = {}
    for i, (_, pattern, _) in enumerate(fixed.DATE_SHAPES):
        tests[f"forme_{i}"] = (F.char_length(stripped) == 10) & stripped.rlike(pattern)
    tests["mots_booleens"] = text.is_boolean_word(stripped)
    for i, kind in enumerate(KINDS):
        tests[f"motif_{i}"] = text.matches_pii(stripped, kind)
    tests["noms"] = text.is_known_name(text.first_word(stripped))
    tests["vides"] = stripped == ""
    return tests


def text_measures(texts: DataFrame) -> DataFrame:
    """One row per text column: counts, three distinct counts, and the counters above.

    The three distinct counts (as written, stripped, caseless) come from three nested
    groupings; each is a plain sum with partial aggregation, where three ``count(distinct)``
    would triple the rows and a set per column would not fit a task.
    """
    valued = (
        texts.where("n > 0")
        .withColumn("readable", _readable())
        .select("c", "n", *_weighted_tests())
    )

    def totals(*names: str) -> list[Column]:
        return [F.sum(name).alias(name) for name in names]

    as_stripped = valued.groupBy("c", "folded", "stripped").agg(
        *totals("n", *COUNTERS), F.count(F.lit(1)).alias("distinctes")
    )
    as_folded = as_stripped.groupBy("c", "folded").agg(
        *totals("n", *COUNTERS, "distinctes"), F.count(F.lit(1)).alias("sans_blancs")
    )
    measured = as_folded.groupBy("c").agg(
        *totals("n", *COUNTERS, "distinctes", "sans_blancs"), F.count(F.lit(1)).alias("sans_casse")
    )
    return measured.withColumnRenamed("n", "renseignees")


@lru_cache(maxsize=1)
def _readable() -> Column:
    """The stripped text, missing when it is too long to have been kept."""
    long = F.col("long")
    return F.coalesce(F.when(long.isNull(), text.strip(F.col("v"))), long["readable"])


@lru_cache(maxsize=1)
def _weighted_tests() -> list[Column]:
    """Stripped and caseless keys, and for each test the rows that pass it."""
    long, readable = F.col("long"), F.col("readable")
    unread = {"motif_0": long["email"], "noms": long["name"]}
    columns = [
        F.coalesce(long["stripped"], readable).alias("stripped"),
        F.coalesce(long["folded"], text.short_key(text.caseless(readable))).alias("folded"),
    ]
    for name, test in text_tests("readable").items():
        hit = F.when(readable.isNotNull(), test).otherwise(unread.get(name, F.lit(False)))
        columns.append(F.when(hit, F.col("n")).otherwise(F.lit(0).cast("long")).alias(name))
    return columns


def missing_counts(counted: DataFrame) -> DataFrame:
    """Rows (c, manquantes): the row that stands for the missing values of each column."""
    return counted.where("n < 0").select("c", (-F.col("n")).alias("manquantes"))


def text_rates(df: DataFrame, refs: Sequence[ColumnRef]) -> DataFrame:
    """The counters of the text columns, straight from the rows: no value is shuffled."""
    rows = melt(df, refs).where(F.col("v").isNotNull()).select("c", text.strip(F.col("v")).alias("s"))
    tests = text_tests("s")
    return rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("renseignees"),
        *[F.count_if(test).alias(name) for name, test in tests.items()],
    )
