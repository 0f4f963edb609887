"""Duplicate rows: rows minus distinct rows, a missing cell being equal to a missing cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.columns import NESTED, TEXT, ColumnRef, columns_of, quoted


def row_digest(refs: Sequence[ColumnRef]) -> Column:
    """Digest of a whole row: 32 bytes to move instead of the row.

    Cells are written with their length, so that no two different rows read the same, and a
    missing cell is not an empty one.
    """
    cells = []
    for ref in refs:
        written = F.to_json(F.struct(quoted(ref.name))) if ref.family == NESTED else ref.printed
        sized = F.concat(F.char_length(written).cast("string"), F.lit(":"), written)
        cells.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat_ws(",", *cells), 256))


# Beyond these, a digest is narrower than the cells it stands for.
FIXED_CELLS = 16
TEXT_CELLS = 2
TEXT_LENGTH = 64


def row_key(refs: Sequence[ColumnRef]) -> list[Column]:
    """Columns that are equal exactly when rows are, no wider than needed.

    Numbers and dates are compared as they are; texts by value while they are few and short,
    otherwise by digest.
    """
    fixed = [ref for ref in refs if ref.family not in (NESTED, TEXT)]
    texts = [ref for ref in refs if ref.family in (NESTED, TEXT)]
    if len(fixed) > FIXED_CELLS:
        return [row_digest(refs).alias("_0")]
    keys = [ref.value.alias(f"_{ref.index}") for ref in fixed]
    if len(texts) > TEXT_CELLS or any(ref.family == NESTED for ref in texts):
        return [*keys, row_digest(texts).alias("_t")]
    for ref in texts:
        short = F.char_length(ref.value) <= TEXT_LENGTH
        digest = F.when(~short, F.unhex(F.sha2(ref.value, 256)))
        keys += [F.when(short, ref.value).alias(f"_{ref.index}"), digest.alias(f"_{ref.index}d")]
    return keys


def duplicate_rows(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """One row (nb_lignes, doublons)."""
    distinct = df.groupBy(*row_key(columns_of(df, exclude))).agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nb_lignes"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("doublons"),
    )
