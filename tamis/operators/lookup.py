"""Attaching a value to every row from a table keyed by one of its columns, whatever the skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.columns import quoted

# Lookup tables up to this many rows and bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024**2
# A key held by more than this share of the rows is "hot": there are at most 10,000 of them.
HOT_SHARE = 1e-4
SPREAD = 1024


def attach(
    df: DataFrame,
    key: Column,
    table: DataFrame,
    *,
    size: int,
    total: int,
    width: int | None = None,
    out: str = "_valeur",
    broadcast_rows: int = BROADCAST_ROWS,
    scatter: Sequence[Column] | None = None,
) -> DataFrame:
    """Add column ``out``: the ``valeur`` that ``table`` (cle, valeur, occurrences) gives the key.

    ``size`` is the number of rows of ``table``, whose keys are unique, and ``total`` the number
    of rows of ``df`` it stands for, and ``width`` the bytes of its keys and values (measured here if
    not given).  A small table is broadcast.  With a large one, the hot keys
    (at most 1 / HOT_SHARE of them) are broadcast, and their rows and the rows without a key are
    spread over the partitions, by a hash of the columns ``scatter`` (default: the whole row), instead of meeting in one.
    """
    columns = [quoted(name) for name in df.columns]
    keyed = df.withColumn("_cle", key)
    cold = table.select(F.col("cle").alias("_cle"), F.col("valeur").alias(out), "occurrences")
    if size <= broadcast_rows and width is None:
        width = table.agg(F.coalesce(F.sum(
            F.coalesce(F.octet_length(F.col("cle").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("valeur").cast("string")), F.lit(0))
        ), F.lit(0))).first()[0]
    if size <= broadcast_rows and (width or 0) <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(cold.drop("occurrences")), "_cle", "left").select(*columns, out)

    hot = table.where(F.col("occurrences") > HOT_SHARE * total).select(
        F.col("cle").alias("_cle"), F.col("valeur").alias("_chaud"), F.lit(True).alias("_vu")
    )
    marked = keyed.join(F.broadcast(hot), "_cle", "left")
    left_to_find = F.when(F.col("_vu").isNull(), F.col("_cle"))
    # A hash of the row, not a random number: a task that is run again sends rows to the same place.
    scattered = F.pmod(F.xxhash64(*(scatter or [column.cast("string") for column in columns])), F.lit(SPREAD))
    left = marked.withColumn("_froid", left_to_find).withColumn(
        "_part", F.when(F.col("_froid").isNull(), scattered).otherwise(F.lit(0).cast("long"))
    )
    # Always zero, but not a constant: the optimizer would drop a constant from the join keys.
    zero = F.pmod(F.col("occurrences"), F.lit(1))
    right = cold.select(F.col("_cle").alias("_froid"), zero.alias("_part"), out)
    joined = left.join(right, ["_froid", "_part"], "left")
    return joined.select(*columns, F.coalesce("_chaud", out).alias(out))
