"""Checks across tables: joins of facts to a dimension, orphan keys, coverage, means by class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text


def folded(value: Column) -> Column:
    """Form in which spellings that differ by case or outer blanks are the same."""
    return text.caseless(text.strip(value))


def sum_by_attribute(
    facts: DataFrame,
    dimension: DataFrame,
    *,
    key: str,
    dimension_key: str,
    measure: str,
    by: Sequence[Column],
    dedupe: bool = False,
) -> DataFrame:
    """Sum and count of a measure of the facts by attributes of the dimension.

    The facts are totalled per key before they meet the dimension, so a key that holds a third
    of them is one row per task, not a partition.  A dimension row written twice counts twice,
    as in a plain join, unless ``dedupe`` drops exact duplicates first.
    """
    people = dimension.dropDuplicates() if dedupe else dimension
    attributes = [column.alias(f"_{i}") for i, column in enumerate(by)]
    members = people.select(F.col(dimension_key).alias("_cle"), *attributes)
    totals = facts.groupBy(F.col(key).alias("_cle")).agg(
        F.sum(measure).alias("_somme"), F.count(F.lit(1)).alias("_lignes")
    )
    joined = totals.join(members, "_cle")
    return joined.groupBy(*[f"_{i}" for i in range(len(by))]).agg(
        F.sum("_somme").alias("total"), F.sum("_lignes").alias("nb_lignes")
    )


def key_counts(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(F.col(key).alias("cle")).agg(F.count(F.lit(1)).alias("nb_lignes"))


def orphan_keys(facts: DataFrame, dimension: DataFrame, *, key: str, dimension_key: str) -> DataFrame:
    """Rows (cle, nb_lignes): keys of the facts that the dimension does not know."""
    known = dimension.select(F.col(dimension_key).alias("cle"))
    return key_counts(facts, key).where(F.col("cle").isNotNull()).join(known, "cle", "left_anti")


def key_coverage(facts: DataFrame, dimension: DataFrame, *, key: str, dimension_key: str) -> DataFrame:
    """One row (nb_lignes, lignes_resolues, part_resolue) over all fact rows."""
    known = dimension.select(F.col(dimension_key).alias("cle")).distinct().withColumn("_connu", F.lit(True))
    counted = key_counts(facts, key).join(known, "cle", "left")
    return counted.agg(
        F.sum("nb_lignes").alias("nb_lignes"),
        F.coalesce(F.sum(F.when(F.col("_connu"), F.col("nb_lignes"))), F.lit(0).cast("long")).alias("lignes_resolues"),
    ).withColumn("part_resolue", text.share(F.col("lignes_resolues"), F.col("nb_lignes")))


def mean_by_class(df: DataFrame, *, label: str, measure: str) -> DataFrame:
    """Rows (classe, nb_lignes, moyenne): mean of a measure for each class."""
    return df.groupBy(F.col(label).alias("classe")).agg(
        F.count(F.lit(1)).alias("nb_lignes"), F.round(F.avg(measure), 2).alias("moyenne")
    )
