"""Quality score out of 100, with the reasons that lowered it."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import fixed, text


def penalties(columns: Column, rows: Column, duplicates: Column) -> Column:
    """The five penalties, in reporting order, as an array of (critere, impact, detail)."""
    width = F.size(columns)
    total_missing = F.aggregate(columns, F.lit(0.0), lambda acc, c: acc + c["part_manquantes"])
    missing = F.when(width > 0, total_missing / width).otherwise(F.lit(0.0))

    def counted(condition) -> Column:
        return F.size(F.filter(columns, condition))

    empty = counted(lambda c: c["part_manquantes"] > fixed.MOSTLY_EMPTY)
    constant = counted(lambda c: c["cardinalite"] <= 1)
    touched = counted(lambda c: F.size(c["anomalies"]) > 0)
    doubled = text.share(duplicates, rows)

    def entry(criterion: tuple[str, int], part: Column, detail: Column) -> Column:
        name, weight = criterion
        return F.struct(
            F.lit(name).alias("critere"), (-F.round(part * weight, 1)).alias("impact"), detail.alias("detail")
        )

    return F.array(
        entry(fixed.MISSING_CRITERION, missing, F.format_string(fixed.MISSING_DETAIL, text.percent(missing))),
        entry(
            fixed.DUPLICATE_CRITERION, doubled,
            F.format_string(fixed.DUPLICATE_DETAIL, duplicates, text.percent(doubled)),
        ),
        entry(fixed.EMPTY_CRITERION, text.share(empty, width), F.format_string(fixed.EMPTY_DETAIL, empty)),
        entry(fixed.CONSTANT_CRITERION, text.share(constant, width), F.format_string(fixed.CONSTANT_DETAIL, constant)),
        entry(fixed.ANOMALY_CRITERION, text.share(touched, width), F.format_string(fixed.ANOMALY_DETAIL, touched)),
    )


def with_quality(whole: DataFrame) -> DataFrame:
    """Add ``score_qualite`` and ``explication_qualite`` to a row (nb_lignes, nb_doublons, colonnes)."""
    return whole.withColumn("explication_qualite", _reasons()).withColumn("score_qualite", _score())


@lru_cache(maxsize=1)
def _reasons() -> Column:
    found = penalties(F.col("colonnes"), F.col("nb_lignes"), F.col("nb_doublons"))
    return F.filter(found, lambda p: p["impact"] < 0)


@lru_cache(maxsize=1)
def _score() -> Column:
    lost = F.aggregate("explication_qualite", F.lit(0.0), lambda acc, p: acc + p["impact"])
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) + lost))
    return F.round(bounded, 1)


def band(score: Column) -> Column:
    """Quality band a score falls in."""
    (high, good), (middle, watch), (_, weak) = fixed.BANDS
    return F.when(score >= high, good).when(score >= middle, watch).otherwise(weak)
