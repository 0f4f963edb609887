"""Cleaning plans: ordered actions replayed on an immutable table.

An action carries the values computed when it was decided (a mean, fences, a table of
spellings), so replaying it later gives the same result even if the data it was computed
from has changed.  A plan is a fold of DataFrame transformations: one lazy Spark plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text
from tamis.operators import quantiles
from tamis.operators.columns import columns_of, melt, quoted
from tamis.operators.crosscheck import folded, orphan_keys
from tamis.operators.local import local_table
from tamis.operators.lookup import attach
from tamis.session import written

IMPUTE, DEDUPE, DATES, SPELLINGS, OUTLIERS, NEGATIVES, ORPHANS = (
    "impute_mean", "drop_duplicates", "unify_dates", "regroup_spellings",
    "handle_outliers", "flag_negative", "flag_orphans",
)
FLAG_SUFFIX = {OUTLIERS: "_extreme", NEGATIVES: "_negatif", ORPHANS: "_orphelin"}
ACTION_SCHEMA = (
    "file_id string, order_index int, action_type string, column_name string, "
    "params string, rows_affected bigint, enabled boolean"
)


@dataclass(frozen=True)
class CleaningAction:
    """One step of a plan; ``params`` makes its replay exact."""

    order_index: int
    action_type: str
    column_name: str | None = None
    params: dict = field(default_factory=dict)
    enabled: bool = True


# --- Deciding: compute the parameters once ------------------------------------------------


def impute_mean(df: DataFrame, column: str, order_index: int = 0) -> CleaningAction:
    mean = df.agg(F.avg(quoted(column))).head()[0]
    return CleaningAction(order_index, IMPUTE, column, {"value": mean})


def handle_outliers(df: DataFrame, column: str, order_index: int = 0, drop: bool = False) -> CleaningAction:
    refs = [ref for ref in columns_of(df) if ref.name == column]
    numbers = melt(df, refs, lambda ref: ref.number)
    quartiles = quantiles.quartiles(numbers, quantiles.sketches(numbers).collect())
    limits = [(low, high) for _, low, high in quantiles.fences(quartiles)]
    low, high = limits[0] if limits else (None, None)
    return CleaningAction(order_index, OUTLIERS, column, {"low": low, "high": high, "drop": drop})


def spellings(df: DataFrame, column: str) -> DataFrame:
    """Rows (cle, valeur, occurrences): each spelling to replace, and the one that replaces it.

    The most frequent spelling of a caseless form is kept, the first in order among equals.
    Forms written in one way only, nearly all of a varied column, are not in the table.
    """
    value = quoted(column)
    counted = (
        df.where(value.isNotNull()).groupBy(value.alias("cle"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .withColumn("forme", folded(F.col("cle")))
    )
    kept = counted.groupBy("forme").agg(
        F.min_by("cle", F.struct(-F.col("occurrences"), F.col("cle"))).alias("valeur"),
        F.count(F.lit(1)).alias("graphies"),
    ).where("graphies > 1")
    return counted.join(kept, "forme").where("cle != valeur").select("cle", "valeur", "occurrences")


def regroup_spellings(df: DataFrame, column: str, order_index: int = 0) -> CleaningAction:
    return CleaningAction(order_index, SPELLINGS, column, _kept(df, spellings(df, column), "graphies"))


def flag_orphans(
    df: DataFrame, column: str, known: DataFrame, known_key: str, order_index: int = 0
) -> CleaningAction:
    lost = orphan_keys(df, known, key=column, dimension_key=known_key)
    table = lost.select("cle", F.lit(True).alias("valeur"), F.col("nb_lignes").alias("occurrences"))
    return CleaningAction(order_index, ORPHANS, column, _kept(df, table, "orphelins"))


def _kept(df: DataFrame, table: DataFrame, label: str) -> dict:
    """A table of values may be long: it is kept as a written table, with its measured size."""
    stored = written(table, label)
    return {"table": stored, "size": stored.count(), "total": df.count()}


# --- Replaying ----------------------------------------------------------------------------


def replay(df: DataFrame, actions: Iterable[CleaningAction]) -> DataFrame:
    """The current state: the original table with the enabled actions applied in order."""
    state = df
    for action in enabled(actions):
        state = _apply(state, action)
    return state


def rows_affected(df: DataFrame, actions: Iterable[CleaningAction]) -> list[tuple[int, int]]:
    """(order_index, rows) for each enabled action, each counted on the state it meets.

    The counts are observed while the whole plan runs once.
    """
    watched, state = [], df
    for action in enabled(actions):
        state, watching = observed(state, action)
        watched.append((action.order_index, watching))
    if watched:
        state.write.format("noop").mode("overwrite").save()
    return [(at, watching()) for at, watching in watched]


def observed(df: DataFrame, action: CleaningAction) -> tuple[DataFrame, Callable[[], int]]:
    """The table after an action, and what tells, once it has been computed, how many rows the action affected."""
    if action.action_type == DEDUPE:
        before, after = Observation(), Observation()
        state = df.observe(before, F.count(F.lit(1)).alias("n")).dropDuplicates().observe(after, F.count(F.lit(1)).alias("n"))
        return state, lambda: before.get["n"] - after.get["n"]
    touched = Observation()
    marked = _marked(df, action).observe(touched, F.count_if("_touchee").alias("n"))
    return _changed(df.columns, marked, action), lambda: touched.get["n"]


def enabled(actions: Iterable[CleaningAction]) -> list[CleaningAction]:
    return sorted((one for one in actions if one.enabled), key=lambda one: one.order_index)


def toggled(actions: Sequence[CleaningAction], order_index: int, enabled: bool) -> list[CleaningAction]:
    return [replace(one, enabled=enabled) if one.order_index == order_index else one for one in actions]


def _apply(df: DataFrame, action: CleaningAction) -> DataFrame:
    if action.action_type == DEDUPE:
        return df.dropDuplicates()
    return _changed(df.columns, _marked(df, action), action)


def _changed(names: Sequence[str], marked: DataFrame, action: CleaningAction) -> DataFrame:
    """The table after an action, from the marked one."""
    name, params = action.column_name, action.params
    value = quoted(name)
    columns = [quoted(column) for column in names]
    if action.action_type in FLAG_SUFFIX and not params.get("drop"):
        return marked.select(*columns, F.col("_touchee").alias(name + FLAG_SUFFIX[action.action_type]))
    if action.action_type in FLAG_SUFFIX:
        return marked.where(~F.col("_touchee")).select(*columns)
    return marked.withColumn(name, F.when(F.col("_touchee"), F.col("_nouvelle")).otherwise(value)).select(*columns)


def _marked(df: DataFrame, action: CleaningAction) -> DataFrame:
    """The table with ``_touchee``, whether the action changes the row, and ``_nouvelle``."""
    value, params = quoted(action.column_name), action.params
    if action.action_type == IMPUTE:
        return _with(df, value.isNull() & F.lit(params["value"] is not None), F.lit(params["value"]))
    if action.action_type == DATES:
        parsed = text.parse_date(text.strip(value)).cast("string")
        return _with(df, parsed.isNotNull() & (parsed != value), parsed)
    if action.action_type == OUTLIERS:
        if params["low"] is None:
            return _with(df, F.lit(False))
        return _with(df, (value < params["low"]) | (value > params["high"]))
    if action.action_type == NEGATIVES:
        return _with(df, value < 0)
    if action.action_type in (SPELLINGS, ORPHANS):
        found = attach(df, value, params["table"], size=params["size"], total=params["total"])
        return _with(found, F.col("_valeur").isNotNull(), F.col("_valeur"))
    raise ValueError(f"action inconnue : {action.action_type}")


def _with(df: DataFrame, touched: Column, new: Column | None = None) -> DataFrame:
    marked = df.withColumn("_touchee", F.coalesce(touched, F.lit(False)))
    return marked if new is None else marked.withColumn("_nouvelle", new)


def plan_table(spark: SparkSession, file_id: str, actions: Sequence[CleaningAction], affected=()) -> DataFrame:
    """The plan as rows to store; parameters that are tables are stored by their files."""
    counts = dict(affected)

    def stored(value):
        return {"files": value.inputFiles()} if isinstance(value, DataFrame) else value

    rows = [
        {
            "file_id": file_id, "order_index": one.order_index, "action_type": one.action_type,
            "column_name": one.column_name,
            "params": json.dumps({name: stored(value) for name, value in one.params.items()}),
            "rows_affected": counts.get(one.order_index, 0), "enabled": one.enabled,
        }
        for one in actions
    ]
    return local_table(spark, rows, ACTION_SCHEMA)


def store_plan(
    spark: SparkSession, folder: str, file_id: str, actions: Sequence[CleaningAction], affected=()
) -> str:
    """Write a plan, and the tables among its parameters, below ``folder``; returns where the plan is."""
    place = f"{folder.rstrip('/')}/{file_id}"

    def stored(action: CleaningAction, name: str, value):
        if not isinstance(value, DataFrame):
            return value
        path = f"{place}/{action.order_index}-{name}"
        value.write.mode("overwrite").parquet(path)
        return {"parquet": path}

    kept = [replace(one, params={name: stored(one, name, value) for name, value in one.params.items()}) for one in actions]
    plan_table(spark, file_id, kept, affected).coalesce(1).write.mode("overwrite").parquet(f"{place}/plan")
    return f"{place}/plan"


def stored_plan(spark: SparkSession, folder: str, file_id: str) -> list[CleaningAction]:
    """The actions of a stored plan, ready to be replayed."""
    rows = spark.read.schema(ACTION_SCHEMA).parquet(f"{folder.rstrip('/')}/{file_id}/plan").collect()  # a row per action

    def read(value):
        return spark.read.parquet(value["parquet"]) if isinstance(value, dict) and "parquet" in value else value

    return [
        CleaningAction(
            row["order_index"], row["action_type"], row["column_name"],
            {name: read(value) for name, value in json.loads(row["params"]).items()}, row["enabled"],
        )
        for row in rows
    ]
