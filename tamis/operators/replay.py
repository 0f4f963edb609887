"""Replay of a cleaning plan from the states that earlier replays kept.

The state after each action is a table named by a digest of the input's version and of all actions up to it. A replay looks for the longest
beginning of its plan that has a state and goes on from there, so after switching action n on or off the actions before it are not
run again. How many rows an action changed is kept with its state.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import cleaning
from tamis.operators.cleaning import CleaningAction
from tamis.sources import files


def _told(value) -> object:
    """A parameter, or what identifies a table: its number of rows and the sum of their hashes."""
    if not isinstance(value, DataFrame):
        return value
    rows = value.select(F.xxhash64(*[F.col(name) for name in sorted(value.columns)]).cast("decimal(38,0)").alias("h"))
    return [str(part) for part in rows.agg(F.count("*"), F.sum("h")).head()]


def digests(version: str, actions: Iterable[CleaningAction]) -> list[str]:
    """A digest for the input and each beginning of the plan that is enabled."""
    out = [hashlib.sha256(version.encode()).hexdigest()]
    for action in cleaning.enabled(actions):
        params = {name: _told(value) for name, value in sorted(action.params.items())}
        told = json.dumps([out[-1], action.action_type, action.column_name, params], ensure_ascii=False)
        out.append(hashlib.sha256(told.encode()).hexdigest())
    return out


def _kept(spark: SparkSession, folder: str, digest: str) -> dict | None:
    place = f"{folder}/{digest}.json"
    if not files.exists(spark, place):
        return None
    return json.loads("".join(row[0] for row in spark.read.text(place).collect()))


def replay(
    df: DataFrame, actions: Iterable[CleaningAction], *, folder: str, version: str, keep: Collection[int] | None = None
) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """The current state, (order_index, rows affected) for each enabled action, and how many actions were not run again.

    ``version`` names the input's content: another version, another name. Each state costs a copy of the table in ``folder``;
    ``keep`` names the actions (by order_index) after which one is kept, by default all. The last state is always kept. Two
    replays at the same time may both compute a state; one of the two copies is kept.
    """
    spark, plan = df.sparkSession, cleaning.enabled(actions)
    names = digests(version, plan)
    known = {}
    for at in range(len(plan), 0, -1):
        if found := _kept(spark, folder, names[at]):
            known = found
            break
    else:
        at = 0
    state = spark.read.parquet(known["path"]) if known else df
    counts, skipped, watched = [tuple(one) for one in known.get("affected", [])], at, []
    for i in range(at, len(plan)):
        action = plan[i]
        state, watching = cleaning.observed(state, action)
        watched.append((action.order_index, watching))
        if i + 1 < len(plan) and keep is not None and action.order_index not in keep:
            continue
        path = f"{folder}/{names[i + 1]}-{uuid.uuid4().hex}"
        state.write.parquet(path)
        counts += [(index, watching()) for index, watching in watched]
        watched = []
        if not files.create_new(spark, f"{folder}/{names[i + 1]}.json", json.dumps({"path": path, "affected": counts})):
            files.remove(spark, path)
            path = _kept(spark, folder, names[i + 1])["path"]
        state = spark.read.parquet(path)
    return state, counts, skipped


def forget(spark: SparkSession, folder: str, version: str, actions: Iterable[CleaningAction]) -> int:
    """Remove the states of ``folder`` that the replay of this plan does not use; tells how many."""
    used, gone = set(digests(version, actions)), 0
    for name in files.names(spark, folder):
        if name.endswith(".json") and name[: -len(".json")] not in used:
            kept = _kept(spark, folder, name[: -len(".json")])
            files.remove(spark, f"{folder}/{name}")  # first the name, so that no replay finds a state that is half gone
            files.remove(spark, kept["path"])
            gone += 1
    return gone
