"""Datasets registered as they arrive in a folder, once each."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamis.intake import Store, prepared
from tamis.operators.local import local_table
from tamis.sources import files, registry
from tamis.sources.loader import Refused

REFUSAL_SCHEMA = "path string, motif string"
CONCURRENT_FILES = 4


def watch(
    spark: SparkSession,
    folder: str,
    store: Store,
    workspace: str,
    *,
    files_per_trigger: int = 32,
    max_bytes: int | None = None,
    max_rows: int | None = None,
) -> StreamingQuery:
    """Start registering the CSV and Parquet files of a drop folder; stops when there are none left.

    The stream carries paths and sizes only; each file has a schema of its own, so each is
    loaded and profiled by its own distributed jobs, a few files at a time.  A batch that is run again after a failure
    skips the files it already registered or refused: each has a file of its name in the registry or among the refusals,
    which can be made once.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.{csv,parquet}").option("maxFilesPerTrigger", files_per_trigger)
        .load(folder).select("path", "length")
    )

    def take_one(session: SparkSession, path: str) -> None:
        refusal = f"{store.folder}/refus/{registry.dataset_id(workspace, path)}.json"
        if registry.is_registered(session, store.registry, registry.dataset_id(workspace, path)) or files.exists(session, refusal):
            return
        try:
            registry.commit(session, store.registry, prepared(session, workspace, path, max_bytes=max_bytes, max_rows=max_rows))
            return
        except Refused as reason:
            said = str(reason)
        except PySparkException as failure:  # a file that cannot be read must not stop those after it
            said = f"Lecture impossible : {type(failure).__name__}."
        files.create_new(session, refusal, json.dumps({"path": path, "motif": said}, ensure_ascii=False))

    def take(batch: DataFrame, _: int) -> None:
        paths = [row["path"] for row in batch.sort("path").collect()]  # at most files_per_trigger
        with ThreadPoolExecutor(CONCURRENT_FILES) as pool:
            list(pool.map(lambda path: take_one(batch.sparkSession, path), paths))

    return (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{store.folder}/suivi")
        .trigger(availableNow=True).start()
    )


def refusals(spark: SparkSession, store: Store) -> DataFrame:
    """Files that could not be accepted, and why."""
    try:
        return spark.read.schema(REFUSAL_SCHEMA).json(f"{store.folder}/refus/*.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], REFUSAL_SCHEMA)
