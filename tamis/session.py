"""Settings read from the session, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Without the setting, a session on one machine uses a temporary folder, which goes with the
    process; on a cluster that is an error, since executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tamis-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    What reads it no longer depends on recomputing ``df``, and losing an executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tamis-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
