"""Registry of profiled datasets: a folder with a small file for each version of each dataset, made by one writer only.

A version is committed by making its file, which fails if there is one. Whatever else belongs to a version (masked table, tokens)
is written before, to places of its own that only the committed file names: what an interrupted or beaten writer leaves is never read.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import fixed
from tamis.operators.local import local_table
from tamis.sources import files
from tamis.sources.loader import Refused

REGISTRY_SCHEMA = (
    "id string, workspace_id string, name string, format string, size_bytes bigint, path string, "
    "profile string, quality_score double, pii_status string, version int, created_at timestamp"
)
_BESIDE = ", lot string, etat string"
MAPPING_SCHEMA = "file_id string, column_name string, original_hash string, token string, n_words int, words_hash string"


def dataset_id(workspace: str, path: str) -> str:
    """Opaque identifier that a second delivery of the same file finds again."""
    return hashlib.sha256(f"{workspace}\u0000{path}".encode()).hexdigest()[:36]


def entry(
    *, workspace: str, path: str, profile: str, score: float, status: str, size: int = 0,
    version: int = 1, file_id: str | None = None, name: str | None = None,
    created_at: datetime | None = None,
) -> dict:
    """A registry row as a mapping."""
    return {
        "id": file_id or dataset_id(workspace, path),
        "workspace_id": workspace,
        "name": name or path.rstrip("/").rsplit("/", 1)[-1],
        "format": path.rstrip("/").rsplit(".", 1)[-1].lower(),
        "size_bytes": size,
        "path": path,
        "profile": profile,
        "quality_score": score,
        "pii_status": status,
        "version": version,
        "created_at": created_at or datetime.now(timezone.utc),
    }


def commit(spark: SparkSession, registry: str, row: dict, lot: str | None = None, etat: str | None = None) -> bool:
    """Commit a version of a dataset with its tokens ``lot`` and the state ``etat`` of its profile.

    False, and nothing done, if this version was committed before.
    """
    told = {**row, "created_at": row["created_at"].astimezone(timezone.utc).isoformat(), "lot": lot, "etat": etat}
    return files.create_new(spark, _entry_path(registry, row["id"], row["version"]), json.dumps(told, ensure_ascii=False))


def is_registered(spark: SparkSession, registry: str, file_id: str) -> bool:
    return files.exists(spark, _entry_path(registry, file_id, 1))


def _entry_path(registry: str, file_id: str, version: int) -> str:
    return f"{registry}/{file_id}-v{version}.json"


def _entries(spark: SparkSession, registry: str, names: str = "*.json") -> DataFrame:
    schema = REGISTRY_SCHEMA.replace("created_at timestamp", "created_at string") + _BESIDE
    try:
        return spark.read.schema(schema).json(f"{registry}/{names}").withColumn("created_at", F.col("created_at").cast("timestamp"))
    except AnalysisException as error:  # no such file before the first registration
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], REGISTRY_SCHEMA + _BESIDE)


def read(spark: SparkSession, registry: str) -> DataFrame:
    """Every version of every dataset; empty when nothing was registered yet."""
    return _entries(spark, registry).drop("lot", "etat")


def versions(spark: SparkSession, registry: str, file_id: str) -> DataFrame:
    """Every version of one dataset; no other dataset's files are read."""
    return _entries(spark, registry, f"{file_id}-v*.json").drop("lot", "etat")


def state_of(spark: SparkSession, registry: str, file_id: str) -> str | None:
    """The state of the profile that was committed with the latest version of a dataset."""
    return find(_entries(spark, registry, f"{file_id}-v*.json"), file_id)["etat"]


def current(rows: DataFrame) -> DataFrame:
    """The latest version of each dataset."""
    latest = Window.partitionBy("id").orderBy(F.desc("version"), F.desc("created_at"))
    return rows.withColumn("_rang", F.row_number().over(latest)).where("_rang = 1").drop("_rang")


def listing(rows: DataFrame, workspace: str | None = None) -> DataFrame:
    """The datasets of a workspace (or of all), newest first, without their profiles."""
    chosen = rows if workspace is None else rows.where(F.col("workspace_id") == workspace)
    return (
        current(chosen)
        .select("id", "name", "format", "size_bytes", "pii_status", "quality_score", "created_at")
        .sort(F.desc("created_at"), "id")
    )


def find(rows: DataFrame, file_id: str) -> dict:
    """One dataset, or a refusal when there is none."""
    row = current(rows.where(F.col("id") == file_id)).head()
    if row is None:
        raise Refused("Aucun fichier de ce numéro : il n'existe pas dans le registre.")
    return row.asDict()


def profile_of(rows: DataFrame, file_id: str) -> str:
    """The stored profile as JSON, ``{}`` when there is none."""
    return find(rows, file_id)["profile"] or "{}"


def check_maskable(row: dict) -> None:
    """A dataset is masked once, and only if there is something to mask."""
    if row["pii_status"] == fixed.PII_MASKED:
        raise Refused("Les jetons remplacent déjà les valeurs de ce fichier.")
    if row["pii_status"] != fixed.PII_FOUND:
        raise Refused(
            "Ce fichier ne montre pas de données personnelles : rien à pseudonymiser."
        )


def write_mapping(mapping: DataFrame, file_id: str, folder: str, lot: str) -> str:
    """Write the tokens of a dataset, one row per distinct masked value, never the value; they count once ``lot`` is committed."""
    path = f"{folder}/lot={lot}"
    mapping.select(
        F.lit(file_id).alias("file_id"), F.col("colonne").alias("column_name"),
        F.col("empreinte").alias("original_hash"), F.col("jeton").alias("token"),
        F.col("mots").alias("n_words"), F.col("empreinte_mots").alias("words_hash"),
    ).write.parquet(path)
    return path


def mappings(spark: SparkSession, registry: str, folder: str) -> DataFrame:
    """The tokens of all committed versions (file_id, column_name, original_hash, token, n_words, words_hash)."""
    committed = _entries(spark, registry).where(F.col("lot").isNotNull()).select("lot")
    try:
        kept = spark.read.schema(MAPPING_SCHEMA + ", lot string").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], MAPPING_SCHEMA)
    return kept.join(committed, "lot", "left_semi").drop("lot")  # the lots of other folders are not opened
