"""Whole operations on a dataset: register it, and pseudonymise a registered one."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import fixed
from tamis.operators import privacy, state
from tamis.operators.profile import measure, profile_from
from tamis.session import written
from tamis.sources import files, loader, registry, sinks
from tamis.sources.vault import Vault


@dataclass(frozen=True)
class Store:
    """Where results live: a folder every executor can reach."""

    folder: str

    @property
    def registry(self) -> str:
        return f"{self.folder}/registre"

    @property
    def mappings(self) -> str:
        return f"{self.folder}/jetons"

    def masked(self, file_id: str, version: int, lot: str, kind: str) -> str:
        return f"{self.folder}/masques/{file_id}-v{version}-{lot}.{kind}"

    def tokens(self, spark: SparkSession) -> DataFrame:
        """The tokens of all masked datasets (file_id, column_name, original_hash, token, n_words, words_hash)."""
        return registry.mappings(spark, self.registry, self.mappings)


def examine(df: DataFrame, order_by: str | None = None) -> tuple[dict, list[privacy.Detection]]:
    """Profile (as JSON, with its score) and detections of a table, from one set of measures.

    The profile is stored for good, so it shows no value of a column that is detected as personal.
    """
    hidden = () if order_by is None or not order_by.startswith("_") else (order_by,)
    return _told(measure(df, order_by=None if order_by is None else [order_by], exclude=hidden))


def _told(measures: DataFrame) -> tuple[dict, list[privacy.Detection]]:
    profiled = profile_from(measures).select(
        F.to_json(F.struct("*")).alias("profile"), "score_qualite"
    ).head()
    found = privacy.detections(privacy.detections_from(measures))
    return {"profile": _withheld(profiled["profile"], {one.colonne for one in found}), "score": profiled["score_qualite"]}, found


def _withheld(profile: str, names: set[str]) -> str:
    """A profile without the examples and frequent values of some columns."""
    whole = json.loads(profile)
    for column in whole["colonnes"]:
        if column["nom"] in names:
            column["exemples"] = []
            column.get("statistiques", {}).pop("modalites_frequentes", None)
    return json.dumps(whole, ensure_ascii=False)


def register(
    spark: SparkSession, store: Store, workspace: str, path: str, *,
    max_bytes: int | None = None, max_rows: int | None = None,
) -> dict:
    """Validate, load, profile, scan and register one dataset; returns its registry row.

    A dataset that is registered already stays as it is.
    """
    row = prepared(spark, workspace, path, max_bytes=max_bytes, max_rows=max_rows)
    if registry.commit(spark, store.registry, row):
        return row
    return registry.find(registry.versions(spark, store.registry, row["id"]), row["id"])


def prepared(
    spark: SparkSession, workspace: str, path: str, *,
    max_bytes: int | None = None, max_rows: int | None = None,
) -> dict:
    """The registry row of a dataset, which nothing has been written for yet."""
    table = loader.load(spark, path, max_bytes=max_bytes, max_rows=max_rows, with_position=True)
    size = loader.list_files(spark, path).agg(F.sum("length")).head()[0]
    profiled, found = examine(table, order_by=table.columns[-1])
    return registry.entry(
        workspace=workspace, path=path, size=size, profile=profiled["profile"], score=profiled["score"],
        status=fixed.PII_FOUND if found else fixed.PII_NONE,
    )


def pseudonymise(
    spark: SparkSession, store: Store, file_id: str, *, key: str | None = None, kind: str = "parquet",
    vault: DataFrame | Vault | None = None,
) -> dict:
    """Mask a registered dataset into a new table; returns the new registry row and a summary.

    ``kind`` is the format of the new table, ``parquet`` or ``csv``.  With a ``Vault`` values keep the tokens they have there,
    and it is extended, whoever else extends it meanwhile.  A vault may also be a table (type_pii, empreinte,
    rang, jeton; it may be empty) of one writer; the extended one is written to the store's folder ``coffre``.

    Data and tokens are written to new places first and committed last, so an interruption leaves the dataset as it was,
    and of two that mask it at a time one is refused.  The original is never overwritten while read.
    """
    row = registry.find(registry.versions(spark, store.registry, file_id), file_id)
    registry.check_maskable(row)
    table = loader.load(spark, row["path"], with_position=True)
    position = table.columns[-1]
    found = privacy.detections(privacy.detect(table, exclude=(position,)))
    version, lot = row["version"] + 1, f"l-{uuid.uuid4().hex}"
    if vault is None:
        masked, mapping = privacy.pseudonymise(table, found, order_by=position, key=key)
    elif isinstance(vault, Vault):
        kinds = {one.colonne: one.type_pii for one in found}
        mapping = written(vault.extend(table, kinds, order_by=position, key=key), "jetons")
        masked = privacy.mask(table, mapping, found, key=key)
    else:  # the longer vault is written to a place of its own
        kinds = {one.colonne: one.type_pii for one in found}
        extended = written(privacy.extend_vault(vault, table, kinds, order_by=position, key=key), "coffre")
        mapping = written(privacy.vault_mapping(extended, table, kinds, key=key), "jetons")
        masked = privacy.mask(table, mapping, found, key=key)
        sinks.write_table(extended, f"{store.folder}/coffre/{file_id}-v{version}.parquet")

    path = store.masked(file_id, version, lot, kind)
    sinks.write_table(masked.drop(position), path)
    tokens = registry.write_mapping(mapping, file_id, store.mappings, lot)
    again = loader.load(spark, path, with_position=True)
    profiled, _ = examine(again, order_by=again.columns[-1])
    new = registry.entry(
        workspace=row["workspace_id"], path=path, size=row["size_bytes"], profile=profiled["profile"],
        score=profiled["score"], status=fixed.PII_MASKED, version=version, file_id=file_id, name=row["name"],
    )
    if not registry.commit(spark, store.registry, new, lot):
        for mine in (path, tokens):
            files.remove(spark, mine)
        raise loader.Refused("Un autre masquage de ce fichier a été enregistré entre-temps.")
    summary = privacy.masking_summary(mapping).collect()  # one row per masked column
    audited = privacy.leak_audit(again.drop(again.columns[-1]), mapping, key=key).head()
    return {
        **new,
        "colonnes_masquees": [one.colonne for one in found],
        "valeurs_masquees": sum(line["valeurs_masquees"] for line in summary),
        "fuites": audited["fuites"],
    }


def audit(spark: SparkSession, store: Store, file_id: str, table: DataFrame, *, key: str | None = None) -> DataFrame:
    """One row (valeurs_verifiees, fuites): originals of a masked dataset, by its stored tokens, that a table still holds."""
    kept = store.tokens(spark).where(F.col("file_id") == file_id).select(
        F.col("column_name").alias("colonne"), F.col("original_hash").alias("empreinte"), F.col("token").alias("jeton"),
        F.col("n_words").alias("mots"), F.col("words_hash").alias("empreinte_mots"),
    )
    return privacy.leak_audit(table, kept, key=key)


def refresh(spark: SparkSession, store: Store, file_id: str) -> dict:
    """Profile a registered dataset anew after files were added to it; returns the new registry row.

    The state of the profile is kept with each refresh, in the store's folder ``etats``, and the next one reads the files that came
    since and adds them. Everything is read again if there is no state yet, if a file was changed or taken away, or if the new
    files turn a column of numbers into one of text or the reverse. ``fichiers_lus`` tells how many files were read.
    The state holds values of the table, as the table itself does: keep the store where the table may be kept.
    """
    row = registry.find(registry.versions(spark, store.registry, file_id), file_id)
    path, kept = row["path"], registry.state_of(spark, store.registry, file_id)
    now = written(loader.list_files(spark, path).where("length > 0"), "fichiers")
    before = f"{store.folder}/etats/{kept}" if kept else None
    grown = _grown(spark, path, before, now) if before else None
    if grown is None:
        table, told = loader.load_with_verdicts(spark, path)
        whole, read = state.of(table, table.columns[-1]), now.count()
    else:
        whole, told, read = grown
    lot = f"e-{uuid.uuid4().hex}"
    after = f"{store.folder}/etats/{lot}"
    whole.write(after)
    now.write.parquet(f"{after}/fichiers")
    if not files.create_new(spark, f"{after}/verdicts.json", json.dumps(told, ensure_ascii=False)):
        raise FileExistsError(after)
    columns = spark.createDataFrame([], told["schema"])
    measures = state.measures(state.read(spark, after, columns), lambda: loader.load(spark, path))
    profiled, found = _told(measures)
    new = registry.entry(
        workspace=row["workspace_id"], path=path, size=now.agg(F.sum("length")).head()[0], profile=profiled["profile"], score=profiled["score"],
        status=row["pii_status"] if row["pii_status"] == fixed.PII_MASKED else fixed.PII_FOUND if found else fixed.PII_NONE,
        version=row["version"] + 1, file_id=file_id, name=row["name"],
    )
    if not registry.commit(spark, store.registry, new, etat=lot):
        files.remove(spark, after)
        raise loader.Refused("Une autre version de ce fichier a été enregistrée entre-temps.")
    return {**new, "fichiers_lus": read}


def _grown(spark: SparkSession, path: str, before: str, now: DataFrame) -> tuple[state.State, dict, int] | None:
    """The kept state with the files that came since, the verdicts on its columns, and how many files came; none if it cannot be grown."""
    old = spark.read.parquet(f"{before}/fichiers")
    if not old.join(now, old.columns, "left_anti").isEmpty():
        return None
    fresh = [line["path"] for line in now.join(old, old.columns, "left_anti").select("path").collect()]  # one path for each new file
    told = json.loads("".join(line[0] for line in spark.read.text(f"{before}/verdicts.json").collect()))
    columns = spark.createDataFrame([], told["schema"])
    kept = state.read(spark, before, columns)
    if not fresh:
        return kept, told, 0
    added = loader.load_more(spark, path, fresh, told)
    if added is None:
        return None
    table, told = added
    return kept.merged(state.of(table, table.columns[-1])), told, len(fresh)
