"""A token vault that several writers extend at a time.

A folder ``journal`` holds numbered files, each made by one writer only. A writer first leases a block of ranks for each kind of
personal data, then writes its new tokens to a place of their own, and last commits that place. Ranks of different writers never
meet, since leases follow each other in the journal. If two writers bring the same value, the one committed first keeps its token for good
and the other's is never shown.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import text
from tamis.operators import privacy
from tamis.operators.local import local_table
from tamis.session import written
from tamis.sources import files

_ENTRY = "numero bigint, lot string, baux map<string, bigint>"


@dataclass(frozen=True)
class Extension:
    """New tokens that are written but not committed."""

    vault: Vault
    lot: str

    def commit(self, spark: SparkSession) -> None:
        self.vault._add(spark, lambda: {"lot": self.lot})


@dataclass(frozen=True)
class Vault:
    """Where a vault lives: a folder every executor can reach."""

    folder: str

    def _entries(self, spark: SparkSession) -> DataFrame:
        if not files.names(spark, f"{self.folder}/journal"):
            return local_table(spark, [], _ENTRY)
        return spark.read.schema(_ENTRY).json(f"{self.folder}/journal/*.json")

    def _add(self, spark: SparkSession, entry) -> dict:
        """Add the entry that ``entry()`` makes from the journal's state, anew whenever another writer was faster."""
        while True:
            known = files.names(spark, f"{self.folder}/journal")
            number = int(known[-1].split(".")[0]) + 1 if known else 1
            told = {"numero": number, **entry()}
            if files.create_new(spark, f"{self.folder}/journal/{number:019d}.json", json.dumps(told)):
                return told

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows (type_pii, empreinte, rang, jeton) of all committed extensions: of each value the token committed first."""
        committed = self._entries(spark).where(F.col("lot").isNotNull()).select("lot", "numero")
        if committed.isEmpty():
            return local_table(spark, [], privacy.VAULT_SCHEMA)
        rows = spark.read.schema(privacy.VAULT_SCHEMA + ", lot string").parquet(f"{self.folder}/valeurs")
        first = Window.partitionBy("type_pii", "empreinte").orderBy("numero")
        ranked = rows.join(committed, "lot").withColumn("_ordre", F.row_number().over(first))
        return ranked.where("_ordre = 1").select("type_pii", "empreinte", "rang", "jeton")

    def _lease(self, spark: SparkSession, sizes: dict[str, int]) -> dict[str, int]:
        """The first rank of a block of so many for each kind, which no other writer gets."""
        starts: dict[str, int] = {}

        def entry() -> dict:
            leased = self._entries(spark).select(F.explode("baux").alias("type_pii", "rangs")).groupBy("type_pii").agg(F.sum("rangs"))
            starts.update(dict.fromkeys(sizes, 1) | {row[0]: row[1] + 1 for row in leased.collect()})  # a row for each kind
            return {"baux": sizes}

        self._add(spark, entry)
        return starts

    def prepare(
        self, df: DataFrame, columns: Mapping[str, str], *, order_by: str | None = None, key: str | None = None
    ) -> Extension | None:
        """Number the values of a table that the vault lacks, by first appearance, and write them; none if there are none.

        ``columns`` maps column names to kinds of personal data.
        """
        spark = df.sparkSession
        # Numbered from 1 as if the vault were empty, then moved to the leased ranks. Fingerprints only, never values.
        known = self.read(spark).select("type_pii", "empreinte", F.lit(0).cast("bigint").alias("rang"), F.lit("").alias("jeton"))
        new = written(privacy.extend_vault(known, df, columns, order_by=order_by, key=key).where("rang > 0"), "nouveaux")
        sizes = {row["type_pii"]: row["count"] for row in new.groupBy("type_pii").count().collect()}
        if not sizes:
            return None
        starts = self._lease(spark, sizes)
        lot = f"l-{uuid.uuid4().hex}"
        base = F.coalesce(*[F.when(F.col("type_pii") == kind, F.lit(starts[kind] - 1)) for kind in sizes])
        moved = new.withColumn("rang", F.col("rang") + base)
        moved.withColumn("jeton", text.token(F.col("type_pii"), F.col("rang"))).write.parquet(f"{self.folder}/valeurs/lot={lot}")
        return Extension(self, lot)

    def extend(
        self, df: DataFrame, columns: Mapping[str, str], *, order_by: str | None = None, key: str | None = None
    ) -> DataFrame:
        """Add a table's values, and give its tokens in the form ``privacy.mask`` takes."""
        extension = self.prepare(df, columns, order_by=order_by, key=key)
        if extension:
            extension.commit(df.sparkSession)
        return privacy.vault_mapping(self.read(df.sparkSession), df, columns, key=key)
