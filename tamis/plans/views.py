"""Two untidy views derived from the provided tables, in Spark and in SQL.

The provided tables are clean.  Defects are put in by deterministic expressions on the keys, over
the whole tables, so that they grow with the data: missing cells, duplicated rows, mixed date
shapes, spelling variants, outliers, negative amounts, orphan keys, personal data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE_LAYOUTS = {"ISO": ("yyyy-MM-dd", "%Y-%m-%d"), "SLASH": ("dd/MM/yyyy", "%d/%m/%Y"), "DASH": ("dd-MM-yyyy", "%d-%m-%Y")}
NAMES = ("Élodie", "MARTIN", "Lucas", "fatima", "Nguyen")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _staff_fields(text: str) -> list[str]:
    """Expressions of the staff view; ``text`` is the SQL type of character strings."""
    key = f"CAST(c_custkey AS {text})"
    first = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(NAMES))
    return [
        "c_custkey AS cle",
        f"concat('C', lpad({key}, 9, '0')) AS id",
        f"concat('user', CAST(c_custkey % 700 AS {text}), '@mail.example') AS email",
        f"""CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 = 0
            THEN concat('+336', lpad({key}, 8, '0')) ELSE concat('06', lpad({key}, 8, '0')) END AS tel""",
        f"CASE c_custkey % 5 {first} END AS prenom",
        f"lpad(CAST(c_custkey * 7919 AS {text}), 13, '0') AS nir",
        f"concat('FR76', lpad(CAST(c_custkey * 104729 AS {text}), 23, '0')) AS iban",
        """CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment)
           WHEN 2 THEN concat(' ', c_mktsegment, ' ') ELSE c_mktsegment END AS service""",
        """CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 181 = 0 THEN c_acctbal * 10
           ELSE c_acctbal END AS salaire""",
        "c_nationkey AS anciennete",
        "CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END AS a_quitte",
        "'FR' AS pays",
        f"CASE WHEN c_custkey % 10 = 0 THEN concat('note ', {key}) END AS commentaire",
    ]


def _sales_fields(text: str, dated: dict[str, str]) -> list[str]:
    key = f"CAST(o_orderkey AS {text})"
    return [
        "o_orderkey AS ordre",
        f"concat('T', lpad({key}, 10, '0')) AS id_vente",
        "CASE WHEN o_orderkey % 200 = 0 THEN CAST(-1 AS BIGINT) ELSE o_custkey END AS cle",
        f"""CASE WHEN o_orderkey % 10 < 2 THEN {dated['SLASH']} WHEN o_orderkey % 10 = 2 THEN {dated['DASH']}
            ELSE {dated['ISO']} END AS date_vente""",
        f"concat('Client ', CAST(o_orderkey % 8 AS {text})) AS client",
        "CASE WHEN o_orderkey % 375 = 0 THEN -o_totalprice ELSE o_totalprice END AS montant",
        "o_orderstatus AS statut",
    ]


STAFF_COLUMNS = (
    "cle", "id", "email", "tel", "prenom", "nir", "iban", "service", "salaire", "anciennete", "a_quitte",
    "pays", "commentaire",
)
SALES_COLUMNS = ("ordre", "id_vente", "cle", "date_vente", "client", "montant", "statut")


def staff(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").selectExpr(*_staff_fields("STRING"))


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales, with every 500th row written twice."""
    dated = {name: f"date_format(o_orderdate, '{layout}')" for name, (layout, _) in DATE_LAYOUTS.items()}
    once = read(spark, folder, "orders").selectExpr(*_sales_fields("STRING", dated))
    return once.unionByName(once.where(F.col("ordre") % 500 == 0))


def staff_sql() -> str:
    return f"staff AS (SELECT {', '.join(_staff_fields('VARCHAR'))} FROM customer)"


def sales_sql() -> str:
    dated = {name: f"strftime(o_orderdate, '{layout}')" for name, (_, layout) in DATE_LAYOUTS.items()}
    once = f"SELECT {', '.join(_sales_fields('VARCHAR', dated))} FROM orders"
    return f"once AS ({once}), sales AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE ordre % 500 = 0)"
