"""The registered queries: each operator over the provided tables, with its SQL statement."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import intake
from tamis.functions import fixed, text
from tamis.operators import cleaning, crosscheck, metering, privacy, quantiles, quality, replay
from tamis.operators.columns import columns_of, melt
from tamis.operators.duplicates import duplicate_rows
from tamis.operators.local import local_table
from tamis.operators.profile import (
    EVERYTHING, column_profiles, context, first_examples, measure, profile, profile_from,
)
from tamis.plans import statements as sql
from tamis.plans import views
from tamis.session import shared_folder, written
from tamis.sources import loader, registry, sinks
from tamis.streaming.intake import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if statement:
            STATEMENTS[name] = statement
        return build

    return keep


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tamis-{label}-{uuid.uuid4().hex}"


# --- Scans and ingestion ------------------------------------------------------------------


def _sales_as_text(spark: SparkSession, folder: str) -> DataFrame:
    comma = F.translate(F.col("montant").cast("string"), ".", ",")
    return views.sales(spark, folder).select(
        F.col("ordre").cast("string").alias("ordre"), "id_vente", F.col("cle").cast("string").alias("cle"),
        comma.alias("montant"), F.lpad(F.col("ordre").cast("string"), 12, "0").alias("code"),
        F.when(F.col("ordre") % 7 == 0, F.lit("A12")).otherwise(F.col("ordre").cast("string")).alias("mixte"),
    )


@query("csv_promote_numeric", sql.over([sql.sales_sql()], """
    SELECT ordre, id_vente, cle, montant, lpad(CAST(ordre AS VARCHAR), 12, '0') AS code,
      CASE WHEN ordre % 7 = 0 THEN 'A12' ELSE CAST(ordre AS VARCHAR) END AS mixte FROM sales"""))
def csv_promote_numeric(spark, folder):
    return loader.promote(_sales_as_text(spark, folder))


@query("promotion_types", """
    SELECT * FROM (VALUES ('ordre', 'bigint'), ('id_vente', 'string'), ('cle', 'bigint'), ('montant', 'double'),
      ('code', 'string'), ('mixte', 'string')) AS t(colonne, type)""")
def promotion_types(spark, folder):
    table = loader.promote(_sales_as_text(spark, folder))
    rows = [{"colonne": field.name, "type": field.dataType.simpleString()} for field in table.schema.fields]
    return local_table(spark, rows, "colonne string, type string")


@query("ingest_csv_roundtrip", sql.over([sql.staff_sql()], f"SELECT {', '.join(views.STAFF_COLUMNS)} FROM staff"))
def ingest_csv_roundtrip(spark, folder):
    path = f"{_new_folder(spark, 'aller-retour')}/table.csv"
    return loader.load(spark, sinks.write_table(views.staff(spark, folder), path, separator=";"))


@query("intake_stream", "SELECT 'csv' AS format, 'detectee' AS pii_status, count(*) AS nb_lignes FROM customer")
def intake_stream(spark, folder):
    drop, store = f"{_new_folder(spark, 'depot')}/entrees.csv", intake.Store(_new_folder(spark, "registre"))
    sinks.write_table(views.staff(spark, folder).repartition(2, "cle"), drop)
    watch(spark, drop, store, "w1").awaitTermination()
    rows = registry.current(registry.read(spark, store.registry))
    return rows.groupBy("format", "pii_status").agg(
        F.sum(F.get_json_object("profile", "$.nb_lignes").cast("bigint")).alias("nb_lignes")
    )


# --- Measures -----------------------------------------------------------------------------

_COUNTS = ("nom", "valeurs_manquantes", "part_manquantes", "cardinalite")


@query("profile_counts", sql.profile_statement(
    f"SELECT {', '.join(_COUNTS)} FROM prof", "staff", *sql.STAFF_SPEC))
def profile_counts(spark, folder):
    return column_profiles(measure(views.staff(spark, folder), wanted=())).select(*_COUNTS)


_STATISTICS = ("minimum", "maximum", "moyenne", "mediane", "ecart_type")


_NUMBERS = [("lineitem", name) for name, kind in sql.LINEITEM.items() if kind == sql.NUMBER] + [("orders", name) for name in sql.ORDERS_NUMBERS]


@query("profile_numeric_stats", f"""
    WITH m AS ({" UNION ALL ".join(f"SELECT '{name}' AS nom, CAST({name} AS DOUBLE) AS d FROM {table}" for table, name in _NUMBERS)})
    SELECT nom, round(min(d), 2) AS minimum, round(max(d), 2) AS maximum, round(avg(d), 2) AS moyenne,
      round(quantile_cont(d, 0.5), 2) AS mediane, round(stddev_pop(d), 2) AS ecart_type FROM m GROUP BY nom""")
def profile_numeric_stats(spark, folder):
    """All numbers of two whole tables."""
    return _stack([
        measure(views.read(spark, folder, table), wanted=("statistics",)).where("c >= 0 and minimum is not null").select(
            "nom", *[F.round(source, 2).alias(name) for name, source in
                     zip(_STATISTICS, ("minimum", "maximum", "moyenne", "q50", "ecart_type"))])
        for table in ("lineitem", "orders")
    ])


@query("profile_top_values", """
    WITH m AS (SELECT 'event_type' AS nom, event_type AS v FROM events UNION ALL
      SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'lang', lang FROM documents),
    f AS (SELECT nom, v, count(*) AS k FROM m GROUP BY nom, v)
    SELECT nom, row_number() OVER (PARTITION BY nom ORDER BY k DESC, v) AS rang, v AS valeur, k AS occurrences
    FROM f QUALIFY rang <= 5""")
def profile_top_values(spark, folder):
    frames = []
    for name, column in (("events", "event_type"), ("customer", "c_mktsegment"), ("documents", "lang")):
        measures = measure(views.read(spark, folder, name).select(column), wanted=("top_values",))
        frames.append(measures.where("c >= 0").select("nom", F.posexplode("modalites").alias("p", "m")))
    return _stack(frames).select(
        "nom", (F.col("p") + 1).cast("bigint").alias("rang"), F.col("m.valeur"), F.col("m.occurrences"))


@query("profile_examples", f"""
    SELECT 'text' AS colonne, row_number() OVER (ORDER BY doc_id) AS rang, {sql.shown('text')} AS exemple
    FROM documents QUALIFY rang <= 3
    UNION ALL SELECT 'lang', row_number() OVER (ORDER BY doc_id) AS rang, lang FROM documents QUALIFY rang <= 3""")
def profile_examples(spark, folder):
    documents = views.read(spark, folder, "documents").select("doc_id", "text", "lang")
    refs = columns_of(documents, ["doc_id"])
    found = first_examples(documents, refs, ["doc_id"])
    rows = [
        {"colonne": ref.name, "rang": i + 1, "exemple": value}
        for ref in refs for i, value in enumerate(found[ref.index])
    ]
    return local_table(spark, rows, "colonne string, rang bigint, exemple string")


@query("duplicate_rows", sql.over([sql.sales_sql()], """
    SELECT 'sales' AS nom, count(*) AS nb_lignes, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS doublons
    FROM sales UNION ALL
    SELECT 'lineitem', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem UNION ALL
    SELECT 'parts', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem)) FROM lineitem UNION ALL
    SELECT 'textes', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) FROM documents UNION ALL
    SELECT 'documents', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) FROM documents UNION ALL
    SELECT 'zeros', count(*), count(*) - (SELECT count(DISTINCT l_quantity * (l_partkey % 2)) FROM lineitem) FROM lineitem"""))
def duplicates(spark, folder):
    tables = {
        "sales": views.sales(spark, folder),
        "lineitem": views.read(spark, folder, "lineitem"),
        "parts": views.read(spark, folder, "lineitem").select("l_partkey", "l_quantity"),
        "textes": views.read(spark, folder, "documents").select("text", "lang"),
        "documents": views.read(spark, folder, "documents"),
        # Seventeen columns of reals in which zero has either sign.
        "zeros": views.read(spark, folder, "lineitem").select(*[
            (F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0) * 0 + F.col("l_quantity") * (F.col("l_partkey") % 2)
             * F.when((F.col("l_partkey") % 2 == 0) & (F.col("l_linenumber") % 2 == 0), -1.0).otherwise(1.0)).alias(f"x{i}")
            for i in range(17)
        ]),
    }
    return _stack([duplicate_rows(df).withColumn("nom", F.lit(name)) for name, df in tables.items()])


@query("semantic_types", sql.per_table(
    lambda name, *spec: sql.profile_statement("SELECT {name} AS jeu, nom, type FROM prof", name, *spec),
    {**sql.BOTH, "events": sql.EVENTS_SPEC, "lineitem": sql.LINEITEM_SPEC}))
def semantic_types(spark, folder):
    tables = {
        "staff": views.staff(spark, folder), "sales": views.sales(spark, folder),
        "events": views.read(spark, folder, "events"), "lineitem": views.read(spark, folder, "lineitem"),
    }
    return _stack([
        column_profiles(measure(df, wanted=())).select(F.lit(name).alias("jeu"), "nom", "type")
        for name, df in tables.items()
    ])


@query("iqr_outliers", sql.over([
    sql.staff_sql(),
    """m AS (SELECT 'salaire' AS nom, salaire AS d FROM staff UNION ALL
      SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders)""",
    """q AS (SELECT nom, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3
      FROM m GROUP BY nom)""",
], """
    SELECT m.nom, round(any_value(q1), 4) AS q25, round(any_value(q2), 4) AS q50, round(any_value(q3), 4) AS q75,
      count(*) FILTER (d < q1 - 1.5 * (q3 - q1) OR d > q3 + 1.5 * (q3 - q1)) AS extremes
    FROM m JOIN q ON m.nom = q.nom GROUP BY m.nom"""))
def iqr_outliers(spark, folder):
    frames = []
    for df in (
        views.staff(spark, folder).select("salaire"),
        views.read(spark, folder, "lineitem").select("l_extendedprice"),
        views.read(spark, folder, "orders").select("o_totalprice"),
    ):
        refs = columns_of(df)
        numbers = melt(df, refs, lambda ref: ref.number)
        quartiles = quantiles.quartiles(numbers, quantiles.sketches(numbers).collect())
        beyond = quantiles.outlier_counts(numbers, quartiles)
        values = {f"q{p}": F.lit(quartiles[0][f"q{p}"]) for p in (25, 50, 75)}
        frames.append(beyond.select(
            F.lit(refs[0].name).alias("nom"), *[F.round(v, 4).alias(k) for k, v in values.items()], "extremes"))
    return _stack(frames)


_FLAT = (
    "nom", "type", "valeurs_manquantes", "part_manquantes", "cardinalite", "exemples", *_STATISTICS,
    "modalites", "anomalie",
)


def flat(columns: DataFrame, *kept: str) -> DataFrame:
    """Column profiles with their lists written out, one row per column."""
    one = F.get("anomalies", F.lit(0))
    listed = F.transform(
        F.col("statistiques.modalites_frequentes"),
        lambda m: F.concat(m["valeur"], F.lit(" × "), m["occurrences"].cast("string")),
    )
    return columns.select(
        *kept, "nom", "type", "valeurs_manquantes", "part_manquantes", "cardinalite",
        F.array_join("exemples", " | ").alias("exemples"),
        *[F.col(f"statistiques.{name}").alias(name) for name in _STATISTICS],
        F.array_join(listed, " | ").alias("modalites"),
        F.concat(one["type"], F.lit(": "), one["detail"]).alias("anomalie"),
    )


@query("quartiles_narrowed", """
    WITH m AS (SELECT 'l_extendedprice' AS nom, l_extendedprice AS d FROM lineitem UNION ALL
      SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
    SELECT nom, round(quantile_cont(d, 0.25), 4) AS q25, round(quantile_cont(d, 0.5), 4) AS q50,
      round(quantile_cont(d, 0.75), 4) AS q75 FROM m GROUP BY nom""")
def quartiles_narrowed(spark, folder):
    """The way of large columns: brackets, counts around them, slices."""
    lines = views.read(spark, folder, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    refs = columns_of(lines)
    numbers = melt(lines, refs, lambda ref: ref.number)
    found = quantiles.quartiles(numbers, quantiles.sketches(numbers).collect(), small=0)
    rows = [{"nom": refs[row["c"]].name, **{f"q{p}": round(row[f"q{p}"], 4) for p in (25, 50, 75)}} for row in found]
    return local_table(spark, rows, "nom string, q25 double, q50 double, q75 double")


@query("profile_unheld", sql.profile_statement(
    f"SELECT {', '.join(_FLAT)} FROM prof", "sales", *sql.SALES_SPEC))
def profile_unheld(spark, folder):
    """The profile of a table too large to be kept in memory between the passes."""
    measures = measure(views.sales(spark, folder), order_by=["ordre"], hold=False)
    return flat(column_profiles(measures)).select(*_FLAT)


@query("modality_variants", sql.over([sql.staff_sql()], """
    SELECT 'service' AS nom, count(DISTINCT service) AS graphies, count(DISTINCT lower(trim(service))) AS formes,
      count(DISTINCT service) - count(DISTINCT lower(trim(service))) AS variantes FROM staff"""))
def modality_variants(spark, folder):
    measures = measure(views.staff(spark, folder).select("service"), wanted=())
    return measures.where("c >= 0").select(
        "nom", F.col("distinctes").alias("graphies"), F.col("sans_casse").alias("formes"),
        (F.col("distinctes") - F.col("sans_casse")).alias("variantes"))


@query("date_shapes", sql.over([sql.sales_sql()], f"""
    SELECT {sql.shape('date_vente')} AS forme, count(*) AS occurrences FROM sales GROUP BY 1"""))
def date_shapes(spark, folder):
    shape = text.date_shape(text.strip(F.col("date_vente")))
    return views.sales(spark, folder).groupBy(shape.alias("forme")).agg(F.count(F.lit(1)).alias("occurrences"))


# --- Profiles -----------------------------------------------------------------------------

@query("anomalies", sql.per_table(
    lambda name, *spec: sql.profile_statement(
        "SELECT {name} AS jeu, nom, anomalie FROM prof WHERE anomalie IS NOT NULL", name, *spec), sql.BOTH))
def anomalies(spark, folder):
    return _stack([
        flat(column_profiles(measure(df, wanted=("statistics", "outliers"))))
        .where("anomalie IS NOT NULL").select(F.lit(name).alias("jeu"), "nom", "anomalie")
        for name, df in _both(spark, folder).items()
    ])


def _both(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"staff": views.staff(spark, folder), "sales": views.sales(spark, folder)}


@query("quality_score", sql.per_table(
    lambda name, *spec: sql.profile_statement(
        """SELECT {name} AS jeu, nb AS nb_lignes, nb - di AS nb_doublons, score AS score_qualite,
             CASE WHEN score >= 90 THEN 'Bonne qualité' WHEN score >= 70 THEN 'À surveiller' ELSE 'Qualité faible' END AS bande,
             raisons FROM note, dup""", name, *spec, score=True), sql.BOTH))
def quality_score(spark, folder):
    reason = lambda p: F.concat(
        p["critere"], F.lit(" ("), F.format_string("%.1f", p["impact"]), F.lit(") : "), p["detail"])
    return _stack([
        profile_from(measure(df, wanted=("duplicates", "statistics", "outliers"))).select(
            F.lit(name).alias("jeu"), "nb_lignes", F.col("doublons.nombre").alias("nb_doublons"), "score_qualite",
            quality.band(F.col("score_qualite")).alias("bande"),
            F.array_join(F.transform("explication_qualite", reason), " | ").alias("raisons"))
        for name, df in _both(spark, folder).items()
    ])


@query("profile_full", sql.profile_statement(
    f"SELECT {', '.join(_FLAT)}, nb AS nb_lignes, nb - di AS nb_doublons, score AS score_qualite FROM prof, note, dup",
    "sales", *sql.SALES_SPEC, score=True))
def profile_full(spark, folder):
    whole = profile(views.sales(spark, folder), order_by=["ordre"])
    columns = whole.select("nb_lignes", F.col("doublons.nombre").alias("nb_doublons"), "score_qualite", F.inline("colonnes"))
    return flat(columns, "nb_lignes", "nb_doublons", "score_qualite").select(
        *_FLAT, "nb_lignes", "nb_doublons", "score_qualite")


_GROWN = [name for name in _FLAT if name != "exemples"]  # which come first depends on the names of files
_STORED = """nb_lignes bigint, doublons struct<nombre:bigint>, score_qualite double, colonnes array<struct<nom:string, type:string,
    valeurs_manquantes:bigint, part_manquantes:double, cardinalite:bigint, exemples:array<string>,
    statistiques:struct<minimum:double, maximum:double, moyenne:double, mediane:double, ecart_type:double,
    modalites_frequentes:array<struct<valeur:string, occurrences:bigint>>>, anomalies:array<struct<type:string, detail:string>>>>"""


@query("profile_refresh", sql.profile_statement(
    f"SELECT {', '.join(_GROWN)}, nb AS nb_lignes, nb - di AS nb_doublons, score AS score_qualite, 1 AS fichiers_lus FROM prof, note, dup",
    "sales", *sql.SALES_SPEC, score=True))
def profile_refresh(spark, folder):
    """A table profiled, grown by a file, and profiled again from its kept state and that file."""
    path, store = f"{_new_folder(spark, 'ventes')}/ventes.parquet", intake.Store(_new_folder(spark, "registre"))
    sales = views.sales(spark, folder)
    sales.where("ordre % 3 > 0").write.parquet(path)
    row = intake.register(spark, store, "w1", path)
    intake.refresh(spark, store, row["id"])
    sales.where("ordre % 3 = 0").coalesce(1).write.mode("append").parquet(path)
    grown = intake.refresh(spark, store, row["id"])
    last = registry.read(spark, store.registry).where(F.col("version") == grown["version"])
    stored = last.select(F.from_json("profile", _STORED).alias("p")).select(
        "p.nb_lignes", F.col("p.doublons.nombre").alias("nb_doublons"), "p.score_qualite", F.lit(grown["fichiers_lus"]).alias("fichiers_lus"), F.inline("p.colonnes"))
    beside = ("nb_lignes", "nb_doublons", "score_qualite", "fichiers_lus")
    return flat(stored, *beside).select(*_GROWN, *beside)


@query("compact_context", sql.profile_statement(
    """SELECT (SELECT count(*) FROM staff) AS nb_lignes, nom, type, cardinalite, part_manquantes, exemples,
         minimum, maximum, moyenne, mediane, ecart_type, modalites FROM prof""", "staff", *sql.STAFF_SPEC))
def compact_context(spark, folder):
    compact = context(profile(views.staff(spark, folder), order_by=["cle"]))
    columns = compact.select("nb_lignes", F.inline("colonnes")).withColumns({
        "valeurs_manquantes": F.lit(0), "anomalies": F.array().cast("array<struct<type:string,detail:string>>")})
    return flat(columns, "nb_lignes").drop("valeurs_manquantes", "anomalie")


_LONG = {"text": sql.TEXT, "lang": sql.TEXT, "source": sql.TEXT, "n_chars": sql.NUMBER}


@query("profile_long_texts", sql.profile_statement(
    f"SELECT {', '.join(_FLAT)} FROM prof", "documents", [], "documents", _LONG, "doc_id"))
def profile_long_texts(spark, folder):
    documents = views.read(spark, folder, "documents").select("doc_id", *_LONG)
    measures = measure(documents, order_by=["doc_id"], exclude=["doc_id"], wanted=EVERYTHING)
    return flat(column_profiles(measures)).select(*_FLAT)


_DECIMALS = {"cle": sql.NUMBER, "prix": sql.NUMBER, "solde": sql.NUMBER, "drapeau": sql.NUMBER}
_DECIMAL_COLUMNS = """CAST(o_orderkey AS DECIMAL(15,0)) AS cle, CAST(o_totalprice AS DECIMAL(15,2)) AS prix,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_totalprice END AS DECIMAL(15,2)) AS solde,
  CAST(o_orderkey % 2 AS DECIMAL(5,2)) AS drapeau"""


@query("profile_decimals", sql.profile_statement(
    "SELECT nom, type, valeurs_manquantes, cardinalite, minimum, maximum, moyenne, mediane, ecart_type, modalites, anomalie FROM prof",
    "exacts", [f"exacts AS (SELECT {_DECIMAL_COLUMNS} FROM orders)"], "exacts", _DECIMALS, "cle"))
def profile_decimals(spark, folder):
    exact = views.read(spark, folder, "orders").selectExpr(*_split_columns(_DECIMAL_COLUMNS))
    return flat(column_profiles(measure(exact, wanted=("top_values", "statistics", "outliers")))).select(
        "nom", "type", "valeurs_manquantes", "cardinalite", *_STATISTICS, "modalites", "anomalie")


def _split_columns(text: str) -> list[str]:
    """The column expressions of a select list, cut at commas outside parentheses."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


# --- Personal data ------------------------------------------------------------------------


@query("pii_detect_decimals", """
    SELECT 'nir' AS colonne, 'numéro de sécurité sociale' AS type_pii,
      round(count(*) FILTER (length(CAST(n AS VARCHAR)) BETWEEN 13 AND 15) / count(n), 3) AS confiance, 'NIR_001' AS exemple_masque
    FROM (SELECT CAST(1000000000000 + c_custkey * 7919 AS DECIMAL(15,0)) AS n FROM customer)""")
def pii_detect_decimals(spark, folder):
    customers = views.read(spark, folder, "customer").selectExpr(
        "CAST(1000000000000 + c_custkey * 7919 AS DECIMAL(15,0)) AS nir", "CAST(c_acctbal AS DECIMAL(15,2)) AS solde")
    return privacy.detect(customers)


@query("csv_headers", """
    SELECT o_orderkey AS ordre, o_orderstatus AS "statut", concat('s', o_orderstatus) AS "Statut.1", o_totalprice AS montant FROM orders""")
def csv_headers(spark, folder):
    """Files with their columns in different orders, and names that differ in case alone."""
    path = f"{_new_folder(spark, 'entetes')}/table.csv"
    rows = views.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b"), F.concat(F.lit("s"), "o_orderstatus").alias("c"), F.col("o_totalprice").alias("d"))
    lines = {
        "ordre,statut,Statut,montant": rows.where("a % 2 = 0").select(F.concat_ws(",", "a", "b", "c", "d").alias("value")),
        "montant,ordre,statut,Statut": rows.where("a % 2 <> 0").select(F.concat_ws(",", "d", "a", "b", "c").alias("value")),
    }
    for header, body in lines.items():  # each part file gets a header, as a CSV writer gives it
        named = body.withColumnRenamed("value", header)
        named.write.mode("append").option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(path)
    return loader.load(spark, path)


@query("pii_vault_masked_table", sql.over([sql.staff_sql(), """
    v AS (SELECT email AS x, min(CASE WHEN cle % 3 = 0 THEN 0 ELSE 1 END) AS lot,
        min(CASE WHEN cle % 3 = 0 THEN cle END) AS p0, min(cle) AS p1 FROM staff GROUP BY email),
    r AS (SELECT x, row_number() OVER (ORDER BY lot, CASE WHEN lot = 0 THEN p0 ELSE p1 END) AS rang FROM v)
    """], """SELECT staff.* REPLACE (printf('email_%03d@masked.local', rang) AS email) FROM staff LEFT JOIN r ON email = x"""))
def pii_vault_masked_table(spark, folder):
    """Two halves masked one after the other with one vault; the row order is text."""
    staff = views.staff(spark, folder).withColumn("ordre", F.lpad(F.col("cle").cast("string"), 12, "0"))
    kinds, vault, parts = {"email": fixed.EMAIL}, None, []
    for half in (staff.where(F.col("cle") % 3 == 0), staff.where(F.col("cle") % 3 != 0)):
        vault = written(privacy.extend_vault(vault, half, kinds, order_by="ordre"), "coffre")
        mapping = written(privacy.vault_mapping(vault, half, kinds), "jetons")
        parts.append(privacy.mask(half, mapping, [privacy.Detection("email", fixed.EMAIL, 1.0, "")]))
    return _stack(parts).drop("ordre")


_DETECTED = {
    "staff": sql.STAFF_SPEC, "sales": sql.SALES_SPEC, "events": sql.EVENTS_SPEC,
    "documents": ([], "documents", {"doc_id": sql.NUMBER, "text": sql.TEXT, "lang": sql.TEXT, "source": sql.TEXT, "n_chars": sql.NUMBER}, "doc_id"),
}


@query("pii_detect", sql.per_table(
    lambda name, ctes, table, columns, order: sql.over(
        [*ctes, sql.detections(sql.melted(table, columns, order))],
        f"SELECT '{name}' AS jeu, nom AS colonne, type_pii, confiance, exemple_masque FROM det WHERE type_pii IS NOT NULL"),
    _DETECTED))
def pii_detect(spark, folder):
    tables = {
        **_both(spark, folder), "events": views.read(spark, folder, "events"),
        "documents": views.read(spark, folder, "documents"),
    }
    return _stack([privacy.detect(df).select(F.lit(name).alias("jeu"), "*") for name, df in tables.items()])


def _staff_and_detections(spark: SparkSession, folder: str):
    staff = views.staff(spark, folder)
    return staff, privacy.detections(privacy.detect(staff))


@query("pii_tokens", sql.over([sql.staff_sql(), sql.token_ctes()], "SELECT colonne, empreinte, jeton FROM jet"))
def pii_tokens(spark, folder):
    staff, found = _staff_and_detections(spark, folder)
    return privacy.tokens(staff, found, order_by="cle").select("colonne", "empreinte", "jeton")


_MASKED = ", ".join(
    f"(SELECT jeton FROM jet WHERE colonne = '{name}' AND v = {name}) AS {name}" if name in sql.PERSONAL else name
    for name in views.STAFF_COLUMNS
)


@query("pii_masked_table", sql.over([sql.staff_sql(), sql.token_ctes()], f"SELECT {_MASKED} FROM staff"))
def pii_masked_table(spark, folder):
    staff, found = _staff_and_detections(spark, folder)
    return privacy.pseudonymise(staff, found, order_by="cle")[0]


@query("pii_masked_by_shuffle", sql.over([sql.staff_sql(), sql.token_ctes()], f"SELECT {_MASKED} FROM staff"))
def pii_masked_by_shuffle(spark, folder):
    """The way of large token tables: joined by shuffle, hot keys apart, one column after the other."""
    staff, found = _staff_and_detections(spark, folder)
    return privacy.pseudonymise(staff, found, order_by="cle", broadcast_rows=0, together=False)[0]


@query("pii_masked_together", sql.over([sql.staff_sql(), sql.token_ctes()], f"SELECT {_MASKED} FROM staff"))
def pii_masked_together(spark, folder):
    """The way of several large token tables: all columns by one join and one grouping."""
    staff, found = _staff_and_detections(spark, folder)
    return privacy.pseudonymise(staff, found, order_by="cle", broadcast_rows=0, together=True)[0]


@query("pii_leaks_in_prose", sql.over([sql.staff_sql()], """
    SELECT 'lettre' AS colonne, 2 * count(DISTINCT cle % 300) AS fuites FROM staff WHERE cle % 10 = 0"""))
def pii_leaks_in_prose(spark, folder):
    """Names of four and five words that stand inside letters of a masked table."""
    number = (F.col("cle") % 300).cast("string")
    said = F.concat(F.lit("Bonjour, je connais Élodie de La Tour"), number, F.lit(". Et Anne,  Marie de Saint-Cyr n"), number, F.lit(" aussi !"))
    letters = views.staff(spark, folder).withColumns({
        "nom": F.concat(F.lit("Élodie de La Tour"), number), "autre": F.concat(F.lit("Anne Marie de Saint-Cyr n"), number),
        "lettre": F.when(F.col("cle") % 10 == 0, said).otherwise("rien à dire"),
    })
    found = [privacy.Detection(name, fixed.PERSON_NAME, 1.0, "") for name in ("nom", "autre")]
    masked, mapping = privacy.pseudonymise(letters, found, order_by="cle")
    return privacy.leaks(masked, mapping).groupBy("colonne").agg(F.count(F.lit(1)).alias("fuites"))


@query("pii_masking_summary", sql.over([sql.staff_sql(), sql.token_ctes()],
    "SELECT colonne, count(*) AS valeurs_masquees FROM jet GROUP BY colonne"))
def pii_masking_summary(spark, folder):
    staff, found = _staff_and_detections(spark, folder)
    return privacy.masking_summary(privacy.tokens(staff, found, order_by="cle"))


@query("pii_token_vault", sql.over([sql.staff_sql(), """
    v AS (SELECT 'adresse e-mail' AS type_pii, email AS x, min(CASE WHEN cle % 3 = 0 THEN 0 ELSE 1 END) AS lot,
        min(CASE WHEN cle % 3 = 0 THEN cle END) AS p0, min(cle) AS p1 FROM staff GROUP BY email
      UNION ALL SELECT 'nom de personne', prenom, min(CASE WHEN cle % 3 = 0 THEN 0 ELSE 1 END),
        min(CASE WHEN cle % 3 = 0 THEN cle END), min(cle) FROM staff GROUP BY prenom),
    r AS (SELECT type_pii, x, row_number() OVER (PARTITION BY type_pii ORDER BY lot, CASE WHEN lot = 0 THEN p0 ELSE p1 END) AS rang FROM v)
    """], """SELECT type_pii, sha256(x) AS empreinte, rang,
      CASE type_pii WHEN 'adresse e-mail' THEN printf('email_%03d@masked.local', rang) ELSE printf('PERS_%03d', rang) END AS jeton
    FROM r"""))
def pii_token_vault(spark, folder):
    staff = views.staff(spark, folder)
    kinds = {"email": fixed.EMAIL, "prenom": fixed.PERSON_NAME}
    first, second = staff.where(F.col("cle") % 3 == 0), staff.where(F.col("cle") % 3 != 0)
    vault = written(privacy.extend_vault(None, first, kinds, order_by="cle"), "coffre")
    return privacy.extend_vault(vault, second, kinds, order_by="cle")


@query("pii_leak_audit", sql.over([sql.staff_sql(), sql.token_ctes()], """
    SELECT 'masquee' AS table_verifiee, count(DISTINCT empreinte) AS valeurs_verifiees, 0 AS fuites FROM jet
    UNION ALL SELECT 'originale', count(DISTINCT empreinte), count(*) FROM jet"""))
def pii_leak_audit(spark, folder):
    staff, found = _staff_and_detections(spark, folder)
    masked, mapping = privacy.pseudonymise(staff, found, order_by="cle")
    audited = {"masquee": masked, "originale": staff}
    return _stack([
        privacy.leak_audit(df, mapping).select(F.lit(name).alias("table_verifiee"), "*") for name, df in audited.items()
    ])


# --- Across tables ------------------------------------------------------------------------


@query("revenue_by_segment", sql.over([sql.sales_sql(), sql.staff_sql()], """
    SELECT lower(trim(service)) AS service, anciennete, round(sum(montant), 2) AS chiffre, count(*) AS ventes
    FROM sales JOIN staff ON sales.cle = staff.cle WHERE a_quitte = 0 GROUP BY 1, 2"""))
def revenue_by_segment(spark, folder):
    staff = views.staff(spark, folder).where("a_quitte = 0")
    by = [crosscheck.folded(F.col("service")), F.col("anciennete")]
    total = crosscheck.sum_by_attribute(
        views.sales(spark, folder), staff, key="cle", dimension_key="cle", measure="montant", by=by)
    return total.select(
        F.col("_0").alias("service"), F.col("_1").alias("anciennete"), F.round("total", 2).alias("chiffre"),
        F.col("nb_lignes").alias("ventes"))


@query("orphan_keys", sql.over([sql.sales_sql(), sql.staff_sql()], """
    SELECT cle, count(*) AS nb_lignes FROM sales WHERE NOT EXISTS (SELECT 1 FROM staff WHERE staff.cle = sales.cle)
    GROUP BY cle"""))
def orphan_keys(spark, folder):
    return crosscheck.orphan_keys(
        views.sales(spark, folder), views.staff(spark, folder), key="cle", dimension_key="cle")


@query("key_coverage", sql.over([sql.sales_sql(), sql.staff_sql()], """
    SELECT count(*) AS nb_lignes, count(*) FILTER (cle IN (SELECT cle FROM staff)) AS lignes_resolues,
      round(count(*) FILTER (cle IN (SELECT cle FROM staff)) / count(*), 4) AS part_resolue FROM sales"""))
def key_coverage(spark, folder):
    return crosscheck.key_coverage(
        views.sales(spark, folder), views.staff(spark, folder), key="cle", dimension_key="cle")


@query("mean_by_class", """
    SELECT quality AS classe, count(*) AS nb_lignes, round(avg(n_chars), 2) AS moyenne
    FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY quality""")
def mean_by_class(spark, folder):
    sizes = views.read(spark, folder, "documents").select("doc_id", "n_chars")
    joined = views.read(spark, folder, "labels").select("doc_id", "quality").join(sizes, "doc_id")
    return crosscheck.mean_by_class(joined, label="quality", measure="n_chars")


# --- Cleaning -----------------------------------------------------------------------------


@query("clean_impute", sql.over([sql.staff_sql()], """
    SELECT * REPLACE (round(coalesce(salaire, (SELECT avg(salaire) FROM staff)), 2) AS salaire) FROM staff"""))
def clean_impute(spark, folder):
    staff = views.staff(spark, folder)
    cleaned = cleaning.replay(staff, [cleaning.impute_mean(staff, "salaire")])
    return cleaned.withColumn("salaire", F.round("salaire", 2))


@query("clean_dedupe", sql.over([sql.sales_sql()], "SELECT DISTINCT * FROM sales"))
def clean_dedupe(spark, folder):
    return cleaning.replay(views.sales(spark, folder), [cleaning.CleaningAction(0, cleaning.DEDUPE)])


_PARSED = """coalesce(strftime(try_strptime(date_vente, '%Y-%m-%d'), '%Y-%m-%d'),
  strftime(try_strptime(date_vente, '%d/%m/%Y'), '%Y-%m-%d'), strftime(try_strptime(date_vente, '%d-%m-%Y'), '%Y-%m-%d'))"""


@query("clean_dates", sql.over([sql.sales_sql()], f"SELECT * REPLACE ({_PARSED} AS date_vente) FROM sales"))
def clean_dates(spark, folder):
    sales = views.sales(spark, folder)
    return cleaning.replay(sales, [cleaning.CleaningAction(0, cleaning.DATES, "date_vente")])


_KEPT_SPELLING = """c AS (SELECT service AS s, lower(trim(service)) AS f, count(*) AS n FROM staff GROUP BY 1, 2),
    k AS (SELECT f, s AS gardee, row_number() OVER (PARTITION BY f ORDER BY n DESC, s) AS r FROM c QUALIFY r = 1)"""


@query("clean_modalities", sql.over([sql.staff_sql(), _KEPT_SPELLING], """
    SELECT staff.* REPLACE (gardee AS service) FROM staff JOIN k ON lower(trim(service)) = f"""))
def clean_modalities(spark, folder):
    staff = views.staff(spark, folder)
    return cleaning.replay(staff, [cleaning.regroup_spellings(staff, "service")])


_FENCES = """q AS (SELECT quantile_cont(salaire, 0.25) AS a, quantile_cont(salaire, 0.75) AS b FROM staff)"""


@query("clean_outliers", sql.over([sql.staff_sql(), _FENCES], """
    SELECT staff.*, coalesce(salaire < a - 1.5 * (b - a) OR salaire > b + 1.5 * (b - a), false) AS salaire_extreme
    FROM staff, q"""))
def clean_outliers(spark, folder):
    staff = views.staff(spark, folder)
    return cleaning.replay(staff, [cleaning.handle_outliers(staff, "salaire")])


@query("clean_flags", sql.over([sql.sales_sql(), sql.staff_sql()], """
    SELECT *, montant < 0 AS montant_negatif, cle NOT IN (SELECT cle FROM staff) AS cle_orphelin FROM sales"""))
def clean_flags(spark, folder):
    sales = views.sales(spark, folder)
    return cleaning.replay(sales, [
        cleaning.CleaningAction(0, cleaning.NEGATIVES, "montant"),
        cleaning.flag_orphans(sales, "cle", views.staff(spark, folder), "cle", order_index=1),
    ])


def _replayed_plan(spark: SparkSession, folder: str):
    staff = views.staff(spark, folder)
    actions = [
        cleaning.regroup_spellings(staff, "service", order_index=2),
        cleaning.handle_outliers(staff, "salaire", order_index=0, drop=True),
        cleaning.impute_mean(staff, "salaire", order_index=1),
        cleaning.CleaningAction(3, cleaning.DEDUPE),
        cleaning.CleaningAction(4, cleaning.NEGATIVES, "salaire", enabled=False),
    ]
    return staff, actions


_REPLAYED = [
    sql.staff_sql(), _FENCES, _KEPT_SPELLING,
    """e0 AS (SELECT staff.* FROM staff, q
      WHERE NOT coalesce(salaire < a - 1.5 * (b - a) OR salaire > b + 1.5 * (b - a), false))""",
    "e1 AS (SELECT * REPLACE (coalesce(salaire, (SELECT avg(salaire) FROM staff)) AS salaire) FROM e0)",
    "e2 AS (SELECT e1.* REPLACE (gardee AS service) FROM e1 JOIN k ON lower(trim(service)) = f)",
]


@query("clean_replay", sql.over(_REPLAYED, "SELECT DISTINCT * REPLACE (round(salaire, 2) AS salaire) FROM e2"))
def clean_replay(spark, folder):
    staff, actions = _replayed_plan(spark, folder)
    return cleaning.replay(staff, actions).withColumn("salaire", F.round("salaire", 2))


def _sales_plan(spark: SparkSession, folder: str):
    sales = views.sales(spark, folder)
    return sales, [
        cleaning.CleaningAction(0, cleaning.DATES, "date_vente"),
        cleaning.CleaningAction(1, cleaning.DEDUPE),
        cleaning.CleaningAction(2, cleaning.NEGATIVES, "montant"),
        cleaning.flag_orphans(sales, "cle", views.staff(spark, folder), "cle", order_index=3),
    ]


_SALES_REPLAYED = [
    sql.sales_sql(), sql.staff_sql(),
    f"d AS (SELECT DISTINCT ordre, id_vente, cle, coalesce({_PARSED}, date_vente) AS date_vente, client, montant, statut FROM sales)",
]


@query("clean_replay_stored", sql.over(_SALES_REPLAYED, """
    SELECT *, montant < 0 AS montant_negatif, cle NOT IN (SELECT cle FROM staff) AS cle_orphelin FROM d"""))
def clean_replay_stored(spark, folder):
    """A plan written, read back and replayed."""
    sales, actions = _sales_plan(spark, folder)
    place = _new_folder(spark, "plans")
    cleaning.store_plan(spark, place, "ventes", actions)
    return cleaning.replay(sales, cleaning.stored_plan(spark, place, "ventes"))


@query("clean_replay_stored_counts", sql.over(_SALES_REPLAYED, f"""
    SELECT 0 AS order_index, 'unify_dates' AS action_type, (SELECT count(*) FROM sales WHERE {_PARSED} <> date_vente) AS rows_affected
    UNION ALL SELECT 1, 'drop_duplicates', (SELECT count(*) FROM sales) - (SELECT count(*) FROM d)
    UNION ALL SELECT 2, 'flag_negative', (SELECT count(*) FROM d WHERE montant < 0)
    UNION ALL SELECT 3, 'flag_orphans', (SELECT count(*) FROM d WHERE cle NOT IN (SELECT cle FROM staff))"""))
def clean_replay_stored_counts(spark, folder):
    sales, actions = _sales_plan(spark, folder)
    place = _new_folder(spark, "plans")
    path = cleaning.store_plan(spark, place, "ventes", actions, cleaning.rows_affected(sales, actions))
    return spark.read.parquet(path).select("order_index", "action_type", "rows_affected")


_KEPT_COUNTS = f"""n AS (SELECT 0 AS order_index, (SELECT count(*) FROM sales WHERE {_PARSED} <> date_vente) AS rows_affected
    UNION ALL SELECT 1, (SELECT count(*) FROM sales) - (SELECT count(*) FROM d)
    UNION ALL SELECT 2, (SELECT count(*) FROM d WHERE montant < 0)
    UNION ALL SELECT 3, (SELECT count(*) FROM d WHERE cle NOT IN (SELECT cle FROM staff)))"""


@query("clean_replay_kept", sql.over([*_SALES_REPLAYED, _KEPT_COUNTS], """
    SELECT 1 AS passage, 0 AS reprises, order_index, rows_affected, (SELECT count(*) FROM d) AS nb_lignes FROM n
    UNION ALL SELECT 2, 2, order_index, rows_affected, (SELECT count(*) FROM d) FROM n WHERE order_index <> 2
    UNION ALL SELECT 3, 4, order_index, rows_affected, (SELECT count(*) FROM d) FROM n"""))
def clean_replay_kept(spark, folder):
    """A plan replayed, replayed with its third action switched off, and with it on again: what was kept is not run again."""
    sales, actions = _sales_plan(spark, folder)
    place, frames = _new_folder(spark, "etats"), []
    for passage, on in ((1, True), (2, False), (3, True)):
        state, counts, kept = replay.replay(sales, cleaning.toggled(actions, 2, on), folder=place, version="ventes-1")
        rows = [{"passage": passage, "reprises": kept, "order_index": at, "rows_affected": n} for at, n in counts]
        told = local_table(spark, rows, "passage int, reprises int, order_index int, rows_affected bigint")
        frames.append(told.withColumn("nb_lignes", F.lit(state.count())))
    return _stack(frames)


@query("clean_replay_counts", sql.over(_REPLAYED, """
    SELECT 0 AS order_index, 'handle_outliers' AS action_type, (SELECT count(*) FROM staff) - (SELECT count(*) FROM e0) AS rows_affected
    UNION ALL SELECT 1, 'impute_mean', (SELECT count(*) FROM e0 WHERE salaire IS NULL)
    UNION ALL SELECT 2, 'regroup_spellings', (SELECT count(*) FROM e1 JOIN k ON lower(trim(service)) = f WHERE service <> gardee)
    UNION ALL SELECT 3, 'drop_duplicates', 0 UNION ALL SELECT 4, 'flag_negative', 0"""))
def clean_replay_counts(spark, folder):
    staff, actions = _replayed_plan(spark, folder)
    plan = cleaning.plan_table(spark, "staff", actions, cleaning.rows_affected(staff, actions))
    return plan.select("order_index", "action_type", "rows_affected")


# --- Metering and registry ----------------------------------------------------------------


def _usage(spark: SparkSession, folder: str) -> DataFrame:
    model = (
        F.when(F.col("role") == "user", "gpt-5.6-luna").when(F.col("role") == "assistant", "openai/gpt-oss-120b")
        .otherwise("sans-tarif")
    )
    return views.read(spark, folder, "conversations").select(
        F.col("role").alias("agent"), model.alias("model"),
        F.char_length("text").cast("bigint").alias("tokens_in"), (F.col("turn") * 10 + 1).alias("tokens_out"))


_USAGE_SQL = """u AS (SELECT role AS agent, CASE role WHEN 'user' THEN 'gpt-5.6-luna' WHEN 'assistant' THEN 'openai/gpt-oss-120b'
      ELSE 'sans-tarif' END AS model, length(text) AS ti, turn * 10 + 1 AS tou FROM conversations),
    r AS (SELECT * FROM (VALUES {}) AS t(model, pi, po))""".format(
    ", ".join(f"('{model}', {pin}, {out})" for model, pin, out in fixed.RATE_CARD))


@query("priced_usage", sql.over([_USAGE_SQL], """
    SELECT agent, u.model, count(*) AS appels, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tou) AS BIGINT) AS tokens_out,
      round(coalesce((sum(ti) * CAST(any_value(pi) AS DOUBLE) + sum(tou) * CAST(any_value(po) AS DOUBLE)) / 1000000 * 100, 0), 4) AS cost_cents
    FROM u LEFT JOIN r ON u.model = r.model GROUP BY agent, u.model"""))
def priced_usage(spark, folder):
    return metering.priced_usage(_usage(spark, folder), metering.rate_card(spark))


@query("rate_card_gaps", sql.over([_USAGE_SQL], "SELECT DISTINCT model FROM u WHERE model NOT IN (SELECT model FROM r)"))
def rate_card_gaps(spark, folder):
    return metering.rate_card_gaps(_usage(spark, folder), metering.rate_card(spark))


@query("csv_ragged", """
    SELECT o_orderkey AS ordre, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS statut,
      CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS montant FROM orders""")
def csv_ragged(spark, folder):
    """Records with fewer cells than the header: what lacks is missing."""
    path = f"{_new_folder(spark, 'inegal')}/table.csv"
    cells = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(",", "o_orderkey")).when(
        F.col("o_orderkey") % 3 == 2, F.concat_ws(",", "o_orderkey", "o_orderstatus")
    ).otherwise(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice"))
    lines = views.read(spark, folder, "orders").select(cells.alias("ordre,statut,montant"))
    lines.write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)
    return loader.load(spark, path)


_READ_TEXT = "CASE WHEN text NOT IN (" + sql.quoted_list(fixed.MISSING_TOKENS) + ") THEN text END AS text"


# Splits of these files: so many, none smaller and none larger than this. Every split sends its tasks' results to the driver.
_SPLITS, _LEAST_SPLIT, _MOST_SPLIT = 64, 64 * 1024, 32 * 1024**2


def _split_bytes(total: int, usual: int) -> int:
    return min(usual, _MOST_SPLIT, max(_LEAST_SPLIT, total // _SPLITS))


@query("csv_quoted_split", f"SELECT doc_id, {_READ_TEXT}, lang, source, n_chars FROM documents")
def csv_quoted_split(spark, folder):
    """Texts with quotes and line ends, in files of many splits: read in as many tasks as there are splits."""
    documents = views.read(spark, folder, "documents")
    path = sinks.write_table(documents.coalesce(2), f"{_new_folder(spark, 'cites')}/table.csv")
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    total = loader.list_files(spark, path).agg(F.sum("length")).head()[0] or 0
    spark.conf.set(setting, str(_split_bytes(total, loader.size_in_bytes(usual))))
    try:
        return written(loader.load(spark, path), "lus")
    finally:
        spark.conf.set(setting, usual)


@query("csv_many_files", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def csv_many_files(spark, folder):
    """A folder of files of 100 records, half of them with their columns in another order."""
    path = f"{_new_folder(spark, 'fichiers')}/table.csv"
    orders = views.read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    for rest, columns in enumerate((orders.columns, orders.columns[::-1])):
        part = orders.where(F.col("o_orderkey") % 2 == rest).select(*columns)
        part.write.mode("append").option("header", True).option("maxRecordsPerFile", 100).csv(path)
    return loader.load(spark, path)


@query("admission", """
    SELECT nom, n <= 500 AS admise, n AS nb_lignes FROM (
      SELECT 'nation' AS nom, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
      UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part)""")
def admission(spark, folder):
    """Tables of at most 500 rows are admitted, in either format."""
    frames = []
    for name, kind in (("nation", "csv"), ("supplier", "parquet"), ("customer", "csv"), ("part", "parquet")):
        table = views.read(spark, folder, name)
        path = sinks.write_table(table, f"{_new_folder(spark, 'admission')}/{name}.{kind}")
        try:
            admitted = not loader.load(spark, path, max_rows=500).isEmpty()
        except loader.Refused:
            admitted = False
        frames.append(table.agg(F.count(F.lit(1)).alias("nb_lignes")).select(F.lit(name).alias("nom"), F.lit(admitted).alias("admise"), "nb_lignes"))
    return _stack(frames)


@query("stored_profile", """
    SELECT 'supplier.csv' AS name, count(*) AS nb_lignes, (SELECT count(*) FROM (DESCRIBE supplier)) AS nb_colonnes,
      round(avg(s_acctbal), 2) AS moyenne FROM supplier""")
def stored_profile(spark, folder):
    """A profile written to the registry and found again by the dataset's number."""
    path = sinks.write_table(views.read(spark, folder, "supplier"), f"{_new_folder(spark, 'fiche')}/supplier.csv")
    store = intake.Store(_new_folder(spark, "registre"))
    row = intake.register(spark, store, "w1", path)
    found = registry.find(registry.read(spark, store.registry), row["id"])
    whole = registry.read(spark, store.registry).where(F.col("id") == found["id"]).select("name", F.from_json(
        "profile", "nb_lignes bigint, nb_colonnes bigint, colonnes array<struct<nom:string,statistiques:struct<moyenne:double>>>").alias("p"))
    balance = F.filter("p.colonnes", lambda c: c["nom"] == "s_acctbal")[0]["statistiques"]["moyenne"]
    return whole.select("name", "p.nb_lignes", "p.nb_colonnes", balance.alias("moyenne"))


@query("stored_tokens", sql.over([sql.staff_sql(), sql.token_ctes()], """
    SELECT 'masquee' AS pii_status, 2 AS version, 0 AS fuites, colonne AS column_name, count(*) AS jetons FROM jet GROUP BY colonne"""))
def stored_tokens(spark, folder):
    """A registered dataset masked: its new status and version, the audit, and the tokens kept for each column."""
    path = sinks.write_table(views.staff(spark, folder), f"{_new_folder(spark, 'masque')}/staff.csv")
    store = intake.Store(_new_folder(spark, "registre"))
    row = intake.register(spark, store, "w1", path)
    result = intake.pseudonymise(spark, store, row["id"])
    now = registry.current(registry.read(spark, store.registry)).select("id", "pii_status", "version")
    kept = store.tokens(spark).groupBy("file_id", "column_name").agg(F.count_distinct("original_hash").alias("jetons"))
    return kept.join(now, F.col("file_id") == F.col("id")).select(
        "pii_status", "version", F.lit(result["fuites"]).cast("int").alias("fuites"), "column_name", "jetons")


@query("registry_listing", """
    SELECT concat('fichier-', CAST(doc_id AS VARCHAR)) AS id, concat('doc', CAST(doc_id AS VARCHAR), '.csv') AS name,
      'csv' AS format, doc_id * 10 AS size_bytes,
      CASE WHEN doc_id % 3 = 0 THEN 'masquee' WHEN toxic = 1 THEN 'detectee' ELSE 'aucune' END AS pii_status,
      CASE WHEN doc_id % 3 = 0 THEN 99.0 ELSE 50.0 + quality END AS quality_score
    FROM labels WHERE doc_id % 5 = 1""")
def registry_listing(spark, folder):
    """Registry rows in two versions per third dataset; the listing shows the latest of each."""
    labels = views.read(spark, folder, "labels")
    key = F.col("doc_id").cast("string")
    first = labels.select(
        F.concat(F.lit("fichier-"), key).alias("id"), F.concat(F.lit("w"), F.col("doc_id") % 5).alias("workspace_id"),
        F.concat(F.lit("doc"), key, F.lit(".csv")).alias("name"), F.lit("csv").alias("format"),
        (F.col("doc_id") * 10).alias("size_bytes"), F.concat(F.lit("/d/"), key).alias("path"),
        F.lit("{}").alias("profile"), (F.lit(50.0) + F.col("quality")).alias("quality_score"),
        F.when(F.col("toxic") == 1, fixed.PII_FOUND).otherwise(fixed.PII_NONE).alias("pii_status"),
        F.lit(1).alias("version"), F.timestamp_seconds(F.col("doc_id")).alias("created_at"))
    second = first.where(F.substring("id", 9, 20).cast("bigint") % 3 == 0).withColumns({
        "version": F.lit(2), "quality_score": F.lit(99.0), "pii_status": F.lit(fixed.PII_MASKED)})
    return registry.listing(first.unionByName(second), "w1").drop("created_at")
