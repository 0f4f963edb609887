"""Detection, pseudonyms, vault and audit."""

import hashlib

import pytest
from pyspark.sql import functions as F

import tamis
from tamis.functions import fixed
from tamis.operators import lookup, privacy


def one_column(spark, values, name="x", kind="string"):
    rows = [(i, value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, f"k bigint, {name} {kind}").coalesce(1)


def kind_of(spark, values, kind="string"):
    found = tamis.detections(tamis.detect(one_column(spark, values, kind=kind), exclude=["k"]))
    return found[0].type_pii if found else None


@pytest.mark.parametrize(("values", "expected"), [
    (["a@b.fr", " C@D.FR ", "e@f.org"], fixed.EMAIL),
    (["+33617025658", "+33612345678", "0612345678"], fixed.PHONE),
    (["FR76" + "1" * 23, "fr76" + "0" * 23], fixed.IBAN),
    (["0123456789012", "123456789012345"], fixed.SOCIAL_SECURITY),
    (["Élodie", "MARTIN Paul", "élodie", "théo"], fixed.PERSON_NAME),
    (["rien a signaler"] * 18 + ["a@b.fr", "c@d.fr"], None),
    (["Groupe Lorrain", "Atelier Bastide", "Maison Delaunay"], None),
    (["a@b.fr"] * 4 + ["x"], fixed.EMAIL),
    (["a@b.fr"] * 3 + ["x"], None),
    (["+33017025658", "0012345678"], None),
    (["", "   ", "Lucas"], fixed.PERSON_NAME),
    ([None, None], None),
])
def test_detection(spark, values, expected):
    assert kind_of(spark, values) == expected


def test_whole_numbers_may_be_social_security_numbers(spark):
    assert kind_of(spark, [1234567890123, 123456789012345, None], "bigint") == fixed.SOCIAL_SECURITY
    assert kind_of(spark, [1234567890, 12], "bigint") is None


def test_confidence_and_example(spark):
    df = one_column(spark, ["a@b.fr"] * 5 + ["x"])
    (found,) = tamis.detections(tamis.detect(df, exclude=["k"]))
    assert (found.colonne, found.confiance, found.exemple_masque) == ("x", 0.833, "email_001@masked.local")


def masked(spark, df, **options):
    found = tamis.detections(tamis.detect(df, exclude=["k"]))
    table, mapping = tamis.pseudonymise(df, found, order_by="k", **options)
    return table, mapping


def test_tokens_are_stable_and_numbered_by_first_appearance(spark):
    df = one_column(spark, ["c@d.fr", "a@b.fr", None, "c@d.fr"])
    table, mapping = masked(spark, df.repartition(3))
    assert [row.x for row in table.sort("k").collect()] == [
        "email_001@masked.local", "email_002@masked.local", None, "email_001@masked.local"]
    assert {row.empreinte for row in mapping.collect()} == {
        hashlib.sha256(v.encode()).hexdigest() for v in ("a@b.fr", "c@d.fr")}


def test_default_order_is_the_order_of_the_rows(spark):
    df = one_column(spark, ["c@d.fr", "a@b.fr"]).select("x")
    table, _ = tamis.pseudonymise(df, tamis.detections(tamis.detect(df)))
    assert sorted(row.x for row in table.collect()) == ["email_001@masked.local", "email_002@masked.local"]


def test_outer_blanks_are_distinct_values_unless_normalised(spark):
    df = one_column(spark, ["a@b.fr", " a@b.fr"])
    assert masked(spark, df)[1].count() == 2
    assert masked(spark, df, normalise=True)[1].count() == 1


def test_a_key_changes_fingerprints_not_tokens(spark):
    df = one_column(spark, ["a@b.fr", "c@d.fr"])
    plain, keyed = masked(spark, df), masked(spark, df, key="secret")
    assert plain[0].sort("k").collect() == keyed[0].sort("k").collect()
    assert plain[1].join(keyed[1], "empreinte").count() == 0


def skewed(spark):
    """One value and the missing cells hold a third of the rows each; duplicates included."""
    values = []
    for i in range(900):
        values.append("hot@x.fr" if i % 3 == 0 else None if i % 3 == 1 else f"u{i}@x.fr")
    return one_column(spark, values)


def test_the_shuffle_join_gives_what_the_broadcast_gives(spark, monkeypatch):
    df = skewed(spark).repartition(4)
    small, _ = masked(spark, df)
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.01)
    large, _ = masked(spark, df, broadcast_rows=0)
    assert small.sort("k").collect() == large.sort("k").collect()


def test_hot_and_missing_cells_are_spread(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.01)
    try:
        table, _ = masked(spark, skewed(spark).repartition(4), broadcast_rows=0)
        sizes = [row[0] for row in table.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 * 1024**2)
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(sizes) == 900 and len(sizes) == 4 and max(sizes) < 300


def test_nothing_leaks_and_a_leak_is_seen(spark):
    df = one_column(spark, ["a@b.fr", "c@d.fr", "e@f.fr"]).withColumn("note", F.lit("ok"))
    table, mapping = masked(spark, df)
    assert tamis.leak_audit(table, mapping).collect() == [(3, 0)]
    leaking = table.withColumn("note", F.when(F.col("k") == 1, "c@d.fr").otherwise("ok"))
    assert [row.colonne for row in tamis.leaks(leaking, mapping).collect()] == ["note"]
    assert table.count() == df.count()
    assert table.groupBy("x").count().count() == df.groupBy("x").count().count()


def test_vault_keeps_tokens_across_files_and_columns(spark):
    columns = {"prenom": fixed.PERSON_NAME, "nom": fixed.PERSON_NAME}
    first = spark.createDataFrame([(0, "Paul", "Martin"), (1, "Martin", "Roux")], "k bigint, prenom string, nom string")
    second = spark.createDataFrame([(0, "Roux", "Simon"), (1, "Paul", None)], "k bigint, prenom string, nom string")
    vault = tamis.extend_vault(None, first, columns, order_by="k")
    assert [row.jeton for row in vault.sort("rang").collect()] == ["PERS_001", "PERS_002", "PERS_003"]
    grown = tamis.extend_vault(vault, second, columns, order_by="k")
    assert grown.count() == 4
    mapping = tamis.vault_mapping(grown, second, columns)
    found = [privacy.Detection(name, kind, 1.0, "") for name, kind in columns.items()]
    assert [tuple(row) for row in tamis.mask(second, mapping, found).sort("k").collect()] == [
        (0, "PERS_003", "PERS_004"), (1, "PERS_001", None)]


def test_tokens_widen_past_three_digits(spark):
    df = spark.range(1200).select(F.col("id").alias("k"), F.concat("id", F.lit("@x.fr")).alias("x"))
    found = [privacy.Detection("x", fixed.EMAIL, 1.0, "")]
    tokens = {row.jeton for row in tamis.tokens(df, found, order_by="k").collect()}
    assert "email_1200@masked.local" in tokens and len(tokens) == 1200
