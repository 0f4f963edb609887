"""Several large columns masked together, and originals of many words found inside texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

import tamis
from tamis import intake
from tamis.functions import fixed
from tamis.operators import lookup, privacy
from tamis.session import written
from tamis.sources import loader


def people(spark, rows):
    return spark.createDataFrame(rows, "n int, nom string, mail string, texte string")


def detected(*names):
    return [privacy.Detection(name, fixed.PERSON_NAME, 1.0, "") for name in names]


@pytest.mark.parametrize("hot", [True, False])
def test_masked_together_as_one_after_the_other(spark, monkeypatch, hot):
    if not hot:
        monkeypatch.setattr(lookup, "HOT_SHARE", 1.0)
    rows = [(i, "same" if i % 3 else f"p{i}", None if i % 7 == 0 else f"m{i % 50}", f"t{i}") for i in range(600)] + [(None, None, None, None)] * 3 + [(5, "p5", "m5", "t5")] * 2
    df = people(spark, rows).repartition(5).withColumn("_reste", F.lit(1)).withColumn("r0", F.lit("z"))
    mapping = written(privacy.tokens(df, detected("nom", "mail", "texte"), order_by="n"), "jetons")
    masks = {t: privacy.mask(df, mapping, detected("nom", "mail", "texte"), broadcast_rows=0, together=t) for t in (True, False)}
    assert masks[True].columns == df.columns == masks[False].columns
    assert sorted(map(str, masks[True].collect())) == sorted(map(str, masks[False].collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_table_moves_twice_for_any_number_of_columns(spark):
    counts = {}
    for k in (2, 6):
        df = spark.range(100).select(*[F.concat(F.lit(f"v{i}-"), F.col("id")).alias(f"c{i}") for i in range(k)], "id")
        found = detected(*[f"c{i}" for i in range(k)])
        mapping = written(privacy.tokens(df, found, order_by="id"), "jetons")
        counts[k] = exchanges(privacy.mask(df, mapping, found, broadcast_rows=0))
    assert counts[2] == counts[6] <= 3


def test_originals_of_three_and_five_words_are_found_in_prose(spark):
    df = people(spark, [
        (1, "Jean de La Fontaine", "a@x.fr", "rien"), (2, "Anne Marie de Saint Cyr", "b@x.fr", "rien"), (3, "Zoé", "c@x.fr", "rien"),
        (4, "Marie  Curie-Skłodowska", "d@x.fr", None),
    ])
    masked, mapping = privacy.pseudonymise(df, detected("nom", "mail"), order_by="n", key="k")
    assert privacy.leaks(masked, mapping, key="k").count() == 0
    mots = {r.mots for r in mapping.where("colonne = 'nom'").collect()}
    assert mots == {1, 2, 4, 5}
    for said, n in (
        ("Hier, Jean de La Fontaine.", 1), ("voir «Anne Marie de Saint Cyr», Jean\nde  La Fontaine !", 1), ("(Anne Marie de Saint Cyr; Jean\tde La Fontaine?)", 2),
        ("Jean de La", 0), ("La Fontaine Jean de", 0), ("Est-ce Zoé ?", 1), ("Marie Curie-Skłodowska's", 0), ("chez Marie Curie-Skłodowska…", 1), ("a@x.fr, b@x.fr", 2),
    ):
        leaking = masked.withColumn("texte", F.when(F.col("n") == 1, said).otherwise(F.col("texte")))
        found = privacy.leaks(leaking, mapping, key="k").collect()
        assert (len(found), {r.colonne for r in found} <= {"texte"}) == (n, True), said
        assert {r.empreinte for r in found} <= {r.empreinte for r in mapping.collect()}
    # Without the number of words, runs of one or two words are looked at, as before.
    short = mapping.drop("mots", "empreinte_mots")
    leaking = masked.withColumn("texte", F.lit("Zoé et Jean de La Fontaine"))
    assert privacy.leaks(leaking, short, key="k").count() == 1


def test_a_masked_dataset_is_audited_by_its_stored_tokens(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("mail,note\n" + "".join(f"u{i}@x.fr,n{i}\n" for i in range(10)))
    store = intake.Store(str(tmp_path / "s"))
    row = intake.register(spark, store, "w", str(path))
    result = intake.pseudonymise(spark, store, row["id"])
    clean = spark.read.parquet(result["path"])
    assert tuple(intake.audit(spark, store, row["id"], clean).head()) == (10, 0)
    leaking = clean.withColumn("note", F.lit("écrire à u3@x.fr, merci"))
    assert tuple(intake.audit(spark, store, row["id"], leaking).head()) == (10, 1)
    assert tamis.leaks is privacy.leaks


def test_places_in_files_are_compared_as_numbers(spark, tmp_path):
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    people = [(f"p{i % 40}", f"m{i * 7 % 300}@x.fr") for i in range(900)]
    folder = f"{tmp_path}/gens.csv"
    spark.createDataFrame(people, "nom string, mail string").repartition(3).write.option("header", True).csv(folder)
    spark.conf.set(setting, "2048")
    try:
        df = loader.load(spark, folder, with_position=True)
        refs = privacy._refs(df, detected("nom", "mail"))
        table, position = privacy._by_number(df, refs, "_position")
        told = table.select("_position", position.alias("n")).collect()
        assert len(told) == 900 and [r.n for r in sorted(told, key=lambda r: tuple(r._position))] == sorted({r.n for r in told})
        plan = table.groupBy("nom").agg(F.min(position))._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        firsts = {}
        for row in sorted(df.collect(), key=lambda r: tuple(r._position)):
            firsts.setdefault(row.mail, len(firsts) + 1)
        ranks = {row.empreinte: row.rang for row in privacy.tokens(df, detected("mail"), order_by="_position").collect()}
        assert ranks == {hashlib.sha256(mail.encode()).hexdigest(): rank for mail, rank in firsts.items()}
    finally:
        spark.conf.set(setting, usual)
