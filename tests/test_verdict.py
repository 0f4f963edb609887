"""Cases that once went wrong: decimals, equal rows, headers, positions, leaks inside cells."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import tamis
from tamis import intake, session
from tamis.functions import fixed
from tamis.operators import lookup, privacy, spread
from tamis.operators.duplicates import duplicate_rows
from tamis.operators.ranks import number_in_order
from tamis.sources import loader


def test_decimals_are_profiled_as_numbers(spark):
    rows = [(Decimal(i % 2), Decimal(i) / 4, Decimal(i), Decimal(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "oui decimal(5,2), quart decimal(15,2), cle decimal(15,0), moins decimal(15,3)")
    columns = {c["nom"]: c for c in json.loads(tamis.profile(df).select(F.to_json("colonnes")).head()[0])}
    assert [columns[n]["type"] for n in ("oui", "quart", "cle", "moins")] == ["booléen", "décimal", "identifiant", "identifiant"]
    assert columns["quart"]["statistiques"]["moyenne"] == pytest.approx(4.88, abs=0.01)


def test_whole_decimals_are_looked_at_for_personal_numbers(spark):
    df = spark.createDataFrame([(Decimal(10**13 + i), Decimal(i)) for i in range(9)], "nir decimal(15,0), n decimal(15,2)")
    assert [(d.colonne, d.type_pii) for d in tamis.detections(tamis.detect(df))] == [("nir", fixed.SOCIAL_SECURITY)]


@pytest.mark.parametrize("width", [1, 16, 17])
def test_both_zeros_are_equal_in_tables_of_any_width(spark, width):
    df = spark.createDataFrame([(0.0,) * width, (-0.0,) * width], ", ".join(f"x{i} double" for i in range(width)))
    assert tuple(duplicate_rows(df).head()) == (2, 1)


def test_equal_rows_are_spread_evenly(spark):
    df = spark.range(4000).select(F.lit("same").alias("v")).coalesce(1)
    sizes = spread.spread(df).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 1.5 * 4000 / spark.sparkContext.defaultParallelism


def test_a_table_of_few_long_keys_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 100)
    table = spark.createDataFrame([("k" * 80, "a", 1), ("l" * 80, "b", 1)], "cle string, valeur string, occurrences long")
    df = spark.createDataFrame([("k" * 80,), (None,), ("m",)], "x string")
    out = lookup.attach(df, F.col("x"), table, size=2, total=3)
    assert sorted(str(r["_valeur"]) for r in out.collect()) == ["None", "None", "a"]


def test_no_shared_folder_is_refused_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)


def write(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)


def test_files_with_columns_in_other_orders_are_put_together_by_name(spark, tmp_path):
    write(tmp_path / "t.csv/1.csv", "a,b\n1,x\n")
    write(tmp_path / "t.csv/2.csv", "b,a\ny,2\n")
    assert sorted(map(tuple, tamis.load(spark, str(tmp_path / "t.csv")).select("a", "b").collect())) == [(1, "x"), (2, "y")]
    write(tmp_path / "t.csv/3.csv", "b,c\ny,2\n")
    with pytest.raises(tamis.Refused):
        tamis.load(spark, str(tmp_path / "t.csv"))


def test_names_that_differ_in_case_or_are_used_inside(spark, tmp_path):
    write(tmp_path / "d/n.csv", "Nom,nom,_en_trop,_position\n1,2,3,4\n")
    df = tamis.load(spark, str(tmp_path / "d/n.csv"), with_position=True)
    assert df.columns == ["Nom", "nom.1", "_en_trop", "_position", "_position_"]
    assert tuple(df.drop("_position_").head()) == (1, 2, 3, 4)


def test_a_header_cell_may_hold_a_line_end(spark, tmp_path):
    write(tmp_path / "d/h.csv", '"nom\nlong",b\n1,2\n')
    assert tamis.load(spark, str(tmp_path / "d/h.csv")).columns == ["nom\nlong", "b"]


@pytest.mark.parametrize("order", ["cle", "texte", "lieu"])
def test_the_vault_takes_any_order(spark, order):
    df = spark.createDataFrame([(2, "b", (0, 2), "y@x.fr", "z@x.fr"), (1, "a", (0, 1), "z@x.fr", None)], "cle int, texte string, lieu struct<a:int,b:int>, m string, n string")
    vault = privacy.extend_vault(None, df, {"m": fixed.EMAIL, "n": fixed.EMAIL}, order_by=order)
    assert [r["rang"] for r in vault.orderBy("rang").collect()] == [1, 2]
    first = privacy.vault_mapping(session.written(vault, "coffre"), df, {"m": fixed.EMAIL}).where("rang = 1").head()
    assert first["occurrences"] == 1


def test_repeated_order_values_are_cut_into_blocks(spark, monkeypatch):
    from tamis.operators import ranks

    monkeypatch.setattr(ranks, "BLOCK_BITS", 4)
    df = spark.range(300).select(F.lit(7).alias("o"), F.col("id").cast("string").alias("v"), F.lit("g").alias("g"))
    out = number_in_order(df, ["g"], "o", "n", tie=["v"])
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 301))


def test_values_inside_cells_and_in_the_context_are_leaks(spark):
    df = spark.createDataFrame([(f"u{i}@x.fr", f"note {i}") for i in range(10)], "mail string, note string").coalesce(1)
    found = tamis.detections(tamis.detect(df))
    masked, mapping = tamis.pseudonymise(df, found)
    assert tamis.leaks(masked, mapping).count() == 0
    leaking = masked.withColumn("note", F.when(F.col("note") == "note 3", "écrire à u3@x.fr, merci").otherwise(F.col("note")))
    assert [r["colonne"] for r in tamis.leaks(leaking, mapping).collect()] == ["note"]
    assert privacy.context_leaks(tamis.context(tamis.profile(df)), mapping).count() > 0
    assert privacy.context_leaks(tamis.context(tamis.profile(masked)), mapping).count() == 0


def test_files_masked_with_one_vault_share_tokens(spark, tmp_path):
    store, vault = intake.Store(str(tmp_path / "s")), None
    tokens = []
    for k in range(2):
        write(tmp_path / f"in/{k}.csv", "mail,n\n" + "".join(f"u{i + k}@x.fr,{i}\n" for i in range(5)))
        row = intake.register(spark, store, "w", str(tmp_path / f"in/{k}.csv"))
        empty = spark.createDataFrame([], privacy.VAULT_SCHEMA)
        new = intake.pseudonymise(spark, store, row["id"], vault=empty if vault is None else vault)
        vault = spark.read.parquet(f"{store.folder}/coffre/{row['id']}-v2.parquet")
        tokens.append([r["mail"] for r in spark.read.parquet(new["path"]).orderBy("n").collect()])
    assert tokens[0][1:] == tokens[1][:4] and vault.count() == 6


def test_the_approximate_mode_is_within_its_error(spark):
    from tamis.operators.profile import approximate

    df = spark.range(20_000).select(F.col("id").alias("n"), (F.col("id") % 50).cast("string").alias("s"), F.when(F.col("id") % 4 == 0, F.col("id") * 0.5).alias("x"))
    got = {r["nom"]: r for r in approximate(df).collect()}
    assert abs(got["n"]["distinctes"] - 20_000) <= 0.05 * 20_000 and abs(got["s"]["distinctes"] - 50) <= 3
    assert abs(got["n"]["q50"] - 10_000) <= 0.02 * 20_000 and got["x"]["manquantes"] == 15_000 and got["s"]["q50"] is None


def test_a_stored_plan_is_replayed(spark, tmp_path):
    from tamis.operators import cleaning

    df = spark.createDataFrame([(1, "Data", 5.0), (2, "data", None), (3, "Data", -1.0), (3, "Data", -1.0)], "k int, s string, x double")
    actions = [
        cleaning.regroup_spellings(df, "s"), cleaning.impute_mean(df, "x", 1), cleaning.CleaningAction(2, cleaning.DEDUPE),
        cleaning.CleaningAction(3, cleaning.NEGATIVES, "x"), cleaning.CleaningAction(4, cleaning.DATES, "s", enabled=False),
    ]
    counts = cleaning.rows_affected(df, actions)
    assert counts == [(0, 1), (1, 1), (2, 1), (3, 1)]
    cleaning.store_plan(spark, str(tmp_path), "f", actions, counts)
    again = cleaning.stored_plan(spark, str(tmp_path), "f")
    assert [a.enabled for a in again] == [True, True, True, True, False]
    assert sorted(map(str, cleaning.replay(df, again).collect())) == sorted(map(str, cleaning.replay(df, actions).collect()))


def test_a_separator_of_the_loader_stays_free():
    assert loader.free("_x", ["_X", "a"]) == "_x_"
