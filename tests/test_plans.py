"""Every registered query against its SQL statement, and operations that write."""

import json

import duckdb
import pytest

import check
import tamis
from tamis import intake
from tamis.operators import cleaning, crosscheck, metering
from tamis.operators.duplicates import duplicate_rows, row_digest
from tamis.operators.columns import columns_of
from tamis.plans.catalog import QUERIES, STATEMENTS
from tamis.sources import registry
from tamis.streaming.intake import refusals, watch

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(STATEMENTS[name])
    expected = check.rows_of([column[0] for column in cursor.description], cursor.fetchall())
    assert check.rows_of(frame.columns, frame.collect()) == expected


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (None, None)], "a int, b int")
    assert duplicate_rows(df).collect() == [(4, 1)]


def test_row_digest_separates_what_looks_alike(spark):
    rows = [("a,1:b", "c"), ("a", "b,1:c"), (None, "-"), ("-", None), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(row_digest(columns_of(df))).distinct().count() == len(rows)


def test_duplicates_of_wide_tables_of_texts_and_nested_cells(spark):
    df = spark.sql("SELECT 'x' a, 'y' b, repeat('z', 300) c, array(1, id % 2) d FROM range(6)")
    assert duplicate_rows(df).collect() == [(6, 4)]


def test_duplicated_people_multiply_facts_unless_deduplicated(spark):
    facts = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0)], "k int, m double")
    people = spark.createDataFrame([(1, "Data"), (1, "Data"), (2, " data ")], "id int, s string")
    by = [crosscheck.folded(people["s"])]
    arguments = {"key": "k", "dimension_key": "id", "measure": "m", "by": by}
    assert crosscheck.sum_by_attribute(facts, people, **arguments).collect() == [("data", 31.0, 5)]
    by[0] = crosscheck.folded(cleaning.quoted("s"))
    assert crosscheck.sum_by_attribute(facts, people, dedupe=True, **arguments).collect() == [("data", 16.0, 3)]


def test_orphans_and_coverage(spark):
    facts = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    people = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert crosscheck.orphan_keys(facts, people, key="k", dimension_key="id").collect() == [(9, 1)]
    assert crosscheck.key_coverage(facts, people, key="k", dimension_key="id").collect() == [(4, 2, 0.5)]


def test_cost_of_a_million_tokens(spark):
    usage = spark.createDataFrame([("a", "m", 1_000_000, 0), ("a", "?", 5, 5)], "agent string, model string, tokens_in bigint, tokens_out bigint")
    rates = spark.createDataFrame([("m", 3.0, 15.0)], metering.RATE_SCHEMA)
    costs = {row.model: row.cost_cents for row in metering.priced_usage(usage, rates).collect()}
    assert costs == {"m": 300.0, "?": 0.0}
    assert metering.rate_card_gaps(usage, rates).collect() == [("?",)]


def test_replay_uses_stored_values_and_skips_disabled_actions(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 20.0)], "k int, v double")
    action = cleaning.CleaningAction(0, cleaning.IMPUTE, "v", {"value": 42000.0})
    assert action.enabled
    assert [row.v for row in tamis.replay(df, [action]).sort("k").collect()] == [10.0, 42000.0, 20.0]
    off = cleaning.toggled([action], 0, False)
    assert tamis.replay(df, off).where("v is null").count() == 1
    assert tamis.rows_affected(df, [action]) == [(0, 1)]
    assert json.loads(cleaning.plan_table(spark, "f", [action]).head().params) == {"value": 42000.0}


def test_spellings_are_regrouped_by_shuffle_as_by_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["Data", "Data", "data", " DATA ", "Autre", None][i % 6]) for i in range(60)], "k int, s string")
    action = cleaning.regroup_spellings(df, "s")
    assert action.params["size"] == 2
    small = tamis.replay(df, [action]).sort("k").collect()
    assert {row.s for row in small} == {"Data", "Autre", None}
    monkeypatch.setattr(cleaning.attach, "__kwdefaults__", {**cleaning.attach.__kwdefaults__, "broadcast_rows": 0})
    assert tamis.replay(df, [action]).sort("k").collect() == small


def test_impossible_dates_are_left_as_they_are(spark):
    df = spark.createDataFrame([("31/12/2024",), ("2024-12-31",), ("31-12-2024",), ("31/02/2024",), ("x",), (None,)], "d string")
    cleaned = tamis.replay(df, [cleaning.CleaningAction(0, cleaning.DATES, "d")])
    assert [row.d for row in cleaned.collect()] == ["2024-12-31"] * 3 + ["31/02/2024", "x", None]


@pytest.fixture()
def store(tmp_path):
    return intake.Store(str(tmp_path / "store"))


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_intake_registers_each_file_once_and_masks_it_once(spark, tmp_path, store, kind):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "people.csv").write_text("email;montant;v\na@b.fr;1,5;1\nc@d.fr;2,5;2\na@b.fr;3,5;3\n")
    (drop / "bad.csv").write_text("a,b\n1,2,3\n")
    watch(spark, str(drop), store, "w").awaitTermination()
    watch(spark, str(drop), store, "w").awaitTermination()
    rows = registry.read(spark, store.registry)
    assert rows.count() == 1 and refusals(spark, store).count() == 1
    (listed,) = registry.listing(rows, "w").collect()
    assert (listed.name, listed.pii_status) == ("people.csv", "detectee")
    assert json.loads(registry.profile_of(rows, listed.id))["nb_lignes"] == 3

    result = intake.pseudonymise(spark, store, listed.id, kind=kind)
    assert (result["colonnes_masquees"], result["valeurs_masquees"]) == (["email"], 2)
    assert result["format"] == kind
    content = tamis.load(spark, result["path"]).sort("v").collect()
    assert [row.email for row in content] == ["email_001@masked.local", "email_002@masked.local", "email_001@masked.local"]
    assert store.tokens(spark).count() == spark.read.parquet(store.mappings).count() == 2
    assert "a@b.fr" not in result["profile"] and "a@b.fr" in (drop / "people.csv").read_text()
    with pytest.raises(tamis.Refused, match="déjà"):
        intake.pseudonymise(spark, store, listed.id)


def test_registry_refusals(spark, tmp_path, store):
    assert registry.read(spark, store.registry).count() == 0
    with pytest.raises(tamis.Refused, match="n'existe pas"):
        registry.find(registry.read(spark, store.registry), "absent")
    (tmp_path / "n.csv").write_text("a,b\n1,x\n2,y\n")
    row = intake.register(spark, store, "w", str(tmp_path / "n.csv"))
    assert row["pii_status"] == "aucune"
    with pytest.raises(tamis.Refused, match="rien à pseudonymiser"):
        intake.pseudonymise(spark, store, row["id"])
