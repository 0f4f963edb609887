"""A grown table is profiled without its old files, with the same result as a whole profile."""

import json
import os

import pytest
from pyspark.sql import functions as F

import tamis
from tamis import intake
from tamis.operators import quantiles, state
from tamis.operators.profile import PEEK_ROWS
from tamis.sources import loader, registry


def profile_json(df, position):
    return json.loads(tamis.profile(df, order_by=[position], exclude=[position]).select(F.to_json(F.struct("*"))).head()[0])


def close(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(close, a, b))
    return a == pytest.approx(b, abs=0.011) if isinstance(a, float) else a == b


def add(folder, name, start, stop, header="id;mail;note;x;d", note="n{}"):
    folder.mkdir(exist_ok=True)
    names = header.split(";")
    lines = [header]
    for i in range(start, stop):
        cells = {"id": i, "mail": f"u{i % 7}@x.fr" if i % 5 else "", "note": note.format(i % 3) * (200 if i % 50 == 0 else 1), "x": f"{i % 40},5",
                 "d": "2024-01-02" if i % 2 else "02/01/2024"}
        lines.append(";".join(str(cells[n]) for n in names))
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture()
def store(tmp_path):
    return intake.Store(str(tmp_path / "store"))


def whole(spark, path):
    table = loader.load(spark, path, with_position=True)
    profiled, found = intake.examine(table, order_by=table.columns[-1])
    return json.loads(profiled["profile"]), found


def test_refreshes_equal_whole_profiles_and_read_new_files_only(spark, tmp_path, store):
    folder = tmp_path / "t.csv"
    add(folder, "1.csv", 0, PEEK_ROWS + 100)
    row = intake.register(spark, store, "w", str(folder))
    assert intake.refresh(spark, store, row["id"])["fichiers_lus"] == 1  # builds the state
    assert intake.refresh(spark, store, row["id"])["fichiers_lus"] == 0
    add(folder, "2.csv", 250, 500, header="x;d;id;mail;note")
    add(folder, "0.csv", 900, 950)  # comes first in the order of files
    new = intake.refresh(spark, store, row["id"])
    expected, _ = whole(spark, str(folder))
    assert new["fichiers_lus"] == 2 and close(json.loads(new["profile"]), expected)
    assert new["version"] == 4 and expected["nb_lignes"] == 600 and new["pii_status"] == "detectee"
    # A column of numbers becomes one of text: all files are read.
    add(folder, "3.csv", 600, 620)
    (folder / "3.csv").write_text((folder / "3.csv").read_text().replace(",5;", ",5 kg;"))
    new = intake.refresh(spark, store, row["id"])
    assert new["fichiers_lus"] == 4 and close(json.loads(new["profile"]), whole(spark, str(folder))[0])
    # A file that was changed, too.
    add(folder, "2.csv", 0, 10)
    os.utime(folder / "2.csv", (1, 1))
    new = intake.refresh(spark, store, row["id"])
    assert new["fichiers_lus"] == 4 and close(json.loads(new["profile"]), whole(spark, str(folder))[0])
    (folder / "4.csv").write_text("other;columns\n1;2\n")
    with pytest.raises(tamis.Refused, match="colonnes"):
        intake.refresh(spark, store, row["id"])


def test_parquet_tables_of_all_families(spark, tmp_path, store):
    table = spark.range(3000).selectExpr(
        "id", "cast(id % 100 as decimal(9,2)) / 4 as dec", "if(id % 9 = 0, double('NaN'), id / 7.0d) as real", "id % 2 = 0 as flag",
        "date_add(date'2024-01-01', cast(id % 30 as int)) as day", "if(id % 4 = 0, null, concat('v', id % 11)) as txt", "array(id % 3) as nest",
        "cast(id % 2 as int) as bin",
    )
    path = str(tmp_path / "t.parquet")
    table.where("id < 2000").coalesce(1).write.parquet(path)
    row = intake.register(spark, store, "w", path)
    intake.refresh(spark, store, row["id"])
    table.where("id >= 1500").repartition(2).write.mode("append").parquet(path)
    new = intake.refresh(spark, store, row["id"])
    assert new["fichiers_lus"] == 2 and close(json.loads(new["profile"]), whole(spark, path)[0])


def test_quartiles_of_counted_values_are_exact_on_either_way(spark):
    df = spark.range(30_000).select(((F.col("id") * 7919) % 1000 / 8.0).alias("x"), F.struct("id").alias("p"))
    kept = state.of(df.where("p.id < 10000"), "p").merged(state.of(df.where("p.id >= 10000"), "p"))
    numbers = kept.tables["valeurs-real-0"].where("n > 0").select("c", "v", "n")
    measured = state._number_branch(kept, ("statistics", "outliers"))
    sketched = quantiles.cuts_of(kept.tables["croquis"].withColumn("renseignees", F.lit(30_000))).collect()
    narrowed = quantiles.exact_quartiles(numbers, sketched, small=10).collect()[0]
    plain = df.agg(F.percentile("x", [0.25, 0.5, 0.75]), F.avg("x"), F.stddev_pop("x")).head()
    assert [narrowed[n] for n in quantiles.NAMES] == plain[0]
    told = {k: v for row in measured for k, v in row.asDict().items()}
    assert [told[n] for n in quantiles.NAMES] == plain[0] and told["moyenne"] == pytest.approx(plain[1]) and told["ecart_type"] == pytest.approx(plain[2])
    with pytest.raises(ValueError):
        kept.merged(state.of(df.withColumn("y", F.lit(1)), "p"))


def test_of_two_refreshes_one_is_refused(spark, tmp_path, store, monkeypatch):
    add(tmp_path / "t.csv", "1.csv", 0, 20)
    row = intake.register(spark, store, "w", str(tmp_path / "t.csv"))
    commit = registry.commit

    def overtaken(*arguments, **named):
        monkeypatch.setattr(registry, "commit", commit)
        intake.refresh(spark, store, row["id"])
        return commit(*arguments, **named)

    monkeypatch.setattr(registry, "commit", overtaken)
    with pytest.raises(tamis.Refused, match="entre-temps"):
        intake.refresh(spark, store, row["id"])
    assert registry.find(registry.read(spark, store.registry), row["id"])["version"] == 2


def test_examples_are_ranked_among_few_cells(spark):
    # Values at the start, across runs of rows and only at the end; two splits, of which the second comes first in order.
    place = "named_struct('fichier', IF(id < 5000, 'b', 'a'), 'bloc', 0L, 'rang', id) AS p"
    df = spark.range(0, 10000, 1, 2).selectExpr("IF(id % 3 = 0, NULL, id) AS x", "IF(id IN (4999, 6023, 6024, 9999), concat(' t ', id), NULL) AS y", "CAST(NULL AS STRING) AS z", place)
    found = state.of(df, "p").tables["exemples"]
    rows = sorted((row["c"], (row["place"]["fichier"], row["place"]["rang"]), row["v"]) for row in found.collect())
    assert rows == [
        (0, ("a", 5000), "5000"), (0, ("a", 5002), "5002"), (0, ("a", 5003), "5003"),
        (1, ("a", 6023), "t 6023"), (1, ("a", 6024), "t 6024"), (1, ("a", 9999), "t 9999"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan  # what is sorted was picked before
