"""Labels, measures, anomalies and the score, on small tables worked out by hand."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tamis import context, profile
from tamis.functions import text
from tamis.operators import spread
from tamis.operators.profile import measure


def profiled(df, **options):
    return json.loads(profile(df, **options).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).head()[0])


def column(found, name):
    return next(entry for entry in found["colonnes"] if entry["nom"] == name)


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*columns.values()))
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean", Decimal: "decimal(20,2)"}
    types = [next(kinds[type(v)] for v in columns[name] + [""] if v is not None) for name in names]
    schema = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in zip(names, types))
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.fixture(scope="module")
def dirty(spark):
    n = 40
    return frame(
        spark,
        id=[f"C{i:04d}" for i in range(n)],
        email=[f"u{i % 30}@x.fr" for i in range(n)],
        service=[[" Data ", "data", "DATA", "Finance"][i % 4] for i in range(n)],
        date=[["2024-01-05", "05/01/2024", "05-01-2024"][i % 3] for i in range(n)],
        age=[i % 20 for i in range(n)],
        note=[1.5 + i % 7 for i in range(n)],
        parti=[i % 2 for i in range(n)],
        salaire=[None if i % 10 == 0 else (900.0 if i == 7 else 40.0 + i % 9) for i in range(n)],
        reponse=[["Oui", "non", None, " OUI "][i % 4] for i in range(n)],
        vide=[None] * (n - 1) + ["x"],
        entiers_decimaux=[float(i % 11) for i in range(n)],
        exact=[Decimal("1.25") * (i % 5) for i in range(n)],
        vrai=[bool(i % 2) for i in range(n)],
    )


@pytest.fixture(scope="module")
def found(dirty):
    return profiled(dirty)


@pytest.mark.parametrize(("name", "label"), [
    ("id", "identifiant"), ("email", "texte"), ("service", "catégorie"), ("date", "date"), ("age", "entier"),
    ("note", "décimal"), ("parti", "booléen"), ("salaire", "entier"), ("reponse", "booléen"),
    ("vide", "identifiant"), ("entiers_decimaux", "entier"), ("exact", "décimal"), ("vrai", "booléen"),
])
def test_labels(found, name, label):
    assert column(found, name)["type"] == label


def test_email_with_repeats_is_not_an_identifier(spark):
    repeats = frame(spark, email=[f"u{i % 88}@x.fr" for i in range(100)])
    assert column(profiled(repeats), "email")["type"] == "texte"


def test_counts(found):
    salaire = column(found, "salaire")
    assert (salaire["valeurs_manquantes"], salaire["part_manquantes"], salaire["cardinalite"]) == (4, 0.1, 10)
    assert found["nb_lignes"] == 40 and found["nb_colonnes"] == 13


def test_anomalies(found):
    kinds = {entry["nom"]: [(a["type"], a["detail"]) for a in entry["anomalies"]] for entry in found["colonnes"]}
    assert kinds["date"] == [("formats_multiples", "3 écritures de date coexistent dans la colonne.")]
    assert kinds["service"] == [
        ("modalites_variantes", "2 modalité(s) ne diffèrent que par la casse ou les espaces.")]
    assert kinds["salaire"] == [("valeurs_extremes", "1 valeur(s) très éloignée(s) du reste de la colonne.")]
    assert kinds["id"] == kinds["reponse"] == kinds["vrai"] == []


def test_numeric_statistics_match_pandas(dirty, found):
    values = dirty.select("salaire").toPandas()["salaire"].dropna()
    assert column(found, "salaire")["statistiques"] == {
        "minimum": values.min(), "maximum": values.max(), "moyenne": round(values.mean(), 2),
        "mediane": values.median(), "ecart_type": round(values.std(ddof=0), 2), "modalites_frequentes": None,
    }


def test_top_values_are_ordered_and_bounded(found):
    top = column(found, "service")["statistiques"]["modalites_frequentes"]
    assert [t["valeur"] for t in top] == ["Data", "DATA", "Finance", "data"]
    assert {t["occurrences"] for t in top} == {10}


def test_clean_column_has_no_anomaly(spark):
    assert column(profiled(frame(spark, note=[10, 11, 12, 11, 10, 12, 11])), "note")["anomalies"] == []


def test_clean_table_scores_100(spark):
    whole = profiled(frame(spark, a=[1, 2, 3, 4], b=["x", "y", "z", "w"]))
    assert whole["score_qualite"] == 100.0 and whole["explication_qualite"] == []


def test_score_is_explained(spark):
    whole = profiled(frame(spark, a=["x", None, None, None, "x"], b=[1, 2, 3, 4, 1]))
    assert whole["doublons"] == {"nombre": 1, "part": 0.2}
    assert [(p["critere"], p["impact"]) for p in whole["explication_qualite"]] == [
        ("Valeurs manquantes", -12.0), ("Lignes en double", -6.0), ("Colonnes quasi vides", -10.0),
        ("Colonnes sans variation", -5.0)]
    assert whole["score_qualite"] == 67.0


def test_an_empty_column_is_text(spark):
    whole = profiled(frame(spark, a=[1, 2], b=[None, None]))
    assert (column(whole, "b")["type"], column(whole, "b")["cardinalite"]) == ("texte", 0)
    assert column(whole, "b")["statistiques"] is None


def test_examples_are_bounded_and_on_one_line(spark):
    examples = column(profiled(frame(spark, long=["x" * 300, "a\nb\tc", "court"])), "long")["exemples"]
    assert examples == ["x" * 79 + "…", "a b c", "court"]


def test_examples_of_a_sparse_column_are_exact(spark):
    sparse = frame(spark, k=list(range(1000)), v=[str(i) if i in (700, 800, 900, 950) else None for i in range(1000)])
    assert column(profiled(sparse, order_by=["k"]), "v")["exemples"] == ["700", "800", "900"]
    assert column(profiled(sparse.repartition(7), order_by=["k"]), "v")["exemples"] == ["700", "800", "900"]


def test_long_texts_are_counted_like_any_other(spark):
    base = "mot " * 400
    texts = [base + "A", base + "a", " " + base + "A", base + "b", "court", "Court", "a@" + "x" * 600 + ".fr"]
    whole = column(profiled(frame(spark, t=texts * 4)), "t")
    assert whole["cardinalite"] == 7
    assert whole["anomalies"][0]["detail"].startswith("3 modalité(s)")
    top = whole["statistiques"]["modalites_frequentes"]
    assert {t["occurrences"] for t in top} == {4} and max(len(t["valeur"]) for t in top) == 80


def test_large_tables_take_the_same_path_without_cache(spark, dirty, found, monkeypatch):
    monkeypatch.setattr(spread, "SMALL_BYTES", 0)
    monkeypatch.setattr(spread.is_small, "__defaults__", (0,))
    assert profiled(dirty) == found


def test_profile_does_not_depend_on_partitions(dirty, found):
    moved = profiled(dirty.repartition(9))
    for left, right in zip(moved["colonnes"], found["colonnes"]):
        assert {**left, "exemples": None} == {**right, "exemples": None}
    assert moved["score_qualite"] == found["score_qualite"]


def test_wide_tables_are_melted_in_chunks(spark):
    wide = frame(spark, **{f"c{i}": [i, i + 1, i] for i in range(70)})
    whole = profiled(wide)
    assert len(whole["colonnes"]) == 70 and whole["doublons"]["nombre"] == 1
    assert {entry["cardinalite"] for entry in whole["colonnes"]} == {2}


def test_nan_is_missing(spark):
    whole = profiled(frame(spark, x=[1.0, float("nan"), 2.5, None]))
    assert column(whole, "x")["valeurs_manquantes"] == 2


def test_context_carries_no_rows_and_can_withhold_columns(dirty):
    whole = profile(dirty)
    compact = json.loads(context(whole, redact=["email"]).select(F.to_json(F.struct("*"))).head()[0])
    assert set(compact) == {"nb_lignes", "colonnes"}
    for entry in compact["colonnes"]:
        assert set(entry) <= {"nom", "type", "cardinalite", "part_manquantes", "exemples", "statistiques"}
        assert len(entry["exemples"]) <= 3
    assert "u1@x.fr" not in json.dumps(compact)


def test_names_with_dots_and_backquotes(spark):
    odd = frame(spark, **{"a.b": [1, 2], "c`d": ["x", "y"]})
    assert [entry["nom"] for entry in profiled(odd)["colonnes"]] == ["a.b", "c`d"]


@pytest.mark.parametrize("value", [
    "a" * 80, "a" * 81, " a" * 40, " a" * 41, "  a  " * 50, "b" * 79 + " \t" + "c", "b" * 80 + "   ", "   ", "",
    "x" * 40 + " " * 500 + "y" * 39, "x" * 40 + " " * 500 + "y" * 40,
])
def test_shown_form_depends_on_the_whole_text(spark, value):
    import re

    line = re.sub(r"\s+", " ", value).strip()
    expected = line if len(line) <= 80 else line[:79] + "…"
    df = frame(spark, v=[value])
    assert df.select(text.shown(df["v"])).head()[0] == expected


@pytest.mark.parametrize("copies", [1, 3])
def test_ties_of_long_texts_are_listed_in_order_of_the_whole_text(spark, copies):
    # Blanks are not displayed, so that what follows the common start is.
    long = [" " * 300 + f"{k:02d}" + "x" * 300 for k in range(40)]
    mixed = long[8:] + [" " * 300 + f"{k:02d}" for k in range(0, 16, 2)] + [" " * 600 + "last", " " * 257 + "z", " " * 255 + "y"]
    for values in (long, mixed, [*mixed, "!", "first" * 200]):
        table = frame(spark, v=values * copies, w=list(range(len(values) * copies))).repartition(4)
        counted = measure(table, wanted=("top_values",)).where("nom = 'v'").head()
        listed = [(m["valeur"], m["occurrences"]) for m in counted["modalites"]]
        short = [" ".join(v.split()) for v in sorted(values)[:5]]
        assert listed == [(v if len(v) <= 80 else v[:79] + "…", copies) for v in short]


def test_ties_behind_more_frequent_values_keep_their_places(spark):
    values = ["often"] * 5 + [" " * 300 + f"{k}" + "x" * 300 for k in (3, 1, 2, 4)] * 2 + ["once", "Twice", "Twice"]
    counted = measure(frame(spark, v=values), wanted=("top_values",)).where("nom = 'v'").head()
    assert [(m["valeur"][:5], m["occurrences"]) for m in counted["modalites"]] == [
        ("often", 5), ("1xxxx", 2), ("2xxxx", 2), ("3xxxx", 2), ("4xxxx", 2)
    ]
