"""Reading must never damage an identity column."""

import pytest

from tamis import Refused, load
from tamis.sources import loader


def table(spark, tmp_path, content, name="t.csv", **options):
    file = tmp_path / name
    file.write_text(content, encoding="utf-8")
    return load(spark, str(file), **options)


def values(df, column):
    return [row[0] for row in df.select(f"`{column}`").collect()]


def test_plus_and_leading_zeros_survive(spark, tmp_path):
    df = table(spark, tmp_path, "tel,nir\n+33617025658,0123456789012\n+33612345678,0987654321098\n")
    assert values(df, "tel") == ["+33617025658", "+33612345678"]
    assert values(df, "nir") == ["0123456789012", "0987654321098"]


def test_true_numbers_are_converted(spark, tmp_path):
    df = table(spark, tmp_path, "salaire\n42000\n38500\n51000\n")
    assert dict(df.dtypes)["salaire"] == "bigint"
    assert sum(values(df, "salaire")) == 131_500


def test_french_export(spark, tmp_path):
    df = table(spark, tmp_path, "nom;montant\nDupont;1234,56\nMartin;78,90\n")
    assert df.columns == ["nom", "montant"]
    assert values(df, "montant") == [1234.56, 78.90]


def test_mixed_column_stays_text(spark, tmp_path):
    assert values(table(spark, tmp_path, "reference\nA12\n34\nB56\n"), "reference") == ["A12", "34", "B56"]


@pytest.mark.parametrize("cells", [["-012", "5"], ["12345678901234567890", "1"], ["+5", "6"]])
def test_what_a_number_cannot_hold_stays_text(spark, tmp_path, cells):
    assert values(table(spark, tmp_path, "x\n" + "\n".join(cells) + "\n"), "x") == cells


def test_integers_with_missing_values_stay_integers(spark, tmp_path):
    df = table(spark, tmp_path, "a,b\n41500,x\nNA,y\n,z\nnull,t\n")
    assert dict(df.dtypes)["a"] == "bigint"
    assert values(df, "a") == [41500, None, None, None]


def test_missing_tokens_are_matched_before_trimming(spark, tmp_path):
    df = table(spark, tmp_path, "a,b\n NA,1\nN/A,2\nrien,3\n")
    assert values(df, "a") == [" NA", None, "rien"]


def test_quotes_and_line_ends_inside_cells(spark, tmp_path):
    df = table(spark, tmp_path, 'a,b\n"un ""mot""",1\n"deux\nlignes",2\n')
    assert values(df, "a") == ['un "mot"', "deux\nlignes"]


def test_large_files_are_split_only_if_no_cell_crosses_a_line(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        plain = "a,b\n" + "".join(f'"x ""{i}""",{i}\n' for i in range(40))
        df = table(spark, tmp_path, plain, name="plain.csv")
        assert df.count() == 40 and df.rdd.getNumPartitions() > 1
        crossing = "a,b\n" + "".join(f'"x\n{i}",{i}\n' for i in range(40))
        df = table(spark, tmp_path, crossing, name="crossing.csv")
        assert sorted(values(df, "b")) == list(range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")


def test_split_size_is_read_whatever_its_unit():
    assert loader.size_in_bytes("128MB") == loader.size_in_bytes("134217728b") == loader.size_in_bytes("134217728")


def test_headers_are_repaired(spark, tmp_path):
    assert table(spark, tmp_path, "nom,nom,,nom\n1,2,3,4\n").columns == ["nom", "nom.1", "Unnamed: 2", "nom.2"]
    assert loader.repair_header(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]


def test_short_records_are_padded_and_long_ones_refused(spark, tmp_path):
    assert values(table(spark, tmp_path, "a,b\n1,2\n6\n"), "b") == [2, None]
    for record in ("3,4,5", "7,,9"):
        with pytest.raises(Refused):
            table(spark, tmp_path, f"a,b\n1,2\n{record}\n")


@pytest.mark.parametrize(("content", "separator"), [
    ("a;b\n1;2\n3;4\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n1|2\n3|4\n", "|"), ("n\n100\n200\n300\n", ","),
])
def test_separators(spark, tmp_path, content, separator):
    file = tmp_path / "s.csv"
    file.write_text(content)
    assert loader.detect_separator(spark, str(file)) == separator


def test_admission(spark, tmp_path):
    with pytest.raises(Refused, match="extension"):
        table(spark, tmp_path, "{}", name="t.json")
    with pytest.raises(Refused, match="vide"):
        table(spark, tmp_path, "")
    with pytest.raises(Refused, match="Aucune ligne"):
        table(spark, tmp_path, "a,b\n")
    with pytest.raises(Refused, match="lignes"):
        table(spark, tmp_path, "a\n1\n2\n3\n", max_rows=2)
    with pytest.raises(Refused, match="octets"):
        table(spark, tmp_path, "a\n1\n2\n3\n", max_bytes=3)


def test_text_reading_keeps_every_cell(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text("a,b\n1,2\n")
    assert loader.read_text(spark, str(file)).collect() == [("1", "2")]
