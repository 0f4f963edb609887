"""Quoted files of many splits, and folders of many files."""

import csv
import io
import random

import pytest

import tamis
from tamis.plans import catalog
from tamis.sources import loader, records

SPLIT = "spark.sql.files.maxPartitionBytes"
CELLS = ["a", "", "x;y", "x,y", "l1\nl2", 'say "hi"', '5" pipe', "é\r\nü", '\n\n\n"\n', 'z"z,', '"', '""', "\n", " NA ", "日本\n語"]


@pytest.fixture()
def small_splits(spark):
    usual = spark.conf.get(SPLIT)
    yield lambda size: spark.conf.set(SPLIT, str(size))
    spark.conf.set(SPLIT, usual)


def write(folder, name, rows, line_end="\n", extra=""):
    folder.mkdir(exist_ok=True)
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=line_end).writerows(rows)
    (folder / name).write_bytes((out.getvalue() + extra).encode())


def parsed(texts):
    return [next(csv.reader(io.StringIO(text, newline="")), []) for text in texts]


@pytest.mark.parametrize("size", [40, 333, 5000])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_records_are_those_of_a_whole_reading(spark, tmp_path, small_splits, size, line_end):
    rng = random.Random(size)
    rows = [["p", "q\nr", "s"]] + [[rng.choice(CELLS) for _ in range(3)] for _ in range(250)]
    # Quotes outside quoted cells are text, and do not open anything.
    write(tmp_path / "t.csv", "0.csv", rows, line_end, f'5" pipe,6,7 "x{line_end}a "b" c,d"e,f"{line_end}')
    rows += [['5" pipe', "6", '7 "x'], ['a "b" c', 'd"e', 'f"']]
    small_splits(size)
    found = records.records(spark, str(tmp_path / "t.csv"), ",").orderBy("fichier", "bloc", "rang").collect()
    assert parsed(r.enregistrement for r in found) == rows
    assert [r.entete for r in found] == [True] + [False] * (len(rows) - 1)
    assert size == 5000 or len({r.bloc for r in found}) > 10


def test_one_cell_over_many_blocks_and_blank_blocks(spark, tmp_path, small_splits):
    rows = [["a", "b"], ["x" * 30 + "\n" * 500 + "y", "1"], ["z", "2"], ["end\n" * 200, "3"]]
    write(tmp_path / "t.csv", "0.csv", rows)
    (tmp_path / "t.csv/1.csv").write_bytes(b"\xef\xbb\xbf\n\n\n" + b"\n" * 300 + b'b,a\n4,"q\nq"\n')
    small_splits(64)
    found = records.records(spark, str(tmp_path / "t.csv"), ",").orderBy("fichier", "bloc", "rang").collect()
    assert parsed(r.enregistrement for r in found) == rows + [["b", "a"], ["4", "q\nq"]]
    table = tamis.load(spark, str(tmp_path / "t.csv"), with_position=True)
    assert [tuple(r)[:2] for r in table.orderBy("_position").collect()] == [(*r[:1], int(r[1])) for r in rows[1:]] + [("q\nq", 4)]
    assert table.rdd.getNumPartitions() > 1


def test_large_quoted_files_are_read_as_small_ones(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for name, header in (("0.csv", ["p", "q", "n"]), ("1.csv", ["n", "p", "q"]), ("2.csv", ["p", "q", "n"])):
        rows = [{"p": rng.choice(CELLS), "q": rng.choice(CELLS), "n": str(rng.randrange(99))} for _ in range(80)]
        write(tmp_path / "t.csv", name, [header] + [[row[h] for h in header] for row in rows])
    read = lambda: sorted(map(str, loader.load(spark, str(tmp_path / "t.csv")).collect()))
    whole = read()
    small_splits(100)
    assert read() == whole and len(whole) > 200
    (tmp_path / "t.csv/3.csv").write_text('p,q,n\n"a\nb",c,1,2\n')
    with pytest.raises(tamis.Refused):
        loader.load(spark, str(tmp_path / "t.csv"))


def test_a_cell_that_is_never_closed_ends_with_its_file(spark, tmp_path, small_splits):
    write(tmp_path / "t.csv", "0.csv", [["a", "b"], ["x", "y"]], extra='u,"v\nw,1\n' + "k,l\n" * 50)
    write(tmp_path / "t.csv", "1.csv", [["a", "b"], ["m\nm", "n"]])
    small_splits(50)
    rows = loader.load(spark, str(tmp_path / "t.csv")).collect()
    assert {r.a for r in rows} == {"x", "u", "m\nm"} and {r.b for r in rows if r.a != "u"} == {"y", "n"}


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_number_of_jobs_does_not_follow_the_number_of_files(spark, tmp_path):
    counts = {}
    for n in (3, 300):
        for i in range(n):
            write(tmp_path / f"t{n}.csv", f"{i}.csv", [["a", "b"], [str(i), "x"]] if i % 2 else [["b", "a"], ["x", str(i)]])
        load = lambda: sorted(r.a for r in loader.load(spark, str(tmp_path / f"t{n}.csv")).collect())
        assert load() == list(range(n))
        counts[n] = jobs(spark, f"files-{n}", load)
    assert counts[300] <= counts[3] + 2


def test_lines_that_end_in_a_carriage_return_alone(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"a;b\r1;x\r2;y\r")
    assert [tuple(r) for r in loader.load(spark, str(tmp_path / "m.csv")).collect()] == [(1, "x"), (2, "y")]


@pytest.mark.parametrize(("sample", "separator"), [
    ("nom;montant\nDupont;1234,56\nMartin;78,90\n", ";"), ('"a,b",c\n"d,e,f",g\n', ","), ("x\n", ","), ("", ","),
    ("a|b;c|d\n1|2;3|4\n5|6|7\n", "|"), ("t\tu\n1,5\t2,5\n", "\t"),
])
def test_the_separator_cuts_most_evenly(sample, separator):
    assert loader.separator_of(sample) == separator


def test_splits_of_quoted_texts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    text = "repeat('a \"b\"\n', 200) AS text"
    documents = spark.range(6000).selectExpr("id AS doc_id", text, "'fr' AS lang", "'s' AS source", "1200L AS n_chars")
    documents.write.parquet(f"{tmp_path}/documents.parquet")  # some 10 MB as text, 150 splits of 64 KB
    seen, usual = [], spark.conf.get(SPLIT)
    monkeypatch.setattr(catalog.loader, "load", lambda spark, path: seen.append(spark.read.text(path).rdd.getNumPartitions()) or spark.range(1))
    catalog.csv_quoted_split(spark, str(tmp_path))
    assert 10 < seen[0] <= 70 and spark.conf.get(SPLIT) == usual
    assert [catalog._split_bytes(total, 128 * 1024**2) for total in (10**6, 6 * 10**9)] == [64 * 1024, 32 * 1024**2]
    assert catalog._split_bytes(6 * 10**9, 16 * 1024**2) == 16 * 1024**2
