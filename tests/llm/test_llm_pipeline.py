"""Each stage of the pipeline against plain Python, on a small table."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import secrets, simhash

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def make(rng):
    syllables = ["an", "the", "er", "on", "ti"]
    body = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))
    rows = [(k, body(rng.randint(60, 90)), "en", f"s{k % 3}") for k in range(40)]
    rows += [(k, rows[k - 100][1], "en", "s0") for k in range(100, 110)]
    rows += [(200, body(10), "en", "s1"), (201, None, None, None), (202, "", "en", "s1"), (203, "und " * 100, "de", "s1"), (None, body(70), "en", "s2")]
    rows += [rows[5], (300, body(60) + " password=abcdef123 " + body(10), "en", "s2")]
    return rows


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_equal_brute_force(spark, docs, folder):
    rows = make(random.Random(12)) + [(400, "so Alpha beta gamma, delta epsilon zeta eta theta. " + "x y z " * 30, "en", "s1")]
    table = docs(rows)
    kept = STAGES["quality_rules"](spark, table, folder)
    assert kept.columns == table.columns and not {200, 201, 202, 203} & set(ids(kept)) and len(ids(kept)) >= 45

    single = STAGES["near_duplicates"](spark, table, folder)
    prints = [(i, simhash.fingerprint(t)) for i, t, _, _ in rows]
    near = lambda a, b: (a ^ b).bit_count() <= 3
    groups = []
    for i, p in prints:
        met = [g for g in groups if any(near(p, q) for _, q in g)]
        groups = [g for g in groups if g not in met] + [sum(met, [(i, p)])]
    least = [min((i for i, _ in g if i is not None), default=None) for g in groups]
    assert single.columns == table.columns and len(ids(single)) == len(groups)
    assert [i for i in ids(single) if i is not None] == sorted(i for i in least if i is not None) or ids(single).count(None)

    clean = STAGES["decontamination"](spark, table, folder)
    assert clean.columns == table.columns and ids(clean) == sorted((i for i, *_ in rows if i != 400), key=str)

    safe = STAGES["secret_scan"](spark, table, folder)
    texts = sorted((str(r["text"]) for r in safe.collect()))
    assert safe.columns == table.columns and texts == sorted(str(secrets.redacted(t)) for _, t, _, _ in rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in safe.collect())

    mixed = STAGES["source_mix"](spark, table, folder)
    assert mixed.columns[: len(table.columns)] == table.columns
    assert mixed.where(F.col(mixed.columns[-1]) <= 0).count() == 0
    # A document that the budget cuts has its first words only, and as many as it counts for.
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for r in mixed.collect():
        assert len(words(r["text"])) == r[mixed.columns[-1]] and any((t or "").startswith(r["text"]) for _, t, *_ in rows)


def test_the_cut_keeps_white_space_and_counts_match_the_targets(spark, docs, folder):
    from tamis.llm import mixing

    table = docs([(i, f" a{i}\t\tb c\n\nd  " * (1 + i % 3), "en", ("s", "t", None)[i % 3], -1) for i in range(40)])
    mixed = dict(corpus_pipeline.STAGES)["source_mix"](spark, table, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    targets = {r["source"]: int(r["target"]) for r in mixing.mix(table).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        assert sum(r["words_taken"] for r in mixed if r["source"] == source) == target
    cut = [r for r in mixed if r["text"] != texts[r["doc_id"]]]
    assert 1 <= len(cut) <= 3
    for r in cut:
        assert texts[r["doc_id"]].startswith(r["text"]) and len(r["text"].split()) == r["words_taken"] and r["n_chars"] == len(r["text"])
    assert all(r["n_chars"] == -1 for r in mixed if r not in cut)


def test_empty_tables(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), folder).count() == 0, name


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "epoch", "words_taken"} == set(out.columns)
    assert not [r for r in out.collect() if [k for *_, k in secrets.spans_of(r["text"]) if k in ("assign", "access")]]
