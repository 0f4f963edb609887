import hashlib
from collections import defaultdict

import pytest

from tamis.llm import exact


def brute(rows, keep):
    """(doc_id, keep_id, group_size, sha256) of each row, and how many rows stay in each group."""
    groups = defaultdict(list)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = None if not known else min(known) if keep == "smallest" else max(known)
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def told(found):
    rows = found.collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str), rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan,slice_rows", [(4, 1 << 20), (2, 8), (3, 20)])
def test_groups_equal_brute_force_for_any_cube(spark, docs, keep, fan, slice_rows):
    rows = [(i, ["One text", "one TEXT", "Ünlike", "ünlike", "", None, "x" * 100_000][i % 7] + str(i % 3) if i % 7 not in (4, 5) else ["", None][i % 2])
            for i in range(150)]
    found = exact.classes(docs(rows).repartition(7), keep=keep, fan=fan, slice_rows=slice_rows)
    expected, groups = brute(rows, keep)
    got, whole = told(found)
    assert got == expected
    assert sum(r.kept for r in whole) == groups
    assert all(r.kept == (r.doc_id == r.keep_id) for r in whole)


def test_missing_ids_repeated_rows_and_ids(spark, docs):
    rows = [(None, "a"), (None, "A"), (3, "b"), (3, "B"), (None, "b"), (5, "c"), (5, "d"), (7, None), (8, "")]
    for keep in ("smallest", "largest"):
        got, whole = told(exact.classes(docs(rows), keep=keep))
        assert got == brute(rows, keep)[0]
        assert sum(r.kept for r in whole) == 5  # one of each group, however its rows are named
        assert [r.doc_id for r in whole if r.kept and r.group_size == 3] == [3]


def test_one_text_holding_most_rows_is_one_entry_a_run(spark, docs):
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(600)]
    table = docs(rows).repartition(9).selectExpr(
        "unhex(sha2(text, 256)) digest", "xxhash64(text) check", "cast(octet_length(text) as long) n_bytes",
        "true found", "doc_id id", "doc_id row",
    )
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.schema), "n long", "place int"])
    runs = table.mapInArrow(exact._sorted_runs(4, "smallest"), schema).collect()
    hot = [r for r in runs if r.n > 1]
    assert sum(r.n for r in runs) == 600 and len(runs) == 200 + len(hot) and len(hot) <= 9
    groups = [r for r in exact.classes(docs(rows)).collect() if r.group_size > 1]
    assert {(r.keep_id, r.group_size) for r in groups} == {(1, 400)} and sum(r.kept for r in groups) == 1


def test_named_rows_other_ids_and_empty_tables(spark, docs):
    named = spark.createDataFrame([("b", "T", 11), ("a", "t", 12), ("c", "u", 13)], "name string, body string, at long")
    found = exact.classes(named, id_column="name", text_column="body", row_column="at").collect()
    assert {(r.doc_id, r.row, r.keep_id, r.kept) for r in found} == {("b", 11, "a", False), ("a", 12, "a", True), ("c", 13, "c", True)}
    assert exact.classes(docs([])).collect() == []
    with pytest.raises(ValueError):
        exact.classes(named, keep="any")
