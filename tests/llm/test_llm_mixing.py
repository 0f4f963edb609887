import hashlib
import math
import random

from tamis.llm import mixing

WHITE = " \t\n\x0b\f\r"


def words(text):
    return len((text or "").translate({ord(c): " " for c in WHITE}).split(" ")) - (text or "").translate({ord(c): " " for c in WHITE}).split(" ").count("") if text else 0


def brute(rows):
    """Targets by sharing again and again, then a walk over each source in key order."""
    sized = [(i, words(t), s) for i, t, _, s in rows]
    sources = sorted({s for _, _, s in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, opened = {}, float(sum(size.values())), list(sources)
    while opened:
        share = {s: left * weight[s] / sum(weight[x] for x in opened) for s in opened}
        over = [s for s in opened if share[s] >= 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        opened = [s for s in opened if s not in over]
    out = []
    for s in sources:
        budget, start = math.floor(target[s] + 1e-9) if size[s] else 0, 0
        own = sorted((hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n) for i, n, x in sized if x == s)
        rounds, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for _, has, i, n in own:
            out.append((i if has else None, n, size[s], round(target[s], 6), rounds * n + max(0, min(n, rest - start))))
            start += n
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=str)


def test_mix_equals_brute_force(docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), None, rng.choice(["a", "b", "hot", "hot", "hot", "é", "Z", None])) for i in range(300)]
    rows += [(None, "a b c", None, "a"), (5, "x\ty\x0bz w", None, "one"), (6, None, None, "empty"), (7, "", None, "empty"), rows[3], rows[3]]
    got = mixing.mix(docs(rows))
    assert result(got) == brute(rows)
    assert result(mixing.mix(docs(rows).repartition(7))) == result(got)
    assert all(r["taken"] <= 3 * r["size"] for r in got.collect())


def test_taken_words_are_the_whole_part_of_the_target(docs):
    rows = [(i, "w " * (i % 17), None, f"s{i % 4}") for i in range(200)]
    by = mixing.mix(docs(rows)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(r["sum(taken)"] == math.floor(r["max(target)"]) for r in by)


def test_empty_table(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs([(1, None, None, None)])).collect()] == [0]


def test_rows_that_share_an_id_are_placed_as_one(docs, monkeypatch):
    rng = random.Random(2)
    rows = [(None if k % 3 else k // 30, " ".join("w" for _ in range(rng.choice([0, 1, 1, 7]))), None, rng.choice("ab")) for k in range(2_000)]
    rows += [(None, "lone word", None, None)] * 40
    got = mixing.mix(docs(rows))
    assert got.count() == len(rows)
    # Which of equal rows is cut is open, so the rows of a key are compared by what they give together and each at most.
    def together(result):
        out = {}
        for i, n, size, target, taken in result:
            out.setdefault((str(i), n, size, target), []).append(taken)
        return {k: sorted(v) for k, v in out.items()}

    assert together(result(got)) == together(brute(rows))
    assert all(r["taken"] <= 3 * r["size"] for r in got.collect())


def test_many_equal_rows_are_dealt_out(spark):
    cut = spark.createDataFrame([(1, 3, 10), (None, 2, 1), (2, 5, 4), (3, 1, 9)], "doc_id long, size long, rows long")
    got = [(r["doc_id"], r["at"]) for r in mixing._row_by_row(cut, at_once=4).collect()]
    assert sorted(got, key=str) == sorted([(i, at) for i, _, n in [(1, 3, 10), (None, 2, 1), (2, 5, 4), (3, 1, 9)] for at in range(n)], key=str)
