import random
import re

import numpy as np

from tamis.llm import tiling


def brute_cover(doc, item, least):
    """Words of the item that greedy tiles cover, by comparing every pair of places."""
    least = min(least, len(item))
    used_doc, used_item, covered = set(), set(), 0
    while item:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and i + k not in used_item and d + k not in used_doc:
                    k += 1
                if k >= least and (-k, i, d) < (-best[0], best[1], best[2]):
                    best = (k, i, d)
        if not best[0]:
            return covered
        k, i, d = best
        used_item |= set(range(i, i + k))
        used_doc |= set(range(d, d + k))
        covered += k
    return 0


def split(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_coverage_equals_brute_force(spark, docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(15)] + [(90, None), (91, ""), (92, "Q, q! q. q q q q")]
    rows = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)[1] or ""
        cut = len(item.split()) // 2
        rows.append((k, " ".join(body[:20] + item.split()[cut:] + body[20:25] + item.split()[:cut] + body[25:])))
    rows += [(900, None), (901, ""), (902, "q q q q q q q q q"), rows[0], (None, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in tiling.overlaps(docs(rows), bench, seed=3).collect():
        got[r["doc_id"], r["item_id"]] = r["covered"]
    expected = {}
    for i, text in rows:
        for item, body in items:
            if cover := brute_cover(split(text), split(body), 3):
                expected[i, item] = cover
    assert got == expected


def test_reordered_passages_are_caught_and_clean_documents_are_left(spark, docs):
    first, second = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    bench = spark.createDataFrame([(1, f"{first} {second}"), (1, f"{first} {second}")], "item_id long, text string")
    rows = [(1, f"so {second}! and then {first.upper()} end"), (2, first[:20] + " nothing else"), (3, None)]
    got = {r["doc_id"]: (r["contaminated"], list(r["items"])) for r in tiling.contamination(docs(rows), bench).collect()}
    assert got == {1: (True, [1]), 2: (False, []), 3: (False, [])}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in tiling.contamination(docs(rows), empty).collect()] == [False] * 3
    assert tiling.contamination(docs([]), bench).count() == 0


def test_one_word_repeated_has_tiles_without_overlap():
    found = tiling.tiles(np.arange(50), np.full(50, 7), np.full(10, 7), 5)
    assert sum(n for _, _, n in found) == 14
