import random

import xxhash
from pyspark.sql import functions as F

from tamis.llm import simhash
from tamis.llm.components import components


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_equal_brute_force(docs, union):
    rng = random.Random(2)
    vocabulary = ["a", "B", "é", "cd", "e,f", " g"]
    base = [rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(400)]
    rows = [(10, " ".join(base)), (3, " ".join(base)), (4, "  ".join(base).upper()), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "one two"), (None, "x y z w")]
    for k in range(30):
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(400)] = "zz" + str(k)
        rows.append((100 + k, " ".join(near)))
    rows += [(200 + k, " ".join(rng.choice(vocabulary) for _ in range(k))) for k in range(20)]
    prints = [(i, brute_print(t)) for i, t in rows]
    nodes = union({p for _, p in prints})
    for a in nodes.up:
        for b in nodes.up:
            if (a ^ b).bit_count() <= 3:
                nodes.join(a, b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[nodes.find(p)] = min(i, least.get(nodes.find(p), i))
    expected = sorted(((i, f"{p:016x}", least.get(nodes.find(p))) for i, p in prints), key=str)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()]
    assert sorted(got, key=str) == expected


def test_links_find_all_pairs_at_distance_three(spark, union):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            other = base
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                other ^= 1 << bit
            values.add(other)
    values |= {0, 1 << 63, (1 << 64) - 1, 0b111, 0b1110000}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = union(signed)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                nodes.join(a, b)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "print long"))
    assert all(((r[0] ^ r[1]) & (1 << 64) - 1).bit_count() <= 3 for r in edges.collect())
    roots = dict(components(edges).collect())
    assert {v: roots.get(v, v) for v in signed} == {v: nodes.find(v) for v in signed}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 400)] + [(7, 7), (500, 499), (499, 500)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 400)} == {100} and got[500] == 499


def test_empty_table_and_long_text(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    text = "word " * 50_000 + "end"
    assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprints(docs([(1, text)])).select(F.col("print") != 0).first()[0]
