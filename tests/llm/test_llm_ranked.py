import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, most):
    """Every (item, rank, doc, score), by scoring every document for every item."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, ((doc, c), n) in enumerate(zip(counts, sizes)):
            score = 0
            for t in set(terms(text)) & set(c):
                m = 100 - 50 + 50 * n * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at, doc))
        out += [(item, rank + 1, s[-1], -s[0]) for rank, s in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


def queries(spark, items):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, query int, rank int, row int")


def told(found):
    return sorted([(r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect()], key=str)


def corpus(rng, size, words):
    weights = [1 / (w + 1) for w in range(words)]
    return [(i, " ".join(f"w{w}" for w in rng.choices(range(words), weights, k=rng.randint(0, 60)))) for i in range(size)]


@pytest.mark.parametrize("shard_postings,pass_terms,first_share", [(1 << 21, 1 << 19, 16), (300, 20, 3)])
def test_result_equals_scoring_everything(spark, docs, shard_postings, pass_terms, first_share):
    rng = random.Random(3)
    rows = corpus(rng, 400, 200)
    items = [(i, " ".join(f"w{rng.randrange(220)}" for _ in range(rng.randint(1, 30)))) for i in range(15)]
    found = ranked.search(
        docs(rows).repartition(5), queries(spark, items), most=7, shard_postings=shard_postings, pass_terms=pass_terms, first_share=first_share
    )
    assert told(found) == brute(rows, items, 7)


def test_terms_marks_ties_and_odd_rows(spark, docs):
    rows = [
        (1, "Straße STRASSE straße"), (2, "don't stop-me_now 42"), (3, None), (4, ""), (5, "... --- !!"), (6, "same text here"), (6, "same text here"),
        (7, "SAME text, here!"), (None, "same text here"), (8, "l'été à la mer ÉTÉ"), (9, "𝔘nicode 日本語 text"), (10, "x" * 3_000_000 + " here"),
    ]
    items = [(1, "Straße"), (2, "DON T 42"), (3, None), (4, "?!"), (5, "same text here"), (5, "same text here"), (6, "été à 日本語"), (7, "unknown"), (None, "stop")]
    found = ranked.search(docs(rows), queries(spark, items), most=3)
    assert told(found) == brute(rows, items, 3)
    everything = [r for r in told(ranked.search(docs(rows), queries(spark, items))) if r[0] == 5]
    assert [r[2] for r in everything[:2]] == [6, 6] and len(everything) == 2 * 6


def test_empty_tables(spark, docs):
    for rows, items in (([], []), ([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, None)])):
        assert ranked.search(docs(rows), queries(spark, items)).collect() == []


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = " ".join(f"Word{i},é{i}" for i in range(500))
    expected = [t.encode() for t in terms(text)]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(ranked, "PIECE", piece)
        assert [t for part in ranked.terms_of(text) for t in part] == expected


def shard(counts, documents, words):
    """A shard of dense counts (document, term)."""
    counts = np.array(counts)
    owner, term = np.nonzero(counts)
    starts = np.searchsorted(owner, np.arange(len(counts) + 1))
    return ranked.Shard(counts.sum(axis=1), starts, term, counts[owner, term].astype(np.int64), np.arange(len(counts)), documents, words)


def test_search_stops_before_the_end_of_the_lists_but_not_at_an_equal_score():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 2, (5000, 3)) * rng.integers(1, 4, (5000, 3))
    counts[:40] = 60  # far above the rest
    weights = np.array([900, 800, 700])
    found = shard(counts, 5000, int(counts.sum()))
    documents, scores, looked_up = found.best([0, 1, 2], weights, 10, 0)
    # Forty equal scores: all must be looked up, so that the ten first in order win.
    assert sorted(documents) == list(range(10)) and 40 <= looked_up < 2500
    everything = found.best([0, 1, 2], weights, 5000, 0)
    assert everything[2] == int((counts > 0).any(axis=1).sum())
    # A score that others have reached already ends the search at once, and nothing below it is told.
    none, _, few = found.best([0, 1, 2], weights, 10, int(scores.max()) + 1)
    assert len(none) == 0 and few <= looked_up
