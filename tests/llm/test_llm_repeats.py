import hashlib
import random
from collections import defaultdict

import pytest

from tamis.llm import repeats


def brute(rows, length):
    places = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            places[data[p : p + length]].add((r, p))
    out = []
    for r, (i, text) in enumerate(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if len(places[data[p : p + length]]) > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    for r in rows:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"])
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows), key=str)


def texts(rng, length):
    alphabet = "abcdefghijklmnop é"
    passage = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length - 3, 3 * length))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, length))))
            if rng.random() < 0.6:
                piece = rng.choice(passage)
                cut = rng.randint(0, 5)
                parts.append(piece[cut : len(piece) - rng.randint(0, 5)])
        rows.append((k, "".join(parts)))
    rows += [(900, None), (901, ""), (902, "a" * (length + 7)), (903, "ab" * length), (904, "a" * length), (905, "x" * (length - 1)), (905, "x" * (length - 1)), rows[0], (None, passage[0] + passage[1])]
    return rows


@pytest.mark.parametrize("length", [400, 64])
def test_equals_brute_force(docs, length):
    rows = texts(random.Random(length), length)
    assert result(repeats.without_repeats(docs(rows), length=length)) == brute(rows, length)


def test_texts_sampled_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, body), (2, body[:500] + "z" + body[500:]), (3, "a" * 2500), (4, body[1000:1500])]
    assert result(repeats.without_repeats(docs(rows))) == brute(rows, 400)


def test_sampling_depends_on_the_window_alone():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc") for _ in range(2000))
    whole = {}
    for rows in repeats.sampled([data], 100, 16):
        for _, at, low, high in rows.T.tolist():
            whole |= {at - o: at for o in range(low, high + 1)}
    assert set(whole) == set(range(1901))
    for start in rng.sample(range(1901), 50):
        [rows] = repeats.sampled([data[start : start + 100]], 100, 16)
        assert rows[1, 0] + start == whole[start]


def test_empty_table(docs):
    assert repeats.without_repeats(docs([])).count() == 0


def test_recall_of_planted_passages_splits_at_the_length(spark, docs):
    """Passages of over 50 words in two or more documents: those of 400 bytes and more go whole, shorter ones stay, whatever their words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 8)))
    passages = []
    while len(passages) < 60:
        passage = " ".join(word() for _ in range(rng.randint(51, 80)))
        if not 380 < len(passage.encode()) < 400:  # what stands around one may chance to be equal too
            passages.append(passage)
    rows = []
    for k in range(240):
        before, after = (" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(2))
        planted = passages[k % 60] if k < 180 else " ".join(word() for _ in range(120))  # the last ones hold nothing planted
        rows.append((k, f"{before}\n{planted}\n{after}"))
    found = {r.doc_id: r for r in repeats.without_repeats(docs(rows)).collect()}
    long = {p for p in passages if len(p.encode()) >= repeats.LENGTH}
    assert 10 < len(long) < 55
    for k, text in rows:
        passage = passages[k % 60] if k < 180 else None
        kept = bytes(found[k]["kept"]).decode()
        assert (found[k]["n_removed"] > 0) == (passage in long)
        assert passage is None or (passage in kept) == (passage not in long)
