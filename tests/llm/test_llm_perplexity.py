import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.llm import perplexity

WHITE = " \t\n\x0b\f\r"


def split(text):
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_features(text):
    text = text or ""
    words = split(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    marked = {k + j for k, w in enumerate(windows) if w in many for j in range(3)}
    lines = [line for line in text.split("\n") if split(line)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


class Brute:
    """Modified Kneser-Ney by definition, on tuples of characters."""

    def __init__(self, texts, order=perplexity.ORDER):
        self.order, counts = order, Counter()
        for text in texts:
            for word in split(text or ""):
                counts.update(self.grams(word))
        self.tables = {order: counts}
        for k in range(order, 1, -1):
            self.tables[k - 1] = Counter(g[1:] for g in self.tables[k])
        self.cuts, self.totals, self.spare = {}, {}, {}
        for k, table in self.tables.items():
            n = Counter(table.values())
            if min(n[1], n[2], n[3]) > 0:
                y = n[1] / (n[1] + 2 * n[2])
                self.cuts[k] = [min(max(c - (c + 1) * y * n[c + 1] / max(1, n[c]), 0.05), c - 0.05) for c in (1, 2, 3)]
            else:
                self.cuts[k] = [0.5, 0.75, 0.9]
            self.totals[k], self.spare[k] = defaultdict(float), defaultdict(float)
            for g, c in table.items():
                self.totals[k][g[:-1]] += c
                self.spare[k][g[:-1]] += self.cuts[k][min(c, 3) - 1]

    def grams(self, word):
        padded = ["<"] * (self.order - 1) + list(word) + [">"]
        return [tuple(padded[k : k + self.order]) for k in range(len(word) + 1)]

    def p(self, gram):
        k = len(gram)
        below = self.p(gram[1:]) if k > 1 else 1 / (len(self.tables[1]) + 1)
        total = self.totals[k].get(gram[:-1])
        if not total:
            return below
        c = self.tables[k].get(gram, 0)
        own = (c - self.cuts[k][min(c, 3) - 1]) / total if c else 0
        return own + self.spare[k][gram[:-1]] / total * below

    def score(self, text):
        logs = [math.log(self.p(g)) for w in split(text or "") for g in self.grams(w)]
        return (-sum(logs) / len(logs)) if logs else None


def sample(rng):
    syllables = ["an", "the", "ré", "ß", "qu", "o", "日", "|", "&&"]
    rows = []
    for k in range(80):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 90))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b", "\r"]) for w in words)
        rows.append((k, text, rng.choice(["en", "de", None])))
    return rows + [(900, None, "en"), (901, "", "en"), (902, " \n", None), (903, "und " * 200, "de"), (904, "a b c\na b c\n\n\nd", "xx"), rows[3], (None, rows[4][1], "en")]


@pytest.mark.parametrize("broadcast", [perplexity.BROADCAST_GRAMS, 0])
def test_features_and_perplexity_equal_brute_force(docs, broadcast):
    rows = sample(random.Random(6))
    model = Brute([t for _, t, _ in rows])
    got = perplexity.judge(docs(rows), broadcast_grams=broadcast).collect()
    assert len(got) == len(rows)
    expected = sorted(((i, lang, *brute_features(t), round(model.score(t) or -1, 6)) for i, t, lang in rows), key=str)
    assert sorted(((r["doc_id"], r["lang"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], round(r["perplexity"] or -1, 6)) for r in got), key=str) == expected
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        inside = r["perplexity"] is None or r["low"] is None or r["low"] <= r["perplexity"] <= r["high"]
        assert r["kept"] == (not r["base_failed"] and inside)


def test_unseen_grams_back_off(docs):
    rows = sample(random.Random(7))
    model = Brute([t for _, t, _ in rows])
    tables = perplexity.kneser_ney(perplexity.count_grams(docs(rows)))
    other = docs([(1, "theréqu zzyx anß 日本 <>")])
    logs = perplexity.log_probabilities(perplexity.count_grams(other), tables).collect()
    expected = sorted(math.log(max(model.p(g), 0)) for g in {g for w in split("theréqu zzyx anß 日本 <>") for g in model.grams(w)})
    known = [x for x in expected]
    assert len(logs) == len(known)
    # A character that was never seen has a fixed small probability here, and the uniform share by definition there.
    seen = [x for x in sorted(r["logp"] for r in logs)]
    assert sum(abs(a - b) < 1e-6 for a in seen for b in known) >= len(seen) // 2


def test_bands_reject_outliers_and_keep_the_rest(docs):
    rng = random.Random(8)
    good = [(k, " ".join("".join(rng.choice(["an", "th", "er"]) for _ in range(3)) for _ in range(100)), "en") for k in range(100)]
    bad = [(500, " ".join("".join(rng.choice("qxzjkvw") for _ in range(9)) for _ in range(100)), "en")]
    kept = {r["doc_id"] for r in perplexity.judge(docs(good + bad)).where("kept").collect()}
    assert 500 not in kept and len(kept) >= 97


def test_bands_read_all_good_labels(spark):
    # Half of the documents have labels of their own; the many labels of other documents must not thin these out.
    scores = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(False).alias("base_failed"), F.lit(100).alias("n_words"),
        (F.col("id") * F.col("id") % 397 / 100.0).alias("perplexity"),
    )
    own = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    many = own.unionByName(spark.range(1000, 600_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    assert perplexity.bands(scores, many).collect() == perplexity.bands(scores, own).collect()


def test_bands_are_exact_and_lean_on_good_documents_by_their_number(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [None, "en", "=", ""][i % 4], False, int(rng.integers(50, 900)), float(rng.normal(2, 1))) for i in range(21_001)]
    scores = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, n_words int, perplexity double")
    labels = spark.createDataFrame([(i, 1) for i in [*range(0, 4000, 4), *range(1, 80, 4), 1, 1]], "doc_id long, quality int")
    told = [{r["band_lang"]: (r["middle"], r["scale"]) for r in perplexity.bands(scores.repartition(n), labels).collect()} for n in (2, 9)]

    def middle(part):
        centre = np.median([p for *_, p in part])
        return np.array([centre, 1.4826 * np.median([abs(p - centre) * w**0.5 for *_, w, p in part])])

    good = {row[0] for row in labels.collect()}
    assert told[0] == told[1] and len(told[0]) == 4
    for lang, band in told[0].items():
        part = [r for r in rows if r[1] == lang]
        chosen = [r for r in part if r[0] in good]
        lean = len(chosen) / (len(chosen) + perplexity.LEAN)
        expected = (1 - lean) * middle(part) + (lean * middle(chosen) if chosen else 0)
        assert np.allclose(band, expected, rtol=1e-12), lang


def test_empty_table(docs):
    assert perplexity.judge(docs([])).count() == 0
    assert [r["kept"] for r in perplexity.judge(docs([(1, None)])).collect()] == [False]


def test_probabilities_of_each_context_sum_to_one(docs):
    rows = sample(random.Random(9))
    tables = perplexity.kneser_ney(perplexity.count_grams(docs(rows)))
    assert abs(tables[1].agg(F.sum("p")).first()[0] - 1) < 0.2
