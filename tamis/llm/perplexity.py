"""Quality rules: counts of words, symbols and repeats, and perplexity under a modified Kneser-Ney model.

The model is one of characters, five at a time and inside words. It is counted by Spark over all documents, smoothed by joins
of count tables, and kept as sorted arrays of packed n-grams and their log probabilities. A document is rejected if its
perplexity is outside the band of its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import Hashed, beside, bounded_batches, in_groups, mixed, runs
from tamis.operators.ranks import number_in_order
from tamis.session import written

#: Characters of an n-gram, and bits of one: five of twelve fit in a long.
ORDER, BITS = 5, 12
#: Code points from here on share the classes that are left (fixed values of the packing). 1 begins a word, 2 ends it.
PLAIN, BEGIN, END = 3072, 1, 2
#: A model of more n-grams is joined by shuffle; a smaller one is broadcast (16 bytes each).
BROADCAST_GRAMS = 8_000_000
#: How far from the median a band reaches, in standard deviations of a good document of the same length, and the least such
#: deviation (of log perplexity per character).
SPREAD, FLOOR = 3.5, 0.006
#: A language's band leans on its good labelled documents by their number n as n / (n + LEAN), and on all documents for the rest.
LEAN = 30
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50

_BLANKS = np.array([0x20, 9, 10, 11, 12, 13], np.uint32)


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of several texts, a line end after each, and where each begins."""
    lengths = np.array([len(text) if text else 0 for text in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(("\n".join(text or "" for text in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, starts


def _word_table(data: np.ndarray, starts: np.ndarray):
    """Words of several texts: where they start and end, the text each is of, and their fingerprints."""
    blank = (data <= 0x20) & np.isin(data, _BLANKS)
    begin, end = runs(~blank)
    hashed = Hashed(data)
    return begin, end, np.searchsorted(starts, begin, side="right") - 1, hashed


def _classes(data: np.ndarray) -> np.ndarray:
    return np.where(data < PLAIN, data, PLAIN + data % ((1 << BITS) - PLAIN)).astype(np.int64)


def _grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams that end in each character of each word and in its end, and the word of each."""
    size = end - begin + ORDER  # ORDER - 1 beginnings, the word, its end
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(first[-1], BEGIN, np.int64)
    word = np.repeat(np.arange(len(begin)), size)
    inside = np.arange(first[-1]) - first[word] - (ORDER - 1)
    chars = (inside >= 0) & (inside < (end - begin)[word])
    flat[chars] = _classes(data[begin[word[chars]] + inside[chars]])
    flat[first[1:] - 1] = END
    key = np.zeros(len(flat), np.int64)
    for back in range(ORDER - 1, -1, -1):
        key[ORDER - 1 :] = (key[ORDER - 1 :] << BITS) | flat[ORDER - 1 - back : len(flat) - back]
    told = inside >= 0
    return key[told], word[told]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys = np.concatenate([*keys, np.zeros(0, np.int64)])
    unique, inverse = np.unique(all_keys, return_inverse=True)
    return unique, np.bincount(inverse, np.concatenate([*counts, np.zeros(0)]), len(unique)).astype(np.int64)


def count_grams(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(gram, n) over all words of all documents; a task sends a row for each n-gram that it has seen."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        keys, counts, waiting = [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_groups(texts):
                data, starts = _points(texts[part])
                begin, end, _, hashed = _word_table(data, starts)
                if not len(begin):
                    continue
                _, at, times = np.unique(hashed.of(begin, end), return_index=True, return_counts=True)
                grams, word = _grams(data, begin[at], end[at])
                found, n = _summed([grams], [times[word].astype(float)])
                keys.append(found)
                counts.append(n)
                waiting += len(found)
                if waiting > 4_000_000:
                    merged = _summed(keys, counts)
                    keys, counts, waiting = [merged[0]], [merged[1]], 0
        found, n = _summed(keys, counts)
        for at in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["gram", "n"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    """The last order - 1 characters of an n-gram of ``order``."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def kneser_ney(grams: DataFrame) -> dict[int, DataFrame]:
    """Smoothed tables by order, 1 to ORDER: gram, p (interpolated), and the weight that its context leaves for shorter ones.

    The highest order keeps the counts; every lower one counts in how many longer n-grams it is the end. Each order has three
    discounts, for counts of 1, 2 and more, from its counts of counts.
    """
    tables = {ORDER: grams}
    for order in range(ORDER, 1, -1):
        tables[order - 1] = written(tables[order].groupBy(_suffix(order).alias("gram")).agg(F.count("*").alias("n")), "grams")
    out: dict[int, DataFrame] = {}
    for order in range(1, ORDER + 1):
        table = tables[order]
        stats = table.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count("*").alias("types")).first()
        n1, n2, n3, n4 = (float(stats[f"n{k}"]) for k in (1, 2, 3, 4))
        if min(n1, n2, n3) > 0:
            y = n1 / (n1 + 2 * n2)
            cuts = [min(max(k - (k + 1) * y * nk / max(1.0, n), 0.05), k - 0.05) for k, n, nk in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        else:  # too few counts to estimate from
            cuts = [0.5, 0.75, 0.9]
        cut = F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
        table = table.withColumn("context", F.shiftright("gram", BITS)).withColumn("cut", cut)
        contexts = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare"))
        joined = table.join(contexts, "context").select(
            "gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), (F.col("spare") / F.col("total")).alias("weight"),
        )
        if order == 1:
            smoothed = joined.withColumn("p", F.col("own") + F.col("weight") / (stats["types"] + 1.0))
        else:
            shorter = out[order - 1].select(F.col("gram").alias("shorter"), F.col("p").alias("below"))
            smoothed = joined.withColumn("end", _suffix(order)).join(shorter, F.col("end") == F.col("shorter")).withColumn(
                "p", F.col("own") + F.col("weight") * F.col("below")
            )
        out[order] = written(smoothed.select("gram", "context", "p", "weight"), "smoothed")
    return out


def log_probabilities(wanted: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """(gram, logp) of every n-gram of ``wanted``, those the model has not seen by backing off to their ends."""
    found = wanted.select("gram")
    for order in range(ORDER, 0, -1):
        mask = F.lit((1 << BITS * order) - 1)
        table = model[order].select(F.col("gram").alias("g"), F.col("p").alias(f"p{order}"))
        found = found.withColumn("g", F.col("gram").bitwiseAND(mask)).join(table, "g", "left").drop("g")
        weights = model[order].select(F.col("context").alias("c"), F.col("weight").alias(f"w{order}")).distinct()
        found = found.withColumn("c", F.shiftright(F.col("gram").bitwiseAND(mask), BITS)).join(weights, "c", "left").drop("c")
    p = F.coalesce("p1", F.lit(1e-7))
    for order in range(2, ORDER + 1):
        p = F.coalesce(f"p{order}", F.coalesce(f"w{order}", F.lit(1.0)) * p)
    return found.select("gram", F.log(p).alias("logp"))


# --- Scores of documents ------------------------------------------------------------------

KEPT = ("doc_id", "row", "lang")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def features(data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, hashed: Hashed) -> dict[str, np.ndarray]:
    """Base counts of each text."""
    count = len(starts) - 1
    per = lambda of, weights=None: np.bincount(of, weights, count).astype(np.int64)
    symbols = np.flatnonzero(np.isin(data, np.array([ord(c) for c in SYMBOLS], np.uint32)))
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    words_before = np.searchsorted(begin, np.concatenate([line_start, [len(data)]]))
    with_word = np.flatnonzero(np.diff(words_before) > 0)
    line_owner = np.searchsorted(starts, line_start[with_word], side="right") - 1
    line = mixed(hashed.of(line_start[with_word], breaks[with_word]) + line_owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, first = np.unique(line, return_index=True)
    words = hashed.of(begin, end)
    repeated = np.zeros(len(words), bool)
    if len(words) > 3:
        window = mixed(mixed(mixed(words[:-2]) + words[1:-1]) + words[2:] + owner[:-2].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        window = np.where(owner[:-2] == owner[2:], window, 0)
        _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = np.flatnonzero((times[inverse] > 1) & (owner[:-2] == owner[2:]))
        for k in range(3):
            repeated[twice + k] = True
    return {
        "n_words": per(owner), "word_chars": per(owner, end - begin),
        "n_symbols": per(np.searchsorted(starts, symbols, side="right") - 1),
        "n_dup_lines": per(line_owner) - per(line_owner[first]), "n_repeat_words": per(owner[repeated]),
    }


def _base_batches(batches, score):
    """Base counts of each row; ``score`` adds columns from the distinct words of a group of texts."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in in_groups(texts):
            data, starts = _points(texts[part])
            begin, end, owner, hashed = _word_table(data, starts)
            columns = features(data, starts, begin, end, owner, hashed)
            _, at, inverse = np.unique(hashed.of(begin, end), return_index=True, return_inverse=True)
            yield batch.slice(part.start, part.stop - part.start), columns, score(data, begin, end, owner, at, inverse, len(starts) - 1)


def scored(docs: DataFrame, table: DataFrame, *, text_column: str = "text", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` columns of KEPT, with FEATURES, n_grams and log_likelihood under a table (gram, logp).

    A table of at most ``broadcast_grams`` rows goes to every worker as two sorted arrays; a larger one is joined.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [f"{name} {docs.schema[name].dataType.simpleString()}" for name in KEPT]
    slim = docs.select(*KEPT, F.col(text_column).alias("text"))
    if table.limit(broadcast_grams + 1).count() <= broadcast_grams:
        rows = table.toArrow()
        keys, logs = rows.column("gram").to_numpy(), rows.column("logp").to_numpy()
        order = np.argsort(keys)
        model = spark.sparkContext.broadcast((keys[order], logs[order]))

        def run(batches):
            keys, logs = model.value

            def score(data, begin, end, owner, at, inverse, count):
                grams, word = _grams(data, begin[at], end[at])
                value = np.zeros(0)
                if len(at):
                    value = np.bincount(word, logs[np.searchsorted(keys, grams)], len(at))
                return np.bincount(owner, value[inverse], count).astype(float), np.bincount(owner, end - begin + 1, count).astype(np.int64)

            for rows, columns, (likelihood, grams) in _base_batches(batches, score):
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(name) for name in KEPT), *map(pa.array, columns.values()), pa.array(grams), pa.array(likelihood)],
                    [*KEPT, *columns, "n_grams", "log_likelihood"],
                )

        return slim.mapInArrow(run, ", ".join([*kept, FEATURES, "n_grams long, log_likelihood double"]))

    def run_grams(batches):
        def score(data, begin, end, owner, at, inverse, count):
            grams, word = _grams(data, begin[at], end[at])
            by_word = np.argsort(word, kind="stable")
            grams, size = grams[by_word], np.bincount(word, minlength=len(at))
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            out = []
            for doc in range(count):
                own = inverse[owner == doc]
                reps = size[own]
                total = int(reps.sum())
                place = np.repeat(first[own] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(total) if total else np.zeros(0, np.int64)
                out.append(np.unique(grams[place], return_counts=True))
            return out

        for rows, columns, grams in _base_batches(batches, score):
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(name) for name in KEPT), *map(pa.array, columns.values()),
                 pa.array([a for a, _ in grams], pa.list_(pa.int64())), pa.array([b for _, b in grams], pa.list_(pa.int64()))],
                [*KEPT, *columns, "grams", "times"],
            )

    counted = written(
        slim.mapInArrow(run_grams, ", ".join([*kept, FEATURES, "grams array<long>, times array<long>"]))
        .withColumn("number", F.monotonically_increasing_id()), "doc-grams",
    )
    sums = (
        counted.select("number", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("number", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
        .join(table, "gram").groupBy("number").agg(F.sum("times").alias("n_grams"), F.sum(F.col("times") * F.col("logp")).alias("log_likelihood"))
    )
    return counted.drop("grams", "times").join(sums, "number", "left").drop("number").fillna({"n_grams": 0, "log_likelihood": 0.0})


def bands(scores: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(band_lang, middle, scale) of log perplexity per character, for each language.

    The middle is the median, and the scale the median absolute deviation (as a standard deviation) of the distance from it
    times the root of a document's words: a mean over more words strays less. Both are taken over documents labelled good and
    over all that pass the base rules; the band lies between the two, the nearer to the good ones the more there are. Medians are
    exact, so a band does not depend on how the documents are partitioned.
    """
    key = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))
    usable = scores.where(~F.col("base_failed") & F.col("perplexity").isNotNull()).select(key.alias("key"), "doc_id", "perplexity", "n_words")
    named = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("band_lang")
    everything = _middle(usable)
    if labels is None:
        return everything.select(named, "middle", "scale")
    named_good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    good = _middle(usable.join(named_good, F.col("doc_id") == F.col("good_id"), "left_semi")).toDF("key", "good_middle", "good_scale", "good")
    lean = F.coalesce(F.col("good") / (F.col("good") + LEAN), F.lit(0.0))
    between = lambda name: ((1 - lean) * F.col(name) + lean * F.coalesce(f"good_{name}", name)).alias(name)
    return everything.join(good, "key", "left").select(named, between("middle"), between("scale"))


def _middle(scores: DataFrame) -> DataFrame:
    """(key, middle, scale, n) of each language."""
    centre = beside(_medians(scores, F.col("perplexity")), "centres")
    off = F.abs(F.col("perplexity") - F.col("median")) * F.sqrt("n_words")
    scale = _medians(scores.join(centre, "key"), off).select("key", (1.4826 * F.col("median")).alias("scale"))
    return centre.join(scale, "key").select("key", F.col("median").alias("middle"), "scale", "n")


def _medians(scores: DataFrame, value: Column) -> DataFrame:
    """(key, median, n) of each language: the values numbered in order, block by block, and the one or two in the middle."""
    values = scores.select("key", value.alias("v"))
    sizes = beside(values.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    placed = number_in_order(values, ["key"], "v", "place").join(sizes, "key")
    middle = F.col("place").between(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    return placed.where(middle).groupBy("key").agg(F.avg("v").alias("median"), F.max("n").alias("n"))


def judge(
    docs: DataFrame, labels: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text",
    lang_column: str = "lang", row_column: str | None = None, spread: float = SPREAD, broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """The verdict on every document: doc_id, row, lang, FEATURES, perplexity (log, per character), low, high, base_failed, kept.

    base_failed: fewer than FEWEST_WORDS words, or more than half of the words in 3-word windows found twice. kept: not
    base_failed, and a perplexity inside the band of the document's language.

    ``row`` repeats ``row_column`` (the id by default). Missing, empty and blank texts have no words and fail; long texts are read whole (about 60 bytes a character in their
    task); a missing language is a language of its own; repeated rows stay repeated; an empty table gives no rows; other columns
    are ignored. ``labels`` (doc_id, quality) only fit the bands.
    """
    named = docs.select(
        F.col(id_column).alias("doc_id"), F.col(row_column or id_column).alias("row"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    grams = written(count_grams(named), "gram-counts")
    table = written(kneser_ney(grams)[ORDER].select("gram", F.log("p").alias("logp")), "gram-logs")
    scores = scored(named, table, broadcast_grams=broadcast_grams)
    scores = written(scores.withColumn(
        "base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ).withColumn("perplexity", F.when(F.col("n_grams") > 0, -F.col("log_likelihood") / F.col("n_grams"))), "scores")
    limits = beside(bands(scores, labels), "bands")  # a row per language
    width = spread * F.sqrt(F.lit(FLOOR * FLOOR) + F.pow("scale", F.lit(2)) / F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return scores.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").withColumn(
        "low", F.col("middle") - width
    ).withColumn("high", F.col("middle") + width).select(
        *KEPT, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "perplexity", "low", "high",
        "base_failed", (~F.col("base_failed") & inside).alias("kept"),
    )
