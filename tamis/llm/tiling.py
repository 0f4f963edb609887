"""Benchmark passages in documents, by greedy string tiling.

Documents and test items share seeds, runs of SEED words with the same Karp-Rabin fingerprint. Of each document and item
that meet, the longest matches are marked first and never overlap; the share of an item's words that the tiles cover
decides, so that a passage whose sentences were reordered is caught as well.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import Hashed, bounded_batches, in_groups, runs
from tamis.session import written

#: Words of a seed, and so of the shortest tile. A shorter item is one seed.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bits of the table that tells which seeds may be in the benchmark: a fixed size, whatever the benchmark's.
TABLE_BITS = 22

#: Bytes of words, in lower case: letters and digits of ASCII, and everything beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of several texts, and the text that each is of."""
    parts = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    ends = np.cumsum([len(part) + 1 for part in parts])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    start, end = runs(_INSIDE[data])
    return Hashed(_LOWER[data]).of(start, end), np.searchsorted(ends, start, side="right")


def _seeds(words: np.ndarray, length: int) -> np.ndarray:
    """Rolling fingerprint of every run of ``length`` words."""
    count = max(0, len(words) - length + 1)
    out = np.zeros(count, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
    return out


def _place(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def tiles(doc_at: np.ndarray, doc_seeds: np.ndarray, item_seeds: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, words): longest first, then by place in the item and in the document.

    ``doc_at`` and ``doc_seeds`` are the places and fingerprints of the document's seeds that the item may share.
    """
    order = np.argsort(item_seeds, kind="stable")
    ranked = item_seeds[order]
    low, high = np.searchsorted(ranked, doc_seeds, "left"), np.searchsorted(ranked, doc_seeds, "right")
    reps = high - low
    total = int(reps.sum())
    if not total:
        return []
    doc_pos = np.repeat(doc_at, reps)
    item_pos = order[np.repeat(low - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(total)]
    # Seeds one after the other on a diagonal are one match.
    by = np.lexsort((doc_pos, doc_pos - item_pos))
    doc_pos, item_pos = doc_pos[by], item_pos[by]
    fresh = np.ones(total, bool)
    fresh[1:] = (np.diff(doc_pos) != 1) | (np.diff(item_pos) != 1)
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.concatenate([first, [total]])) + length - 1
    heap = [(-int(n), int(i), int(d)) for n, i, d in zip(sizes, item_pos[first], doc_pos[first])]
    heapq.heapify(heap)
    doc_marks: set[int] = set()
    item_marks: set[int] = set()
    found = []
    while heap:
        size, item, doc = heapq.heappop(heap)
        size = -size
        free = [doc + k not in doc_marks and item + k not in item_marks for k in range(size)]
        if all(free):
            found.append((doc, item, size))
            doc_marks.update(range(doc, doc + size))
            item_marks.update(range(item, item + size))
            continue
        start = 0  # what longer tiles left of this match goes back to the queue
        for k in range(size + 1):
            if k == size or not free[k]:
                if k - start >= length:
                    heapq.heappush(heap, (start - k, item + start, doc + start))
                start = k + 1
    return found


def key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: equal ids and texts have equal results."""
    return F.xxhash64(doc_id, text)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", seed: int = SEED,
) -> DataFrame:
    """Pairs that share a seed: key (of the document's id and text), doc_id, item_id, covered, item_words, coverage.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. Fingerprints have 64 bits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    item_kind = benchmark.schema[item_column].dataType.simpleString()

    def item_rows(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words, _ = _words([text])
                length = min(seed, len(words))
                if length:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item], batch.schema.field("item_id").type), pa.array([len(words)], pa.int32()), pa.array([length], pa.int32()),
                         pa.array([_seeds(words, length).view(np.int64)], pa.list_(pa.int64()))],
                        ["item_id", "item_words", "length", "seeds"],
                    )

    items = written(
        benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text_column).alias("text"))
        .mapInArrow(item_rows, f"item_id {item_kind}, item_words int, length int, seeds array<long>")
        .withColumn("item", F.xxhash64("item_id", "seeds")), "items",
    )
    item_seeds = items.select("item", "length", F.explode("seeds").alias("seed")).distinct()
    # At most 2 ** TABLE_BITS places and SEED lengths reach the driver, however large the benchmark.
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())
    places = item_seeds.select(F.shiftrightunsigned("seed", 64 - TABLE_BITS).cast("int").alias("place")).distinct().toArrow()
    table = np.zeros(1 << TABLE_BITS, bool)
    table[places.column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(table))
    doc_kind = docs.schema[id_column].dataType.simpleString()

    def doc_rows(batches):
        known = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_groups(texts):
                words, owner = _words(texts[part])
                out = {"row": [], "length": [], "at": [], "seed": []}
                starts = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
                for length in lengths:
                    seeds = _seeds(words, length)
                    keep = np.flatnonzero(known[_place(seeds)] & (owner[: len(seeds)] == owner[length - 1 :][: len(seeds)]))
                    out["row"].append(owner[keep])
                    out["length"].append(np.full(len(keep), length))
                    out["at"].append(keep - starts[owner[keep]])
                    out["seed"].append(seeds[keep].view(np.int64))
                row = np.concatenate([*out["row"], np.zeros(0, np.int64)]).astype(np.int64)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(row + part.start)), batch.column("doc_id").take(pa.array(row + part.start)),
                         pa.array(np.concatenate(out["length"]).astype(np.int32)), pa.array(np.concatenate(out["at"]).astype(np.int32)),
                         pa.array(np.concatenate(out["seed"]))],
                        ["key", "doc_id", "length", "at", "seed"],
                    )

    doc_seeds = docs.select(
        key(F.col(id_column), F.col(text_column)).alias("key"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(doc_rows, f"key long, doc_id {doc_kind}, length int, at int, seed long")
    met = (
        doc_seeds.join(item_seeds, ["length", "seed"])
        .groupBy("key", "item").agg(F.collect_set(F.struct("at", "seed")).alias("matches"), F.first("doc_id").alias("doc_id"))
    )

    def tile_rows(batches):
        for batch in batches:
            covered = []
            for matches, seeds, length in zip(*(batch.column(name).to_pylist() for name in ("matches", "seeds", "length"))):
                pairs = sorted((m["at"], m["seed"]) for m in matches)
                at = np.array([a for a, _ in pairs], np.int64)
                found = tiles(at, np.array([s for _, s in pairs], np.int64), np.array(seeds, np.int64), length)
                covered.append(sum(size for _, _, size in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in ("key", "doc_id", "item_id", "item_words")] + [pa.array(covered, pa.int32())],
                ["key", "doc_id", "item_id", "item_words", "covered"],
            )

    return (
        met.join(items.select("item", "item_id", "item_words", "length", "seeds").dropDuplicates(["item"]), "item")
        .select("key", "doc_id", "item_id", "item_words", "length", "seeds", "matches")
        .mapInArrow(tile_rows, f"key long, doc_id {doc_kind}, item_id {item_kind}, item_words int, covered int")
        .withColumn("coverage", F.col("covered") / F.col("item_words"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    coverage: float = COVERAGE, seed: int = SEED, **names,
) -> DataFrame:
    """Every document with what it holds of the benchmark: doc_id, contaminated, n_items, items, coverage.

    ``items`` lists the ids of the items that tiles cover to ``coverage`` or more, ``coverage`` is the largest share of any item.

    Missing and blank texts, of documents or items, share nothing; an item shorter than a seed must appear whole; long texts
    are read whole; documents repeated get equal results, items repeated are listed once per id; an item without id is
    reported by its count alone; empty tables give no findings or no rows; other columns are ignored.
    """
    per_doc, item_array = _by_key(docs, benchmark, coverage, id_column=id_column, text_column=text_column, seed=seed, **names)
    every = docs.select(F.col(id_column).alias("doc_id"), key(F.col(id_column), F.col(text_column)).alias("key"))
    return every.join(per_doc, "key", "left").select(
        "doc_id", (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(item_array)).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def contaminated_keys(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **names) -> DataFrame:
    """(key) of the documents that hold an item to ``coverage`` or more."""
    return _by_key(docs, benchmark, coverage, **names)[0].where("n_items > 0").select("key")


def _by_key(docs: DataFrame, benchmark: DataFrame, coverage: float, **names):
    found = overlaps(docs, benchmark, **names)
    enough = F.col("coverage") >= coverage
    per_key = written(found.groupBy("key").agg(
        F.max("coverage").alias("coverage"), F.array_sort(F.collect_set(F.when(enough, F.col("item_id")))).alias("items"),
        F.count(F.when(enough, 1)).alias("n_items"),
    ), "contaminated")
    return per_key, per_key.schema["items"].dataType
