"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt to shards, and every shard has, for each term of the queries, an impact list: its documents that hold the term,
highest impact first. For a query, the lists of its terms are read in parallel. A document met in one list is looked up in the
others at once (direct access), which gives its whole score and its position in each of them. The best position of a list is the
end of the unbroken run of seen positions from its start, whether they were read or looked up, and no unseen document can
score more than the impacts at the best positions together. The search stops once that sum is strictly below the k-th score: an equal
score may still win by its identifier.

A first pass over a share of the documents gives every query a k-th score to start from, so most shards stop early; it bounds work,
not results. Shards give their best k, and a window over these, first by query and salt, gives the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, free_name
from tamis.session import written

MOST = 50
#: Bytes that end a term: ASCII but letters and digits. All bytes of other characters belong to terms.
_ENDS = bytes(c for c in range(128) if not chr(c).isalnum())
_LOWER = bytes.maketrans(_ENDS + bytes(range(65, 91)), b" " * len(_ENDS) + bytes(range(97, 123)))
#: Bytes of a text whose terms are split at a time, about.
PIECE = 1 << 20
#: Terms of queries that one pass over the documents may look for, about; queries with more go in several passes.
PASS_TERMS = 1 << 19
#: Postings of a shard, at most about (a document is not split).
SHARD_POSTINGS = 1 << 21
#: One document in so many gives the k-th scores to start from.
FIRST_SHARE = 16
#: Positions of a list that are read before the first look at the threshold; the number doubles.
FIRST_DEPTH = 16
SALTS = 32


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in UTF-8 and in order, some at a time."""
    data = text.encode().translate(_LOWER)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, text) to (query, terms)."""
    for batch in batches:
        found = [sorted({t.decode() for piece in terms_of(text or "") for t in piece}) for text in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["query", "terms"])


def _forward(known: dict[bytes, int]):
    """(id, row, text) to (id, row, n, terms, counts): how many terms a document has, and which of ``known`` how often."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(2).to_pylist():
                size, found = 0, Counter()
                for piece in terms_of(text or ""):
                    size += len(piece)
                    found.update(map(known.get, piece))
                found.pop(None, None)
                held = sorted(found)
                sizes.append(size)
                terms.append(held)
                counts.append([found[t] for t in held])
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
            ], ["id", "row", "n", "terms", "counts"])

    return forward


class Shard:
    """Impact lists of some documents: by term, and the same postings by document for direct access."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, order: np.ndarray, documents: int, words: int):
        lengths = np.array([50 + 50 * n * documents // words for n in sizes.tolist()], np.int64)
        owner = np.repeat(np.arange(len(sizes)), np.diff(starts))
        self.starts, self.terms, self.order = starts, terms, order
        self.impacts = (1_000_000_000 * counts) // (1000 * counts + 20 * lengths[owner])
        by_list = np.lexsort((-self.impacts, terms))
        self.documents, self.sorted_impacts = owner[by_list], self.impacts[by_list]
        present, first = np.unique(terms[by_list], return_index=True)
        ends = np.append(first[1:], len(terms))
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(present, first, ends)}
        self.places = np.empty(len(terms), np.int64)  # of each posting, in all lists
        self.places[by_list] = np.arange(len(terms))

    def best(self, terms: list[int], weights: np.ndarray, most: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``most`` documents of highest score above 0 and not below ``floor``, their scores, and how many were looked up."""
        held = [t for t in terms if t in self.lists and weights[t] > 0]
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        bounds = [self.lists[t] for t in held]
        wanted = np.zeros(len(weights), np.int64)
        wanted[held] = weights[held]
        seen = np.zeros(len(self.terms), bool)  # positions, of all lists
        met = np.zeros(len(self.starts) - 1, bool)
        reached = [a for a, _ in bounds]  # first position of each list that is not known to be seen
        documents, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        looked_up, depth, step = 0, 0, FIRST_DEPTH
        while True:
            read = np.concatenate([self.documents[a + depth : min(b, a + depth + step)] for a, b in bounds if a + depth < b] or [np.empty(0, np.int64)])
            fresh = np.unique(read[~met[read]])
            met[fresh] = True
            looked_up += len(fresh)
            sizes = self.starts[fresh + 1] - self.starts[fresh]
            postings = np.arange(sizes.sum()) + np.repeat(self.starts[fresh] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            weight = wanted[self.terms[postings]]
            postings, weight, owner = postings[weight > 0], weight[weight > 0], np.repeat(np.arange(len(fresh)), sizes)[weight > 0]
            seen[self.places[postings]] = True
            found = np.zeros(len(fresh), np.int64)
            np.add.at(found, owner, weight * self.impacts[postings])
            documents, scores = np.concatenate([documents, fresh]), np.concatenate([scores, found])
            if len(scores) > most:
                best = np.lexsort((self.order[documents], -scores))[:most]
                documents, scores = documents[best], scores[best]
            depth, step = depth + step, step * 2
            threshold = 0
            for at, (a, b) in enumerate(bounds):
                ahead = seen[reached[at] : b]
                gap = int(ahead.argmin()) if len(ahead) else 0
                reached[at] = b if len(ahead) and ahead[gap] else reached[at] + gap
                if reached[at] < b:  # else every document of the list is known
                    threshold += int(weights[held[at]] * self.sorted_impacts[reached[at] - 1])
            kth = int(scores.min()) if len(scores) >= most else 0
            if threshold < max(kth, floor, 1) or not len(read):
                keep = scores >= max(floor, 1)
                return documents[keep], scores[keep], looked_up


def _searched(queries: list[tuple[int, list[int]]], weights: np.ndarray, floors: dict[int, int], documents: int, words: int, most: int, shard_postings: int):
    """(id, row, n, terms, counts) to (query, id, row, score): the best of each shard for each query."""

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms, ids = rows["terms"].chunk(0), rows["id"].chunk(0)
        shard = Shard(
            rows["n"].to_numpy(), terms.offsets.to_numpy().astype(np.int64) - terms.offsets[0].as_py(),
            terms.flatten().to_numpy(), rows["counts"].chunk(0).flatten().to_numpy(), _ranks(rows), documents, words,
        )
        for query, wanted in queries:
            found, scores, _ = shard.best(wanted, weights, most, floors.get(query, 0))
            if len(found):
                taken = pa.array(found)
                yield pa.record_batch([
                    pa.array([query] * len(found), pa.int64()), ids.take(taken), rows["row"].chunk(0).take(taken), pa.array(scores),
                ], ["query", "id", "row", "score"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(3).flatten()) + batch.num_rows
            if size >= shard_postings:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    return searched


def _ranks(rows: pa.Table) -> np.ndarray:
    """Place of each row in the order of (id, row), missing ids last."""
    order = pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of each query with their rank: first of each of SALTS parts of its documents, then of these."""
    order = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    part = Window.partitionBy("query", "salt").orderBy(*order)
    whole = Window.partitionBy("query").orderBy(*order)
    some = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part))
    return some.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= most).drop("salt")


def search(
    docs: DataFrame, queries: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", query_column: str = "item_id",
    query_text: str = "text", most: int = MOST, pass_terms: int = PASS_TERMS, shard_postings: int = SHARD_POSTINGS, first_share: int = FIRST_SHARE,
) -> DataFrame:
    """The ``most`` best documents of each query: query_id, rank, doc_id, score; only scores above 0.

    Terms are the maximal runs of ASCII letters and digits and of all other characters than ASCII, A-Z lower-cased. With N documents
    that hold a term, L terms in all, n in the document, df documents with the term and tf times it in the document:
    weight w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + 50nN div L, and the score is the sum over the query's distinct terms of
    w * (10^9 tf div (1000 tf + 20m)). Equal scores are ordered by ascending id.

    A missing or empty text has no terms: such a document is never found and counts in no statistic, such a query finds nothing.
    Repeated documents are documents of their own, also those with the same id (their order among each other is that of the
    table's rows); missing ids come last among equal scores. Repeated queries are queries of their own with the same result. Empty
    tables give no rows, other columns are ignored. Terms of long texts are split in pieces, so a text needs a few times its own size.

    Queries go in passes of about ``pass_terms`` terms, whose terms and weights the driver and every worker hold; each pass reads the
    texts once and writes, for every document, its terms that occur in queries.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    number = free_name(queries, "query")
    asked = written(queries.select(F.col(query_column).alias("query_id"), F.col(query_text).alias("body"), F.monotonically_increasing_id().alias(number)), "queries")
    known = written(asked.select(F.col(number).alias("query"), "body").mapInArrow(_distinct_terms, "query long, terms array<string>"), "query-terms")
    texts = docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("body"))
    passes = 1 + known.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()[0] // pass_terms
    parts = []
    for at in range(passes):
        mine = known.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == at).collect()  # about pass_terms terms
        if mine:
            parts.append(_one_pass(texts, [(row["query"], row["terms"]) for row in mine], most, shard_postings, first_share))
    if not parts:
        id_type = texts.schema["id"].dataType.simpleString()
        parts = [spark.createDataFrame([], f"query long, id {id_type}, row long, score long, rank int")]
    ranked = reduce(DataFrame.unionByName, parts)
    # At most ``most`` rows a query.
    return ranked.join(asked.select(F.col(number).alias("query"), "query_id"), "query").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"
    )


def _one_pass(texts: DataFrame, queries: list[tuple[int, list[str]]], most: int, shard_postings: int, first_share: int) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = sorted({term for _, terms in queries for term in terms})
    number = {term: at for at, term in enumerate(vocabulary)}
    coded = [(query, [number[term] for term in terms]) for query, terms in queries]
    id_type = texts.schema["id"].dataType.simpleString()
    index = written(
        texts.mapInArrow(_forward({term.encode(): at for term, at in number.items()}), f"id {id_type}, row long, n long, terms array<int>, counts array<long>")
        .where("n > 0"), "forward-index",
    )
    documents, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    total, times = F.lit(2 * documents + 2).cast("double"), (2 * F.col("df") + 1).cast("double")
    weighed = (
        index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        .select("term", F.floor(1000 * F.ln(total / times)).cast("long").alias("w")).collect()  # no more rows than terms of the pass
    )
    weights = np.zeros(len(vocabulary), np.int64)
    for row in weighed:
        weights[row["term"]] = row["w"]
    held, found_in = index.where(F.size("terms") > 0), f"query long, id {id_type}, row long, score long"
    look = lambda floors: _searched(coded, weights, floors, documents, words, most, shard_postings)
    first = F.pmod(F.xxhash64("row"), F.lit(first_share)) == 0
    started = written(_ranked(held.where(first).mapInArrow(look({}), found_in), most), "first-found")
    floors = {row["query"]: row["score"] for row in started.where(F.col("rank") == most).select("query", "score").collect()}  # one row a query
    others = held.where(~first).mapInArrow(look(floors), found_in)
    return _ranked(others.unionByName(started.drop("rank")), most)
