"""Repeated byte strings across documents, by suffix ranks at growing lengths around sampled positions.

Every string of LENGTH bytes has one sampled position: the leftmost of its GRAM-byte grams with the smallest hash. Equal
strings sample equal places, so a string repeats exactly if another sampled position has equal bytes around it, as far to the
left and to the right. Ranks stand for the bytes around a position; Spark groups them, positions whose rank is unique drop
out, those whose neighbourhood repeats beyond the threshold are done, and the rest are ranked again over longer strings,
until one string of LENGTH bytes is left. Only about one position in LENGTH / 2 is ever ranked, and texts are shuffled once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, mixed
from tamis.session import shared_folder, written

LENGTH = 400
GRAM = 16
#: Bytes of a text that are sampled at once; a place among them fits in PLACE_BITS.
CHUNK, PLACE_BITS = 4 << 20, 24
#: Offsets of strings before their sampled position are ranked in intervals of these sizes, each a multiple of the next.
STEPS = (200, 25, 5, 1)

CANDIDATE = "row long, at long, low int, high int, first int, last int, rank long, whole1 long, whole2 long"


def _smallest(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every window of ``length`` bytes, the place of its smallest gram (leftmost of equals)."""
    count = len(data) - gram + 1
    hashes = data.astype(np.uint64)
    size = 1
    while size < gram:  # names of strings of 1, 2, 4, ... bytes: pairs of names
        hashes = mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])
        size *= 2
    packed = (hashes[:count] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(count, dtype=np.uint64)
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if size < span:
        packed = np.minimum(packed[: len(packed) - (span - size)], packed[span - size :])
    return (packed & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def sampled(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For several texts: which text, the sampled position, and the least and largest offset of a string's start before it."""
    rows: list[np.ndarray] = []
    small = [i for i, text in enumerate(texts) if length <= len(text) <= CHUNK]
    at = 0
    while at < len(small):  # texts side by side; windows across a border are left out
        group, size = [], 0
        while at < len(small) and (not group or size + len(texts[small[at]]) <= CHUNK):
            group.append(small[at])
            size += len(texts[small[at]])
            at += 1
        sizes = np.array([len(texts[i]) for i in group])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        smallest = _smallest(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), length, gram)
        owner = np.repeat(np.arange(len(group)), sizes)[: len(smallest)]
        inside = np.arange(len(smallest)) + length <= starts[owner + 1]
        rows.append(_runs(np.flatnonzero(inside), smallest[inside], owner[inside], starts, np.array(group)))
    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            parts = []
            for start in range(0, len(text) - length + 1, CHUNK):
                piece = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - start), start)
                smallest = _smallest(piece, length, gram)
                part = _runs(np.arange(len(smallest)), smallest, np.zeros(len(smallest), np.int64), np.zeros(1, np.int64), np.array([i]))
                part[1] += start
                if parts and parts[-1][1, -1] == part[1, 0]:  # one position on both sides of the cut
                    parts[-1][2, -1] = min(parts[-1][2, -1], part[2, 0])
                    part = part[:, 1:]
                if part.shape[1]:
                    parts.append(part)
            rows += parts
    return rows


def _runs(begin, smallest, owner, starts, names) -> np.ndarray:
    """Windows in a row with one sampled position are one row: text, position in it, least and largest offset."""
    if not len(begin):
        return np.zeros((4, 0), np.int64)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (np.diff(smallest) != 0) | (np.diff(owner) != 0)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(begin)]]) - 1
    position = smallest[first]
    return np.stack([names[owner[first]], position - starts[owner[first]], position - begin[last], position - begin[first]])


def _split(table: np.ndarray, step: int, limit: int) -> np.ndarray:
    """Cut each row's offsets at multiples of ``step``: which row, interval low and high, and the row's own first and last in it."""
    at, first, last = table
    low = first // step
    count = last // step - low + 1
    row = np.repeat(np.arange(len(at)), count)
    number = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = number * step
    end = np.minimum(start + step, limit) - 1
    return np.stack([row, start, end, np.maximum(first[row], start), np.minimum(last[row], end)])


def _candidates(text: bytes, table: np.ndarray, step: int, length: int, span: int):
    """Ranks of the strings around sampled positions: what all of an interval's strings share, and what they cover together."""
    row, low, high, first, last = _split(table, step, span)
    at = table[0][row]
    rank = xxhash.xxh3_64_intdigest
    whole = xxhash.xxh3_128_intdigest
    view = memoryview(text)
    names = np.fromiter(
        (rank(view[a:b], seed) for a, b, seed in zip((at - low).tolist(), (at - high + length).tolist(), (low * 4096 + high).tolist())), np.uint64, len(row)
    )
    wholes = [whole(view[a:b], seed) if a >= 0 and b <= len(text) else None for a, b, seed in zip((at - high).tolist(), (at - low + length).tolist(), (low * 4096 + high).tolist())]
    half = (1 << 64) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return (
        at, low, high, first, last, names.view(np.int64),
        [None if w is None else signed(w & half) for w in wholes], [None if w is None else signed(w >> 64) for w in wholes],
    )


def _batch(rows, parts) -> pa.RecordBatch:
    ints = lambda k, kind: pa.array(np.concatenate([np.asarray(p[k]) for p in parts]), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(rows), pa.int64()), ints(0, pa.int64()), *(ints(k, pa.int32()) for k in (1, 2, 3, 4)), ints(5, pa.int64()),
         *(pa.array([v for p in parts for v in p[k]], pa.int64()) for k in (6, 7))],
        ["row", "at", "low", "high", "first", "last", "rank", "whole1", "whole2"],
    )


def _first_round(texts: DataFrame, length: int, gram: int) -> DataFrame:
    span = length - gram + 1

    def run(batches):
        for batch in batches:
            numbers = batch.column("row").to_numpy()
            packed = [_unpacked(v, n) for v, n in zip(batch.column("packed"), batch.column("n_bytes").to_pylist())]
            for rows in sampled(packed, length, gram):
                if not rows.shape[1]:
                    continue
                cuts = np.flatnonzero(np.diff(rows[0])) + 1
                names, parts = [], []
                for own in np.split(np.arange(rows.shape[1]), cuts):
                    text = rows[0, own[0]]
                    part = _candidates(packed[text], rows[1:, own], STEPS[0], length, span)
                    names.append(np.full(len(part[0]), numbers[text]))
                    parts.append(part)
                yield _batch(names, parts)

    return texts.select("row", "n_bytes", "packed").mapInArrow(run, CANDIDATE)


def _next_round(texts: DataFrame, open_: DataFrame, step: int, length: int, gram: int) -> DataFrame:
    """Candidates of finer intervals for the positions that are left, each read off its text, which stays where it is."""
    span = length - gram + 1
    asked = open_.groupBy("row").agg(F.collect_list(F.struct("at", "first", "last")).alias("asked"))

    def run(batches):
        for batch in batches:
            names, parts = [], []
            for number, packed, size, asked in zip(batch.column("row").to_pylist(), batch.column("packed"), batch.column("n_bytes").to_pylist(), batch.column("asked").to_pylist()):
                table = np.array([[x["at"], x["first"], x["last"]] for x in asked], np.int64).T
                part = _candidates(_unpacked(packed, size), table, step, length, span)
                names.append(np.full(len(part[0]), number))
                parts.append(part)
            if parts:
                yield _batch(names, parts)

    return texts.join(asked, "row").select("row", "n_bytes", "packed", "asked").mapInArrow(run, CANDIDATE)


def _unpacked(value: pa.Scalar, size: int) -> bytes:
    return pa.decompress(value.as_buffer(), decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _packed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, row, n_bytes, packed (compressed), as a table bucketed by row: later rounds join it without moving it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [(text or "").encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary())],
                ["doc_id", "row", "n_bytes", "packed"],
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tamis_texts_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(run, f"doc_id {kind}, row long, n_bytes long, packed binary").repartition(buckets, "row")
        .write.bucketBy(buckets, "row").option("path", f"{shared_folder(spark)}/{name}").option("compression", "none").saveAsTable(name)
    )
    return spark.table(name)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, spans): for rows with repeats, intervals (start, end) of bytes that repeated strings cover, not merged."""
    done = []
    candidates = _first_round(texts, length, gram)
    for turn, step in enumerate(STEPS):
        candidates = written(candidates, f"ranks-{step}")
        # Partial counts first: a rank that a third of all documents share is one row per task. Counts are written before
        # they are joined, so that both sides of the join are plain exchanges, of which Spark can split a hot one.
        ranks = written(candidates.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), f"repeated-{step}")
        shared = written(candidates.join(ranks, "rank", "left_semi"), f"shared-{step}")
        wholes = written(
            shared.where("whole1 is not null").groupBy("whole1", "whole2")
            .agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "first", "last")).alias("one"), F.first("rank").alias("rank")).where("n > 1"),
            f"wholes-{step}",
        )
        told = shared.join(wholes.select("whole1", "whole2", F.lit(True).alias("whole")), ["whole1", "whole2"], "left")
        told = told.select("row", "at", "first", "last", "rank", F.coalesce("whole", F.lit(False)).alias("whole"))
        done.append(told.where("whole").select("row", (F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + length).alias("end")))
        if turn + 1 < len(STEPS):
            left = written(told.where("not whole"), f"open-{step}")
            # Positions that are done may still be the other copy of one that is not: of those with the same bytes, one stays.
            others = wholes.join(left.select("rank").distinct(), "rank", "left_semi").select("one.*")
            candidates = _next_round(texts, left.select("row", "at", "first", "last").unionByName(others), STEPS[turn + 1], length, gram)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal intervals that cover the same bytes; intervals that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What is left of every document: doc_id, n_bytes, n_removed, n_spans, removed (start, end), kept (bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in this or another document (strings
    never cross documents). The first copy goes as well: strings are judged on the input.

    Missing and empty texts have no bytes; texts shorter than ``length`` stay whole; texts of any length are sampled in
    chunks; equal rows are copies of each other; a missing id is an id; an empty table gives no rows; other columns are
    ignored. ``length`` must be at least ``gram`` + 15.
    """
    texts = _packed_texts(docs, id_column, text_column)
    spans = written(repeated_spans(texts, length, gram), "spans")
    kind = docs.schema[id_column].dataType.simpleString()
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for packed, size, found in zip(batch.column("packed"), batch.column("n_bytes").to_pylist(), batch.column("spans").to_pylist()):
                text = _unpacked(packed, size)
                gone = merged([(s["start"], s["end"]) for s in found or []])
                edges = [0, *(x for span in gone for x in span), size]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([sum(s["end"] - s["start"] for s in r) for r in removed], pa.int64()),
                 pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, place), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"],
            )

    return texts.join(spans, "row", "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary"
    )
