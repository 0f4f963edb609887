"""Exact duplicates by a tree merge of sorted digest runs.

Every task turns its texts into sorted runs of digests, one entry for each text it holds, however many copies. Partitions then
exchange runs in binomial rounds: partitions form a cube of FAN per side, and in round k the FAN partitions that differ in digit k of
their number deal their entries to each other by digit k of the entry's digest slice. What a partition receives it merges by
digest, entries of one text become one, with the better identifier and the sum of copies. After the last round each partition
holds one slice of all digests. A text held by a third of all rows is one entry in a run, and at most FAN entries in a merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.lookup import attach
from tamis.session import written

#: Partitions that exchange runs with each other in one round.
FAN = 4
#: Rows of input for each partition of the last round, at most about; partitions are a power of FAN, FAN ** 2 at least.
SLICE_ROWS = 1 << 20
#: Entries that a task sorts at a time.
RUN_ROWS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What identifies a text: its digest, and as a check on it the length and an unrelated hash.
TEXT = ["digest", "check", "n_bytes"]


def normalised(text: Column) -> Column:
    """Lower case for A-Z only; a missing text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _sorted_runs(parts: int, keep: str):
    """For mapInArrow: runs of entries in order of digest, one entry for each text; ``place`` is the partition that holds the run."""
    best = "ascending" if keep == "smallest" else "descending"
    order = [(name, "ascending") for name in TEXT] + [(name, best) for name in ("found", "id", "row")]

    def run(batches: list[pa.RecordBatch], place: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        rows = rows.take(pc.sort_indices(rows, sort_keys=order)).combine_chunks()
        first = pa.array([True] * min(1, len(rows)), pa.bool_())
        for name in TEXT if len(rows) > 1 else ():
            column = rows[name].chunk(0)
            changed = pc.not_equal(column[1:], column[:-1])
            later = changed if name == TEXT[0] else pc.or_(later, changed)  # noqa: F821
        if len(rows) > 1:
            first = pa.concat_arrays([first, later.combine_chunks() if isinstance(later, pa.ChunkedArray) else later])
        starts = pc.indices_nonzero(first)
        ends = pa.concat_arrays([starts[1:], pa.array([len(rows)], starts.type)])
        counted = rows.take(starts)
        copies = pc.subtract(ends, starts).cast(pa.int64())
        whole = counted.append_column("n", copies).append_column("place", pa.array([place] * len(counted), pa.int32()))
        return whole.combine_chunks().to_batches()[0]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size = TaskContext.get().partitionId() % parts, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= RUN_ROWS:
                yield run(held, place)
                held, size = [], 0
        if held:
            yield run(held, place)

    return runs


def _exchanged(runs: DataFrame, digit: int, parts: int, fan: int, keep: str) -> DataFrame:
    """One round: every entry goes to the partition whose number has, at ``digit``, the digit of the entry's slice; there runs are merged."""
    step = fan**digit
    slice_of = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(parts)).cast("int")
    digit_of = lambda number: F.pmod(F.floor(number / step), F.lit(fan)).cast("int")
    moved = runs.withColumn("place", F.col("place") + (digit_of(slice_of) - digit_of(F.col("place"))) * F.lit(step))
    better = F.min if keep == "smallest" else F.max
    return (
        moved.repartitionById(parts, F.col("place")).sortWithinPartitions("place", *TEXT)
        .groupBy("place", *TEXT).agg(better("best").alias("best"), F.sum("n").alias("n"))
    )


def classes(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None, keep: str = "smallest",
    fan: int = FAN, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The group of equal texts that each document is in: doc_id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; ``text_sha256`` is the digest of that form in UTF-8. Digests are
    verified by the length in bytes and a second hash, which must agree as well. Of a group the row with the ``smallest`` (or
    ``largest``) id stays. ``row`` is ``row_column``, or a number given here.

    A missing text is an empty one, and empty texts are equal. A missing id loses against any other; if all are missing, one row
    stays and keep_id is missing. Rows repeated, or rows of one id, are documents of their own: one stays. An empty table gives no
    rows; other columns are ignored; a text of any length is hashed whole, its copies are entries of some 70 bytes.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    plain = normalised(F.col(text_column))
    found = F.col(id_column).isNull() if keep == "smallest" else F.col(id_column).isNotNull()
    digests = written(docs.select(
        F.unhex(F.sha2(plain, 256)).alias("digest"), F.xxhash64(plain).alias("check"), F.octet_length(plain).cast("long").alias("n_bytes"),
        found.alias("found"), F.col(id_column).alias("id"),
        (F.monotonically_increasing_id() if row_column is None else F.col(row_column)).alias("row"),
    ), "digests")
    total = digests.count()
    rounds = 2
    while fan**rounds * slice_rows < total:
        rounds += 1
    parts = fan**rounds
    schema = ", ".join([*(f"{field.name} {field.dataType.simpleString()}" for field in digests.schema), "n long", "place int"])
    runs = digests.mapInArrow(_sorted_runs(parts, keep), schema).select(
        *TEXT, "place", F.struct("found", "id", "row").alias("best"), "n"
    )
    for digit in range(rounds):
        runs = _exchanged(runs, digit, parts, fan, keep)
    groups = written(runs.where("n > 1").select(
        F.struct(*TEXT).alias("cle"), F.struct("best", "n").alias("valeur"), F.col("n").alias("occurrences")
    ), "equal-texts")
    size = groups.count()
    # A key and its value: digest, check and length, identifier, row and count.
    told = attach(digests, F.struct(*TEXT), groups, size=size, total=total, width=size * 128, out="group")
    alone = F.col("group").isNull()
    return told.select(
        F.col("id").alias("doc_id"), "row",
        F.when(alone, F.col("id")).otherwise(F.col("group.best.id")).alias("keep_id"),
        F.coalesce("group.n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("group.best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
