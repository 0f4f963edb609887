"""Mix sources to target weights by an exact cut of a random order.

Every document gets a hash-random key; within a source the documents are range-sorted by it, running sums of their sizes
come from sums of key ranges, and each source is cut at its exact budget, after whole epochs where the budget is larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import word_count
from tamis.session import written

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so many times.
EPOCHS = 3
#: Hexadecimal digits of the key that name a key range: 16 ** 3 ranges of each source, so one holds 1 / 4096 of its rows.
RANGE_DIGITS = 3
#: Equal rows that one row is written out to in one go.
AT_ONCE = 1 << 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Word budget of each source.

    ``sizes`` has one row per source: source, source_size. The budgets share the sum of all sizes by weight; where a budget
    would exceed ``epochs`` times the source, it stops there and the rest is shared again by weight. With sources in order
    of (limit / weight), the sources that stop are a prefix, so running sums find them without a loop. The windows run over
    one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn(
        "place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    ).select(
        "source", "source_size", (F.col("source_size") * epochs).alias("limit"), "place",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    )
    ratio = F.col("limit").cast("double") / F.col("weight")
    order = everything.orderBy(ratio, "place")
    before, here_on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    shares = ranked.select(
        "*", ratio.alias("ratio"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double").alias("left"),
        F.sum("weight").over(here_on).cast("double").alias("open"),
    )
    # A source stops if its limit is no more than its share of what those before it leave.
    stops = F.col("limit").cast("double") * F.col("open") <= F.col("left") * F.col("weight")
    first_open = F.min(F.when(~stops, F.struct("ratio", "place", "left", "open"))).over(everything)
    return shares.withColumn("stops", stops).withColumn("first_open", first_open).select(
        "source", "source_size",
        F.when(F.col("stops"), F.col("limit").cast("double"))
        .otherwise(F.col("weight") * F.col("first_open.left") / F.col("first_open.open")).alias("target"),
    )


def random_key(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def mix(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", key_column: str | None = None,
    weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0,
) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source, source_size, target, taken.

    ``taken`` counts words, repeats included. Of a budget of e whole epochs and r words more, every document is taken e
    times, and the documents first in the random order of their source once more, the last of these in part, so that a
    source's taken words are the whole part of its target exactly. The order is by a hash of ``key_column`` (the id by default).

    Missing texts and texts without a word have size 0 and give nothing; a missing source is a source, the last in order;
    rows repeated are documents of their own (equal ones are interchangeable, so the result is still fixed); a missing id is
    a valid id; an empty table gives no rows; other columns are ignored. Sources without a word get a target of 0.
    """
    sized = written(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"),
        random_key(seed, F.col(key_column or id_column)).alias("key"),
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix-sizes")

    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_source = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)))
        .withColumnRenamed("source", "of").join(targets(by_source, weights, epochs), F.col("of").eqNullSafe(F.col("source")))
        .select("of", F.col("range").alias("of_range"), "offset", "source_size", "target")
    )
    # Equal rows are interchangeable, so they are placed as one row with their number: a range holds at most 1 / 4096 of the keys
    # of a source, and rows that share a key (no id, or the same one) are no more than their ids and sizes.
    alike = sized.groupBy("source", "range", "key", "doc_id", "size").agg(F.count("*").alias("rows"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    words = F.col("size") * F.col("rows")
    placed = alike.withColumn("inside", F.sum(words).over(within.rowsBetween(Window.unboundedPreceding, 0)) - words)
    start = F.col("offset") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target")).cast("long")).otherwise(F.lit(0).cast("long"))
    rounds = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("whole") - F.col("rounds") * F.col("source_size")
    cut = written(
        placed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
        .withColumn("whole", whole).withColumn("rounds", rounds)
        .select("doc_id", "size", "source", "source_size", "target", "rows", "rounds", (rest - start).alias("left")), "mix-cut",
    )
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("at") * F.col("size")))
    return (
        _row_by_row(cut).withColumn("part", part)
        .select(
            "doc_id", "size", "source", "source_size", "target",
            (F.col("rounds") * F.col("size") + F.col("part")).alias("taken"),
            "rounds", "part",
        )
    )


def _row_by_row(cut: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Every one of ``rows`` equal rows again, numbered by ``at`` from 0; more than ``at_once`` are dealt out to the tasks first."""
    few = cut.where(F.col("rows") <= at_once).withColumn("first", F.lit(0).cast("long"))
    many = cut.where(F.col("rows") > at_once).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(at_once).cast("long")))
    ).repartition("doc_id", "size", "first")
    last = F.least(F.col("rows"), F.col("first") + at_once) - 1
    return few.unionByName(many).withColumn("at", F.explode(F.sequence(F.col("first"), last)))
