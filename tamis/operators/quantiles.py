"""Exact quartiles of many columns at once, by narrowing down to the values that matter.

``percentile`` keeps every distinct value of a column in one task.  Instead:

1. one mergeable sketch per column brackets each quartile between two values (columns with few
   values stop here: ``percentile`` is safe once the number of values is known to be small);
2. one pass counts exactly the rows below, between and above the brackets, and keeps the values
   only inside them (about a hundredth of a large table), cut into equal-width slices;
3. the slices that hold a wanted rank are found from exact totals; while one of them holds too many
   values for a task, it is sliced again;
4. only the values of these slices are ordered, one task per slice.

Ranks are located by exact counts, so the sketch decides the amount of work, not the result.  If
it ever misses a rank, the column is done again with its extremes as the bracket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tamis.operators.local import local_table
from tamis.operators.ranks import running_before

PROBABILITIES = (0.25, 0.5, 0.75)
NAMES = ("q25", "q50", "q75")
BOUNDS = ("bas25", "haut25", "bas50", "haut50", "bas75", "haut75")
# Size of the sketch, and a margin of more than twice the rank error it is known for.
SKETCH_SIZE = 4000
MARGIN = 0.003
# A column with no more values than this may be ordered in one task.
SMALL_COLUMN = 200_000
SLICES = 4096
# No slice with more values is ordered; it is sliced again.
SLICE_VALUES = 1_000_000
OUTSIDE = -1


def rows_of(numbers: DataFrame) -> Column:
    """Number of rows: rows (c, v), or rows (c, v, n) that each stand for n."""
    return F.sum("n") if "n" in numbers.columns else F.count(F.lit(1))


def bracket() -> Column:
    """Sketch aggregate over the values ``v``."""
    return F.expr(f"kll_sketch_agg_double(v, {SKETCH_SIZE})")


def cuts_of(sketched: DataFrame) -> DataFrame:
    """Replace the column ``croquis`` by ``cuts``: lower and upper bracket of each quartile."""
    places = [p + side * MARGIN for p in PROBABILITIES for side in (-1, 1)]
    read = ", ".join(f"CAST({place:.6f} AS DOUBLE)" for place in places)
    cuts = F.when(F.col("renseignees") > 0, F.expr(f"kll_sketch_get_quantile_double(croquis, array({read}))"))
    return sketched.withColumn("cuts", cuts).drop("croquis")


def sketches(numbers: DataFrame) -> DataFrame:
    """Per column ``c``: number of values, extremes and brackets, from rows (c, v)."""
    return cuts_of(numbers.groupBy("c").agg(
        F.count("v").alias("renseignees"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        bracket().alias("croquis"),
    ))


def quartiles(numbers: DataFrame, sketched: Iterable[Row], small: int = SMALL_COLUMN) -> list[Row]:
    """Rows (c, q25, q50, q75) on the driver, one per column of the table."""
    sketched = list(sketched)
    found = exact_quartiles(numbers, sketched, small).collect()
    missed = {row["c"] for row in found if any(value is None for value in row)}
    if missed:
        wide = [
            Row(c=row["c"], renseignees=row["renseignees"], cuts=[row["minimum"], row["maximum"]] * len(NAMES))
            for row in sketched if row["c"] in missed
        ]
        found = [row for row in found if row["c"] not in missed] + exact_quartiles(numbers, wide, small).collect()
    return found


def exact_quartiles(numbers: DataFrame, sketched: Iterable[Row], small: int = SMALL_COLUMN) -> DataFrame:
    """Rows (c, q25, q50, q75), linearly interpolated, from rows (c, v double) or (c, v double, n).

    ``sketched`` holds one row per column of the table: (c, renseignees, cuts).
    """
    filled = [row for row in sketched if row["renseignees"]]
    few = [row["c"] for row in filled if row["renseignees"] <= small]
    many = [row for row in filled if row["renseignees"] > small]
    parts = []
    if few or not many:
        parts.append(
            numbers.where(F.col("c").isin(*few) & F.col("v").isNotNull()).groupBy("c")
            .agg(F.percentile("v", list(PROBABILITIES), *[F.col("n")] * ("n" in numbers.columns)).alias("q"))
            .select("c", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(NAMES)])
        )
    if many:
        parts.append(_narrowed(numbers, many))
    return reduce(DataFrame.unionByName, parts)


def _narrowed(numbers: DataFrame, sketched: Iterable[Row]) -> DataFrame:
    """The quartiles of large columns, from the values of the slices that hold a wanted rank."""
    merged, columns, chosen = small_slices(numbers, list(sketched))
    slices = local_table(
        numbers.sparkSession, [{"c": row["c"], "zone": row["zone"], "slice": row["slice"], "base": row["before"]} for row in chosen],
        "c int, zone int, slice bigint, base bigint",
    )  # at most six rows per column
    values = _holding(
        merged.join(F.broadcast(slices), ["c", "zone", "slice"]),
        columns, ["c", "zone", "slice"], ["v"], F.col("base"),
    )
    found = values.groupBy("c").agg(*_ends()).select("c", *_interpolated()).collect()  # a row per column
    merged.unpersist()
    return local_table(numbers.sparkSession, [row.asDict() for row in found], "c int, " + ", ".join(f"{name} double" for name in NAMES))


def small_slices(numbers: DataFrame, sketched: list[Row]) -> tuple[DataFrame, DataFrame, list[Row]]:
    """The counted values inside the brackets, the columns, and the slices that hold a wanted rank: none with over SLICE_VALUES values.

    Slices are of equal width. Where values crowd in one of them, as in the tail of a skewed column, its extremes become the
    bracket, and the column is sliced again: each time 4096 times finer at least, so a few rounds do for any doubles.
    """
    while True:
        columns = _local_columns(numbers, sketched)
        merged = _sliced(numbers, columns).persist()
        sizes = merged.groupBy("c", "zone", "slice").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("values"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        chosen = _holding(sizes, columns, ["c"], ["zone", "slice"], F.lit(0)).collect()  # at most six rows per column
        finer = {}
        for row in sketched:
            held = [one for one in chosen if one["c"] == row["c"]]
            if any(one["values"] > SLICE_VALUES for one in held):
                cuts = _tighter(row, held)
                if cuts != list(row["cuts"]):
                    finer[row["c"]] = Row(**{**row.asDict(), "cuts": cuts})
        if not finer:
            return merged, columns, chosen
        merged.unpersist()
        sketched = [finer.get(row["c"], row) for row in sketched]


def _tighter(row: Row, held: list[Row]) -> list[float]:
    """The brackets of a column, narrowed to the slices that hold the ranks of each quartile."""
    cuts = list(map(float, row["cuts"]))
    for i, p in enumerate(PROBABILITIES):
        place = (row["renseignees"] - 1) * p
        own = [
            one for rank in (math.floor(place), math.ceil(place)) for one in held
            if one["before"] <= rank < one["before"] + one["size"] and one["slice"] != OUTSIDE
        ]
        if own:
            cuts[2 * i : 2 * i + 2] = [min(one["low"] for one in own), max(one["high"] for one in own)]
    return cuts


def _sliced(numbers: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows (c, zone, slice, v, size): the values inside the brackets, and the number of rows outside."""
    zone, held = _placement()
    v = F.col("v")
    located = numbers.where(v.isNotNull()).join(columns.select("c", *BOUNDS), "c")
    zoned = located.select("c", zone.alias("zone"), held.alias("slice"), "v", *["n"] * ("n" in numbers.columns))
    # A cut changes the zone, so a zone lies wholly inside or wholly outside the brackets.
    return zoned.groupBy(
        "c", "zone", F.coalesce("slice", F.lit(OUTSIDE).cast("long")).alias("slice"),
        F.when(F.col("slice").isNotNull(), v).alias("v"),
    ).agg(rows_of(zoned).alias("size"))


def _local_columns(numbers: DataFrame, sketched: Iterable[Row]) -> DataFrame:
    rows = []
    for row in sketched:
        places = [(row["renseignees"] - 1) * p for p in PROBABILITIES]
        rows.append({
            "c": row["c"],
            "wanted": [rank(place) for place in places for rank in (math.floor, math.ceil)],
            "parts": [place - math.floor(place) for place in places],
            **dict(zip(BOUNDS, map(float, row["cuts"]))),
        })
    schema = "c int, wanted array<bigint>, parts array<double>, " + ", ".join(f"{name} double" for name in BOUNDS)
    # One row per column of the table, so broadcasting it is bounded by the table's width.
    return F.broadcast(local_table(numbers.sparkSession, rows, schema))


@lru_cache(maxsize=1)
def _placement() -> tuple[Column, Column]:
    """Zone of a value, increasing with it, and its slice when a bracket holds it."""
    v, zone, held = F.col("v"), F.lit(0), F.lit(None).cast("bigint")
    for i in range(len(PROBABILITIES)):
        low, high = F.col(BOUNDS[2 * i]), F.col(BOUNDS[2 * i + 1])
        zone = zone + (v >= low).cast("int") + (v > high).cast("int")
        held = F.coalesce(held, F.when((v >= low) & (v <= high), _slice(v, low, high)))
    return zone, held


def _slice(v: Column, low: Column, high: Column) -> Column:
    """Equal-width slice of a bracket; quarters keep the span from overflowing."""
    span = high / 4 - low / 4
    finite = (span > 0) & (span < float("inf"))
    place = F.floor(F.try_divide(v / 4 - low / 4, span) * SLICES)
    return F.when(finite, F.least(place, F.lit(SLICES - 1).cast("long"))).otherwise(F.lit(0).cast("long"))


def _holding(
    rows: DataFrame, columns: DataFrame, groups: list[str], order: list[str], base: Column
) -> DataFrame:
    """Keep the rows whose span of ranks holds a wanted rank; ``before`` is where the span starts."""
    spanned = rows.withColumn("before", base + running_before("size", groups, order))
    return spanned.join(columns.select("c", "wanted", "parts"), "c").where(
        F.exists("wanted", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
    )


@lru_cache(maxsize=1)
def _ends() -> list[Column]:
    def at(i: int) -> Column:
        rank = F.get("wanted", F.lit(i))
        held = (rank >= F.col("before")) & (rank < F.col("before") + F.col("size"))
        return F.max(F.when(held, F.col("v")))

    ends = [at(i).alias(f"r{i}") for i in range(2 * len(PROBABILITIES))]
    return [*ends, F.max("parts").alias("parts")]


@lru_cache(maxsize=1)
def _interpolated() -> list[Column]:
    out = []
    for i, name in enumerate(NAMES):
        low, high = F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}")
        part = F.get("parts", F.lit(i))
        # The same arithmetic as Spark's percentile, to the last bit.
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return out


def fences(found: Iterable[Row]) -> list[tuple[int, float, float]]:
    """Column, lower and upper fence at 1.5 interquartile ranges; none when the range is zero."""
    limits = []
    for row in found:
        spread = row["q75"] - row["q25"]
        if spread != 0:
            limits.append((row["c"], row["q25"] - 1.5 * spread, row["q75"] + 1.5 * spread))
    return limits


def outlier_counts(numbers: DataFrame, found: Iterable[Row]) -> DataFrame:
    """Rows (c, extremes): number of values strictly beyond the fences, from rows (c, v double)."""
    rows = [{"c": c, "low": low, "high": high} for c, low, high in fences(found)]
    limits = local_table(numbers.sparkSession, rows, "c int, low double, high double")
    weight = F.col("n") if "n" in numbers.columns else F.lit(1)
    beyond = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    return (  # the fences are one row per column of the table
        numbers.join(F.broadcast(limits), "c").groupBy("c").agg(F.sum(F.when(beyond, weight).otherwise(0)).cast("long").alias("extremes"))
    )
