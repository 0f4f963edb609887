"""State of a profile that can be kept and merged: a table grown by new files is profiled again without its old ones.

Kept are the value-frequency tables, the digests of rows with their counts, a quantile sketch for each column, and the first three
examples with their places. The state of a grown table is the sum of the old one and that of the new rows, and every measure
of a profile can be read off it exactly. It holds values of the table, so it belongs where the table does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import fixed, text
from tamis.operators import profile, quantiles
from tamis.operators.columns import NESTED, NUMERIC, ColumnRef, columns_of, families, melt, quoted
from tamis.operators.duplicates import row_digest

_ROWS, _SKETCHES, _EXAMPLES = "lignes", "croquis", "exemples"
# Examples are looked for in runs of 2^10 rows of a split.
RUN_BITS = 10


@dataclass(frozen=True)
class State:
    """The columns, and the tables by name; each table is summed over its keys."""

    refs: list[ColumnRef]
    tables: dict[str, DataFrame]

    def merged(self, other: State) -> State:
        """The state of the rows of both."""
        if self.refs != other.refs:
            raise ValueError("states of different columns cannot be merged")
        return State(self.refs, {
            name: _merged(name, mine.unionByName(other.tables[name])) for name, mine in self.tables.items()
        })

    def write(self, folder: str) -> None:
        for name, rows in self.tables.items():
            rows.write.parquet(f"{folder}/{name}")


def _name(group: Sequence[ColumnRef]) -> str:
    return f"valeurs-{group[0].family}-{group[0].index}"


def read(spark: SparkSession, folder: str, like: DataFrame, exclude: Sequence[str] = ()) -> State:
    """A written state of a table with the columns of ``like``."""
    refs = columns_of(like, exclude)
    named = [_ROWS, _SKETCHES, _EXAMPLES, *map(_name, families(refs))]
    return State(refs, {name: spark.read.parquet(f"{folder}/{name}") for name in named})


def of(df: DataFrame, place: str, exclude: Sequence[str] = ()) -> State:
    """The state of a table; the struct column ``place`` tells where a row stands (its last field counts rows), and is not part of the table."""
    refs = columns_of(df, [place, *exclude])
    usable = [ref for ref in refs if ref.family != NESTED]
    numeric = [ref for ref in refs if ref.family in NUMERIC]
    tables = {
        _ROWS: df.groupBy(row_digest(refs).alias("ligne")).agg(F.count(F.lit(1)).alias("n")),
        _EXAMPLES: _first_shown(df, usable, place),
        _SKETCHES: _sketched(melt(df, numeric, lambda ref: ref.number)) if numeric else df.sparkSession.createDataFrame([], "c int, croquis binary"),
    }
    return State(refs, tables | {_name(group): profile.counted(df, group) for group in families(refs)})


def _first_shown(df: DataFrame, refs: Sequence[ColumnRef], place: str) -> DataFrame:
    """Rows (c, place, v): the first values of each column, as displayed.

    A rank over all cells would have every task sort the cells of its split. So the runs of rows that hold a value are counted
    first; the first runs of a column, as many as it shows values, hold all of these, and only their cells are ranked.
    """
    *outer, last = df.schema[place].dataType.names
    run = F.struct(*[quoted(place)[name].alias(name) for name in outer], F.shiftright(quoted(place)[last], RUN_BITS).alias(last))
    filled = (
        melt(df, refs, lambda ref: ref.printed.isNotNull(), keep=[(run, "passage")]).where("v")
        .groupBy("c", "passage").agg(F.count(F.lit(1)).alias("n"))
    )
    runs = _ranked(filled, "passage").select("c", "passage")
    cells = melt(df, refs, lambda ref: text.shown(ref.printed), keep=[(quoted(place), "place"), (run, "passage")])
    held = cells.where("v is not null").join(F.broadcast(runs), ["c", "passage"], "left_semi")  # at most three runs a column
    return _ranked(held, "place").select("c", "place", "v")


def _ranked(rows: DataFrame, order: str) -> DataFrame:
    """The first rows of each column, as many as it shows values."""
    first = F.row_number().over(Window.partitionBy("c").orderBy(order))
    return rows.withColumn("rang", first).where(F.col("rang") <= fixed.EXAMPLE_COUNT).drop("rang")


def _sketched(numbers: DataFrame) -> DataFrame:
    return numbers.where("v is not null").groupBy("c").agg(quantiles.bracket().alias("croquis"))


def _merged(name: str, rows: DataFrame) -> DataFrame:
    """The sum of a table's parts: of counts over equal keys, of sketches and examples by column."""
    if name == _SKETCHES:
        return rows.groupBy("c").agg(F.kll_merge_agg_double("croquis", quantiles.SKETCH_SIZE).alias("croquis"))
    if name == _EXAMPLES:
        return _ranked(rows, "place")
    return rows.groupBy(*[column for column in rows.columns if column != "n"]).agg(F.sum("n").alias("n"))


def measures(state: State, whole_table: Callable[[], DataFrame]) -> DataFrame:
    """All measures of a profile and a detection, as ``profile.measure`` gives them.

    ``whole_table`` gives the table itself; it is asked for only where long texts of equal count and start tie at the places shown.
    """
    wanted = profile.EVERYTHING
    branches: list[Callable[[], list[Row]]] = []
    for group in families(state.refs):
        values = state.tables[_name(group)]
        again = lambda refs, values=values: values.where(F.col("c").isin(*[ref.index for ref in refs]))
        branches.append(lambda group=group, values=values, again=again: profile.value_measures(values, group, wanted, again, whole_table))
    if any(ref.family in NUMERIC for ref in state.refs):
        branches.append(lambda: _number_branch(state, wanted))
    branches.append(lambda: _examples(state))
    branches.append(lambda: state.tables[_ROWS].agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nb_lignes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("doublons"),
    ).withColumn("c", F.lit(-1)).collect())
    spark = next(iter(state.tables.values())).sparkSession
    return profile.gathered(spark, state.refs, branches)


def _examples(state: State) -> list[Row]:
    found: dict[int, list] = {}
    for row in state.tables[_EXAMPLES].sort("c", "place").select("c", "v").collect():  # three rows a column
        found.setdefault(row["c"], []).append(row["v"])
    return [Row(c=c, exemples=values) for c, values in found.items()]


def _number_branch(state: State, wanted: Sequence[str]) -> list[Row]:
    """Moments, quartiles and outliers from distinct numbers and how often each occurs."""
    parts = [
        state.tables[_name(group)].where("n > 0").select("c", F.col("v").cast("double").alias("v"), "n")
        for group in families(state.refs) if group[0].family in NUMERIC
    ]
    numbers = parts[0]
    for part in parts[1:]:
        numbers = numbers.unionByName(part)
    v, n = F.col("v"), F.col("n")
    simple = numbers.groupBy("c").agg(
        F.sum("n").alias("renseignees"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), (F.sum(v * n) / F.sum("n")).alias("moyenne"),
    )
    spreads = numbers.join(F.broadcast(simple.select("c", "moyenne")), "c").groupBy("c").agg(  # a row per column
        F.sqrt(F.sum(n * (v - F.col("moyenne")) ** 2) / F.sum("n")).alias("ecart_type")
    )
    measured = quantiles.cuts_of(simple.join(spreads, "c").join(state.tables[_SKETCHES], "c", "left"))
    return profile.number_measures(numbers, measured.collect(), wanted)
