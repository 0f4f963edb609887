"""Columns of a table as rows: which columns can be counted, and the melted form of a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, INTEGER, REAL, EXACT, MOMENT, FLAG, NESTED = (
    "text", "integer", "real", "exact", "moment", "flag", "nested",
)
NUMERIC = (INTEGER, REAL, EXACT)

# One Expand multiplies rows by this many columns at most; wider tables take several.
COLUMNS_PER_EXPAND = 64


@dataclass(frozen=True)
class ColumnRef:
    """A column of the profiled table: position, name, and family of physical type."""

    index: int
    name: str
    family: str
    spark_type: str

    @property
    def value(self) -> Column:
        """The value, with NaN folded to missing, both zeros to one, and the type widened to its family's."""
        raw = quoted(self.name)
        if self.family == INTEGER:
            return raw.cast("bigint")
        if self.family == REAL:
            wide = raw.cast("double")
            return F.when(~F.isnan(wide), F.when(wide == 0, F.lit(0.0)).otherwise(wide))  # one zero
        if self.family == EXACT:
            return raw.cast("string")  # the scale is fixed: equal texts are equal numbers
        if self.family == NESTED:
            return F.when(raw.isNotNull(), F.lit(True))
        if self.family == TEXT:
            return raw.cast("string")
        return raw

    @property
    def number(self) -> Column:
        """The value as a double, for a numeric column."""
        return self.value.cast("double")

    @property
    def printed(self) -> Column:
        """The value as text."""
        return self.value.cast("string")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return REAL
    if isinstance(kind, T.DecimalType):
        return EXACT
    if isinstance(kind, T.BooleanType):
        return FLAG
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return MOMENT
    return NESTED


def columns_of(df: DataFrame, exclude: Iterable[str] = ()) -> list[ColumnRef]:
    """The columns to examine, in table order."""
    left_out = set(exclude)
    kept = [field for field in df.schema.fields if field.name not in left_out]
    return [
        ColumnRef(i, field.name, _family(field.dataType), field.dataType.simpleString())
        for i, field in enumerate(kept)
    ]


def families(refs: Sequence[ColumnRef]) -> list[list[ColumnRef]]:
    """Columns grouped so that each group melts to a single value type."""
    groups: dict[tuple, list[ColumnRef]] = {}
    for ref in refs:
        kind = ref.spark_type if ref.family == MOMENT else ""
        groups.setdefault((ref.family, kind), []).append(ref)
    return list(groups.values())


def melt(df: DataFrame, refs: Sequence[ColumnRef], form=lambda ref: ref.value, keep=()) -> DataFrame:
    """One row per (row, column): ``c`` the column's index, ``v`` its value; missing values kept."""
    kept = [column for column, _ in keep]
    names = [name for _, name in keep]
    parts = []
    for start in range(0, len(refs), COLUMNS_PER_EXPAND):
        chunk = refs[start : start + COLUMNS_PER_EXPAND]
        narrow = df.select(
            *[column.alias(name) for column, name in zip(kept, names)],
            *[form(ref).alias(f"_{ref.index}") for ref in chunk],
        )
        rows = narrow.unpivot(names, [f"_{ref.index}" for ref in chunk], "c", "v")
        parts.append(rows.withColumn("c", F.substring("c", 2, 9).cast("int")))
    return reduce(DataFrame.unionByName, parts)
