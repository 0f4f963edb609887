"""Small tables held on the driver: one row per column of a table, a plan, a rate card."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: Iterable[Mapping], schema: str | T.StructType) -> DataFrame:
    """A DataFrame known to the optimizer as a local relation, so that it costs no job."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.fieldNames()
    filled = [{name: row.get(name) for name in names} for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(filled, schema=to_arrow_schema(kind)), schema=kind)
