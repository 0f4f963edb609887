"""Writing a table so that reading it back gives the same cells."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tamis.sources.loader import extension_of


def write_table(df: DataFrame, path: str, *, separator: str = ",") -> str:
    """Write a table in the format its path names; never over a table that is being read."""
    if extension_of(path) == ".parquet":
        df.write.parquet(path)
    else:
        (
            df.write.option("header", True).option("sep", separator).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        )
    return path
