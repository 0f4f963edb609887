"""Cost of metered calls from a rate card, and the models the card does not price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import fixed
from tamis.operators.local import local_table

RATE_SCHEMA = "model string, input_per_mtok double, output_per_mtok double"


def rate_card(spark: SparkSession) -> DataFrame:
    """The public tariff, in dollars per million tokens."""
    rows = [dict(zip(("model", "input_per_mtok", "output_per_mtok"), line)) for line in fixed.RATE_CARD]
    return local_table(spark, rows, RATE_SCHEMA)


def cost_in_cents(tokens_in: Column, tokens_out: Column) -> Column:
    """Cost at the joined rates; a model without a price costs nothing."""
    dollars = (tokens_in * F.col("input_per_mtok") + tokens_out * F.col("output_per_mtok")) / 1_000_000
    return F.coalesce(dollars * 100, F.lit(0.0))


def priced_usage(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows (agent, model, appels, tokens_in, tokens_out, cost_cents).

    The log is totalled per agent and model first; what meets the rate card is one row for each.
    """
    totals = usage.groupBy("agent", "model").agg(
        F.count(F.lit(1)).alias("appels"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )
    cost = cost_in_cents(F.col("tokens_in"), F.col("tokens_out"))
    return totals.join(rates, "model", "left").select(
        "agent", "model", "appels", "tokens_in", "tokens_out", F.round(cost, 4).alias("cost_cents")
    )


def rate_card_gaps(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows (model): models in use that the rate card does not price."""
    return usage.select("model").distinct().join(rates.select("model"), "model", "left_anti")
