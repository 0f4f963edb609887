"""Quartiles, outliers and numbering against brute force."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tamis.operators import quantiles
from tamis.operators.ranks import number_in_order


def quartiles_of(spark, values, small):
    numbers = spark.createDataFrame([(0, float(v)) for v in values], "c int, v double").repartition(3)
    (row,) = quantiles.quartiles(numbers, quantiles.sketches(numbers).collect(), small=small)
    return [row.q25, row.q50, row.q75]


CASES = {
    "spread": [random.Random(1).uniform(-1e6, 1e6) for _ in range(3000)],
    "few_values": [i % 4 for i in range(2000)],
    "one_third_equal": [5.0] * 1000 + [random.Random(2).gauss(0, 1) for _ in range(2000)],
    "huge_outlier": [1e300] + [i / 7 for i in range(1001)],
    "constant": [3.0] * 50,
    "single": [42.0],
    "pair": [1.0, 2.0],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("small", [0, 10**9])
def test_quartiles_are_exact(spark, name, small):
    values = CASES[name]
    expected = np.percentile(values, [25, 50, 75])
    assert quartiles_of(spark, values, small) == pytest.approx(list(expected), rel=1e-12)


def test_a_sketch_that_misses_does_not_change_the_result(spark):
    values = [float(i * i) for i in range(500)]
    numbers = spark.createDataFrame([(0, v) for v in values], "c int, v double")
    wrong = [Row(c=0, renseignees=500, minimum=0.0, maximum=values[-1], cuts=[7.0, 8.0] * 3)]
    (row,) = quantiles.quartiles(numbers, wrong, small=0)
    assert [row.q25, row.q50, row.q75] == pytest.approx(list(np.percentile(values, [25, 50, 75])))


def test_outliers_are_strictly_beyond_the_fences(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 7.0, -3.0, 7.0001]
    numbers = spark.createDataFrame([(0, v) for v in values], "c int, v double")
    counted = quantiles.outlier_counts(numbers, [Row(c=0, q25=1.5, q50=2.0, q75=3.5)]).collect()
    fences = (1.5 - 3.0, 3.5 + 3.0)
    assert counted[0].extremes == sum(v < fences[0] or v > fences[1] for v in values)
    assert quantiles.fences([Row(c=0, q25=2.0, q50=2.0, q75=2.0)]) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**62), unique=True, min_size=1, max_size=40))
def test_numbering_follows_positions_whatever_their_gaps(spark, positions):
    rows = [(i % 2, p) for i, p in enumerate(positions)]
    got = number_in_order(spark.createDataFrame(rows, "g int, p bigint"), ["g"], "p", "r").collect()
    for group in (0, 1):
        mine = sorted(p for g, p in rows if g == group)
        assert {(row.p, row.r) for row in got if row.g == group} == {(p, i + 1) for i, p in enumerate(mine)}


def test_numbering_by_a_composite_order(spark):
    rows = [(0, ("b", 2)), (0, ("a", 9)), (0, ("b", 1)), (1, ("z", 0)), (1, ("c", 5))]
    df = spark.createDataFrame(rows, "g int, p struct<f:string,i:int>").repartition(4)
    got = {(row.g, row.p.f, row.p.i): row.r for row in number_in_order(df, ["g"], "p", "r").collect()}
    assert got == {(0, "a", 9): 1, (0, "b", 1): 2, (0, "b", 2): 3, (1, "c", 5): 1, (1, "z", 0): 2}


def test_crowded_slices_are_sliced_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SLICE_VALUES", 40)
    # Nearly all values lie close together, and every bracket reaches far into a tail.
    tail = F.when(F.col("id") % 50 == 0, F.col("id") * 1e12).otherwise(1 + F.col("id") / 1e9)
    huge = F.when(F.col("id") % 3 == 0, -1e308).when(F.col("id") % 3 == 1, 1e308).otherwise(F.col("id") / 1e12)
    df = spark.range(20_000).select(tail.alias("a"), huge.alias("b"), (F.col("id") % 4).cast("double").alias("d"))
    numbers = df.unpivot([], ["a", "b", "d"], "c", "v").withColumn("c", F.ascii("c") - F.ascii(F.lit("a")))
    wide = [
        row for row in numbers.groupBy("c").agg(F.count("v").alias("renseignees"), F.min("v").alias("low"), F.max("v").alias("high"))
        .select("c", "renseignees", F.array("low", "high", "low", "high", "low", "high").alias("cuts")).collect()
    ]
    merged, _, chosen = quantiles.small_slices(numbers, wide)
    assert max(row["values"] for row in chosen) <= 40
    merged.unpersist()
    found = {row["c"]: [row[n] for n in quantiles.NAMES] for row in quantiles.exact_quartiles(numbers, wide, small=10).collect()}
    for c, name in ((0, "a"), (1, "b"), (3, "d")):
        assert found[c] == df.agg(F.percentile(name, [0.25, 0.5, 0.75])).head()[0]
