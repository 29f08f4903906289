"""Exact quantiles by distributed selection, beside sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import quantiles as qt

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]


def sorted_quantiles(values, probs=PROBS):
    return np.quantile(np.sort(np.array(values, dtype=float)), probs).tolist()


def got(df, keys, value="x", probs=PROBS):
    rows = qt.grouped_quantiles(df, keys, value, probs).collect()
    return {tuple(r[k] for k in keys): (r["n"], [r[f"q{i}"] for i in range(len(probs))]) for r in rows}


def test_bits_keep_the_order(spark):
    values = sorted([0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, -5e-324, 1.0, 1.0000000000000002, float("inf"), float("-inf"), 3.0, -2.0])
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    rows = df.select("x", qt.ordered_bits(F.col("x")).alias("k")).withColumn("back", qt.from_bits(F.col("k"))).collect()
    assert all(a["k"] <= b["k"] for a, b in zip(rows, rows[1:])) and all(r["x"] == r["back"] for r in rows)
    assert all((a["k"] == b["k"]) == (a["x"] == b["x"]) for a, b in zip(rows, rows[1:]))


def test_five_million_values_in_one_group(spark):
    df = spark.range(0, 5_000_000, 1, 4).select(
        F.lit("one").alias("k"), F.when(F.col("id") % 7 == 0, F.lit(0.25)).otherwise((F.hash("id") / 1e3) * F.pow(F.lit(10.0), F.col("id") % 5)).alias("x")
    )
    n, q = got(df, ["k"])[("one",)]
    assert n == 5_000_000
    values = df.select("x").toPandas()["x"].to_numpy()
    assert q == pytest.approx(sorted_quantiles(values), rel=1e-12)


def test_rounds_see_few_counts(spark):
    """No round of the selection counts more ranges than its bits allow, however many values there are."""
    df = spark.range(0, 300_000, 1, 4).select((1.0 + F.col("id") / 1e6).alias("x"))
    first = df.select(F.shiftright(qt.ordered_bits(F.col("x")), qt.SHIFTS[0]).alias("p")).distinct().count()
    assert first < 100
    assert got(df, [])[()][1] == pytest.approx(sorted_quantiles([1.0 + i / 1e6 for i in range(300_000)]), rel=1e-12)


def test_small_groups_null_keys_and_nulls(spark):
    rows = [("a", None, 1.0), ("a", None, 2.0), ("a", None, None), (None, 3, -5.0), ("b", 1, None), ("c", 2, 7.0), ("c", 2, float("nan"))]
    df = spark.createDataFrame(rows, "k string, g int, x double")
    out = got(df, ["k", "g"], probs=[0.5])
    assert out[("a", None)] == (2, [1.5]) and out[(None, 3)] == (1, [-5.0]) and ("b", 1) not in out
    assert out[("c", 2)][0] == 2
    both = qt.grouped_quantiles(df, ["k", "g"], "x", [0.5], [F.count(F.lit(1)).alias("rows"), F.max("x").alias("top")])
    assert {(r["k"], r["rows"], r["n"]) for r in both.collect()} == {("a", 3, 2), (None, 1, 1), ("b", 1, None), ("c", 2, 2)}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert got(df, ["k"]) == {}
    assert got(df, [], probs=[0.5]) == {(): (None, [None])}
