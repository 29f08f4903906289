"""Exact quantiles of groups of any size, by distributed selection.

A double's bits, put in numeric order, are a 64-bit number. Three rounds count rows by its first 20, then 42, then all 64
bits: counts combine on the map side, running counts find the value ranges that hold a wanted rank, and only rows in
those ranges go on to the next round. A round never sees more than 2^20 or 2^22 counts of one range, whatever the
number of rows, and there is one path for all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.skew import spread_join
from tallyframe.session import cut_lineage

SHIFTS = (44, 22, 0)
STEP = 22


def _method(name: str, x: Column) -> Column:
    return F.java_method(F.lit("java.lang.Double"), F.lit(name), x)


def ordered_bits(x: Column) -> Column:
    """Long that orders as the double does; both zeros are one, NaN is the largest."""
    bits = _method("doubleToLongBits", x.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def from_bits(k: Column) -> Column:
    return _method("longBitsToDouble", F.when(k < 0, k.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(k)).cast("double")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two small tables on keys that may be null; without keys both have one row."""
    if not keys:
        return spread_join(a, b, [], [])
    named = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], others: Sequence[Column] = ()) -> DataFrame:
    """``keys`` plus ``n`` and ``q0, q1, ...``: linearly interpolated quantiles, nulls ignored, null keys kept.

    ``others`` are named aggregates of the same rows (those with a null value included); they add their columns.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c not in keys] if others else []
    fixed = cut_lineage(df.select(*keys, *columns, F.when(F.col(value).isNotNull(), ordered_bits(F.col(value))).alias("_k")))
    rows = fixed.select(*keys, "_k").where(F.col("_k").isNotNull())
    positions = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = [r for pos in positions for r in (F.floor(pos), F.ceil(pos))]
    wanted = None
    for shift in SHIFTS:
        part = rows.select(*keys, "_k", F.shiftright("_k", shift).alias("_p"))
        up = keys
        if wanted is not None:
            up = [*keys, "_up"]
            part = part.withColumn("_up", F.shiftright("_p", STEP))
            part = spread_join(part, wanted.select(*up), up, ["_k"], "left_semi", null_safe=True)
        counts = part.groupBy(*up, "_p").agg(F.count(F.lit(1)).alias("_c"))
        within = Window.partitionBy(*up)
        counts = counts.withColumn("_cum", F.sum("_c").over(within.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
        if wanted is None:
            asked = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ranks)])
            counts = counts.withColumn("_n", F.sum("_c").over(within)).withColumn("_asked", asked)
        else:
            counts = _same(counts, wanted, up)
        before = F.col("_cum") - F.col("_c")
        here = F.filter("_asked", lambda a: (a["r"] >= before) & (a["r"] < F.col("_cum")))
        left = F.transform(here, lambda a: F.struct(a["i"].alias("i"), (a["r"] - before).alias("r")))
        found = counts.withColumn("_asked", left).where(F.size("_asked") > 0)
        found = found.select(*keys, F.col("_p").alias("_up"), "_n", "_asked")
        wanted = found if shift == SHIFTS[-1] else cut_lineage(found)  # a row per group and wanted range at most
    hits = wanted.select(*keys, "_n", from_bits(F.col("_up")).alias("_v"), F.explode("_asked").alias("_a"))

    def at(i: int) -> Column:
        return F.max(F.when(F.col("_a.i") == i, F.col("_v")))

    def between(i: int) -> Column:
        n = F.max("_n")
        pos = F.lit(float(probs[i])) * (n - 1)
        low, high = at(2 * i), at(2 * i + 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos)))

    out = hits.groupBy(*keys).agg(F.max("_n").alias("n"), *[between(i).alias(f"q{i}") for i in range(len(probs))])
    if not others:
        return out
    every = fixed.groupBy(*keys).agg(*others)
    return _same(every, out, keys, "left")
