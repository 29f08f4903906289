"""Compositions: closure and log-ratio transforms within a key.

A group is one composition (the candidates of one poll, draw or state), so
its size is the slate size and never grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closed(c: Column, keys: Sequence[str]) -> Column:
    total = F.sum(c).over(Window.partitionBy(*keys))
    return F.try_divide(c, total)


def close_composition(
    df: DataFrame, keys: Sequence[str], value: str, floor: float | None = None, out: str | None = None
) -> DataFrame:
    """Floor the parts and rescale them to sum to one within ``keys``."""
    part = F.col(value) if floor is None else F.greatest(F.col(value), F.lit(floor))
    return df.withColumn(out or value, closed(part, keys))


def to_alr(
    df: DataFrame, keys: Sequence[str], value: str, part: str = "candidate_id", out: str = "alr"
) -> DataFrame:
    """Log ratio of every part to the last part (greatest ``part`` id) of its composition."""
    reference = F.max_by(value, part).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.log(F.col(value) / reference))


def from_alr(
    df: DataFrame, keys: Sequence[str], value: str = "alr", out: str = "share", scale: float = 1.0
) -> DataFrame:
    """Softmax of log ratios (the reference part carries 0), scaled to ``scale``."""
    w = Window.partitionBy(*keys)
    weight = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("_e", weight).withColumn(
        out, F.col("_e") / F.sum("_e").over(w) * F.lit(float(scale))
    ).drop("_e")
