"""Running totals over rows in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def spread_count(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_totals(
    df: DataFrame, order: Sequence[str | Column], totals: dict[str, str], group: Sequence[str] = ()
) -> DataFrame:
    """Add, for every ``new: value`` of ``totals``, the sum of ``value`` over this row and those before it.

    Rows are dealt into ranges of ``order`` (``group`` columns first), written once with their range's number, and
    each range is summed by itself; the sums of earlier ranges, one row per range and group, are added. ``order``
    should be total: rows that tie are taken in any order. Null groups form a group.
    """
    keys = list(group)
    ranged = df.repartitionByRange(spread_count(df), *keys, *order).withColumn("_range", F.spark_partition_id())
    fixed = cut_lineage(ranged)
    sums = fixed.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys],
        F.col("_range").alias("_g__range"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in totals],
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = fixed.select("*", *[F.sum(v).over(within).alias(f"_l_{k}") for k, v in totals.items()])
    same = F.col("_range") == F.col("_g__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return local.join(sums, same).select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_t_{k}")).alias(k) for k in totals])
