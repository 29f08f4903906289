"""Joins of many rows to few facts that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

SALT = 16
BROADCAST_ROWS = 200_000


def spread_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join on ``keys`` with the rows of every key spread over ``SALT`` tasks.

    ``facts`` has one row per key and is repeated once per salt; the salt of a
    row is a hash of ``by``, so retries give the same placement. Adaptive
    execution still turns the join into a broadcast where the facts prove small.
    """
    keys = list(keys)
    if not keys:
        row = facts.select(F.struct(*facts.columns).alias("_row")).scalar()  # one aggregate row
        return rows.withColumn("_row", row).select(*rows.columns, "_row.*")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALT)))
    values = [c for c in facts.columns if c not in keys]
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>"))
    right = facts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *values, salts.alias("_r__salt"))

    def equal(k: str):
        return F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_safe else F.col(k) == F.col(f"_r_{k}")

    condition = reduce(lambda a, b: a & b, [equal(k) for k in keys], F.col("_salt") == F.col("_r__salt"))
    if how in ("left_semi", "left_anti"):
        return left.join(right, condition, how).drop("_salt")
    return left.join(right, condition, how).drop("_salt", "_r__salt", *[f"_r_{k}" for k in keys])


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of a stored table's rows: eight per split read, so that a task's share does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * df.rdd.getNumPartitions())


def spread_work(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition rows that carry much work for few bytes.

    The number is explicit, because adaptive execution merges partitions by
    bytes and would give a few heavy rows to one task.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)


def join_dimension(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to a dimension: broadcast after counting it, spread join above the limit.

    The facts are written once (they are small), counted, and only then
    broadcast, so the large side keeps its partitioning and is not shuffled.
    """
    fixed = cut_lineage(facts)
    if fixed.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(fixed), list(keys), how)
    return spread_join(rows, fixed, keys, by, how)


def global_place(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the order of all rows, without one task that sees them all.

    Rows are dealt into ranges and written with their range's number; a range is numbered by itself and moved by
    the rows of earlier ranges, one count per range.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fixed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return fixed.withColumn(name, own).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
