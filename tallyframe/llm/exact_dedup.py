"""Exact deduplication: two passes of Bloom filtering, so that only possibly repeated rows shuffle.

Pass one sets, per hash of the normalised text, the bits of a counting filter and keeps those set twice. Pass two
sends a row on to the exact grouping only if all its bits are set twice; every other row is unique for certain and
passes straight through. Groups are formed on SHA-256, copies collapse before the shuffle, and the rows of a
group of any size are never brought together.

Defined results: null and empty texts equal each other (as do texts of white space alone); a null id is larger than
any other; of rows that tie in length and id exactly one stays; an empty table gives an empty table; extra columns
of any name are kept by ``drop_copies`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import bloom
from tallyframe.operators.skew import spread_join
from tallyframe.session import cut_lineage

WHITE = " \t\n\x0b\f\r"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def _repeated(digests: DataFrame) -> tuple[DataFrame, int]:
    """Filter of the digests that may occur twice, and its number of blocks."""
    blocks = bloom.block_count(digests.count())
    hashes = digests.select(F.xxhash64("_sha").alias("_h"))
    return cut_lineage(bloom.build_repeated(hashes, "_h", blocks)), blocks


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the one with the smallest id.
    """
    text = F.col(text_col)
    digests = cut_lineage(
        docs.select(
            F.col(id_col).alias("_id"),
            F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_len"),
            text_digest(text).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),  # fixed by the write
        )
    )
    table, blocks = _repeated(digests)
    flagged = bloom.flag(digests.withColumn("_h", F.xxhash64("_sha")), "_h", table, blocks, "_maybe").drop("_h")
    suspects = flagged.where("_maybe").drop("_maybe")
    first = F.struct(F.col("_len"), -F.col("_id"), -F.col("_row"))
    groups = suspects.groupBy("_sha").agg(
        F.max_by(F.struct("_id", "_row"), first).alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    judged = spread_join(suspects, groups, ["_sha"], ["_row"]).select(
        F.col("_id"), F.col("_first._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_first._row") == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    single = flagged.where(~F.col("_maybe")).select(
        F.col("_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    return single.unionByName(judged).withColumnRenamed("_id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows that are certainly unique do not shuffle; of the others, one row per task and text does.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"))
    text = F.col("_all")[text_col]
    named = packed.withColumn("_sha", text_digest(text))
    table, blocks = _repeated(cut_lineage(named.select("_sha")))
    flagged = bloom.flag(named.withColumn("_h", F.xxhash64("_sha")), "_h", table, blocks, "_maybe")
    first = F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col("_all")[id_col], F.xxhash64("_all"))
    groups = flagged.where("_maybe").groupBy("_sha").agg(F.max_by("_all", first).alias("_all"))
    return flagged.where(~F.col("_maybe")).select("_all.*").unionByName(groups.select("_all.*"))
