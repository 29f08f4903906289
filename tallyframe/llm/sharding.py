"""Contiguous shards of nearly equal bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows in order of id are summed range by range (``prefix.running_totals``); a row goes to the shard in whose share
of all bytes its middle byte lies, so shards are contiguous in id order and differ from the target by less than the
row at each cut.

Defined results: a null text has no bytes but still the constant 8; rows without an id come first; equal rows may
take each other's slots; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.prefix import running_totals
from tallyframe.session import cut_lineage

ROW_BYTES = 8


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit(1).cast("long").alias("_one"),
    )
    summed = cut_lineage(running_totals(rows, ["_id", "text_crc32", "size"], {"_bytes": "size", "_rows": "_one"}))
    total = summed.agg(F.coalesce(F.max("_bytes"), F.lit(1)).alias("t")).scalar()
    middle = 2 * F.col("_bytes") - F.col("size")  # twice the place of the row's middle
    placed = summed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total))).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_rows").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row per shard
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rows") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
