"""Mixing sources to target weights by systematic sampling.

Each source gets its weight's share of all words, but at most ``MAX_REPEAT`` times its own; what it cannot take goes
to the others by weight. A document's expected copies are target over source size. Within a source, rows in order of
size have their expected copies summed, one random offset per source and seed is added, and a row is taken once per
integer that its sum crosses. Sorting by size makes the sample of words even; a row is taken at most
``ceil(expected)`` times.

Defined results: a null text has size 0 and is taken as the others, for 0 words; rows of null source form the last source; an empty
table gives an empty table; equal rows may take each other's places; extra columns are kept by ``mix`` and ignored by
``mix_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.prefix import running_totals
from tallyframe.session import cut_lineage

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target. ``sizes`` has one row per document with source and size.

    The common level is found from running sums over sources in order of how soon they fill up.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("_w", F.element_at(weights, F.pmod(rank - 1, F.lit(len(WEIGHTS))).cast("int") + 1))
    fill = F.col("source_size") * MAX_REPEAT / F.col("_w")
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * MAX_REPEAT
    open_w = F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    per = per.withColumn("_fill", fill).withColumn("_all", F.sum("source_size").over(every))
    per = per.withColumn("_level", (F.col("_all") - full) / open_w)
    level = F.coalesce(F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(every), F.max("_fill").over(every))
    return per.select("source", "source_size", F.least(F.lit(float(MAX_REPEAT)) * F.col("source_size"), level * F.col("_w")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """Number in [0, 1) drawn per source and seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _copies(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (source, size and what identifies a row) with source_size, target and copies."""
    sizes = rows.select("source", "size")
    targets = cut_lineage(source_targets(sizes))
    others = [c for c in rows.columns if c not in ("source", "size")]
    placed = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), ["size", *others], {"_place": "_one"}, ["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    crossed = F.floor(share * F.col("_place") + u) - F.floor(share * (F.col("_place") - 1) + u)
    named = targets.withColumnRenamed("source", "_s")
    return placed.join(named, F.col("source").eqNullSafe(F.col("_s"))).select(
        *rows.columns, "source_size", "target", F.least(crossed, F.ceil(share)).cast("long").alias("copies")
    )


def mix_counts(docs: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col``, source, size, source_size, target, copies, taken."""
    rows = cut_lineage(docs.select(F.col("source"), word_count(F.col("text")).alias("size"), F.col(id_col).alias("_id")))
    out = _copies(rows, seed)
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as they are taken, all columns as they were.

    Copies of one id and text are counted together and dealt out by their number, so equal rows stay exact. Rows not
    taken at all leave before the join.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"))
    key = F.xxhash64("_all", F.lit(seed))
    named = packed.select("_all", F.col("_all")["source"].alias("source"), key.alias("_key"))
    rows = cut_lineage(named.select("source", word_count(F.col("_all")["text"]).alias("size"), F.col("_all")[id_col].alias("_id"), "_key"))
    taken = _copies(rows, seed).groupBy("_key").agg(F.sum("copies").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    joined = packed.withColumn("_key", key).join(taken.where("_n > 0"), "_key")
    per = F.col("_n") / F.col("_rows")  # equal rows differ by their number within the key
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    times = (F.floor(nth * per) - F.floor((nth - 1) * per)).cast("int")
    return joined.withColumn("_times", times).where("_times > 0").withColumn(
        "_times", F.explode(F.sequence(F.lit(1), F.col("_times")))
    ).select("_all.*")
