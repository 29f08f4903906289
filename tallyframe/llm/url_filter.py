"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join of the possible hits.

A URL is looked up under the keys that a listed entry could have: each suffix of its host (whole labels) joined with
each prefix of its path that is as long as some listed path, and ``=host/path`` for single listed URLs. Keys that the
filter lacks end there; the others meet the list in an exact join. The longest rule wins; of equally long ones
``block``, then the smaller text.

Defined results: a null URL or one without ``://`` has empty host and path and is allowed; duplicate pages are judged
each for itself; an empty list allows all; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bloom
from tallyframe.operators.skew import spread_join
from tallyframe.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as entries."""
    return spark.createDataFrame(rules, "verdict string, host string, path string").select(
        F.concat("host", "path").alias("entry"), F.length("path").alias("path_len"), "verdict"
    )


def listed_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Single URLs to block, canonical: host and path without scheme, query and fragment."""
    u = F.col(column)
    return urls.select(F.concat(F.lit("="), host_of(u), path_of(u)).alias("entry"), F.lit(None).cast("int").alias("path_len"),
                       F.lit("block").alias("verdict")).distinct()


def judge_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``id_col``, host, path, rule (the rule that fits, else null), verdict, listed."""
    entries = cut_lineage(entries.groupBy("entry").agg(F.max("path_len").alias("path_len"), F.max("verdict").alias("verdict"))
                          .withColumn("_h", F.xxhash64("entry")))
    lengths = sorted(r[0] for r in entries.select("path_len").where("path_len is not null").distinct().collect())  # at most the longest path
    blocks = bloom.block_count(entries.count())
    table = cut_lineage(bloom.build(entries, "_h", blocks))
    url = F.col(url_col)
    rows = cut_lineage(pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
                       .withColumn("_row", F.monotonically_increasing_id()))
    cuts = F.array(*[F.when(F.length("path") >= n, F.lit(n)) for n in lengths]).cast("array<int>")
    cuts = F.filter(cuts, lambda n: n.isNotNull())
    keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(cuts, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    keys = F.array_distinct(F.concat(keys, F.array(F.concat(F.lit("="), F.col("host"), F.col("path")))))
    probes = rows.where("host <> ''").select("_row", F.explode(keys).alias("entry")).withColumn("_h", F.xxhash64("entry"))
    possible = bloom.flag(probes, "_h", table, blocks, "_maybe").where("_maybe").select("_row", "entry")
    hits = spread_join(possible, entries.drop("_h"), ["entry"], ["_row"])
    rule = F.col("path_len").isNotNull()
    best = hits.groupBy("_row").agg(
        F.min(F.when(rule, F.struct((-F.length("entry")).alias("n"), (F.col("verdict") != "block").alias("v"), F.col("entry").alias("rule"),
                                    F.col("verdict").alias("verdict")))).alias("_best"),
        F.max(~rule).alias("_listed"),
    )
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    return rows.join(best, "_row", "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.when(listed, "block").otherwise("allow")).alias("verdict"), listed.alias("listed"),
    )
