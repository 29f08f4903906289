"""Poll tables: model form, poll-level metadata, slates and complete poll vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.functions.numeric import as_date, margin, num
from tallyframe.operators.skew import spread_join

# What a missing column of a poll table means.
DEFAULTS = {
    "collection_mode": "unknown",
    "target_population": "registered_voters",
    "undecided_share": 0.0,
    "scope": "national",
    "uf": "BR",
}
# Columns every poll table has.
REQUIRED = (
    "poll_id", "field_date", "institute", "candidate_id", "candidate_name",
    "share", "sample_size", "margin_error",
)


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def to_model_poll_schema(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Published poll rows (shares 0-1) to the model's long form (shares 0-100).

    The first row of every (poll, candidate) is kept, by ``order`` and then by
    content. A minimum over a struct does that with map-side combining, so
    copies collapse before the shuffle.
    """
    require_columns(raw, ("year", "poll_date", "pollster", "candidate_name", "share"), "raw polls")
    n = num(_optional(raw, "sample_size", 1000), 1000, lo=100.0)
    day = as_date("poll_date")
    rows = raw.where(day.isNotNull()).select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        tx.poll_id("year", "pollster", day, _optional(raw, "source_table", 0)).alias("poll_id"),
        day.alias("field_date"),
        F.col("pollster").cast("string").alias("institute"),
        tx.slug("candidate_name").alias("candidate_id"),
        F.col("candidate_name").cast("string").alias("candidate_name"),
        F.trim(F.upper(F.coalesce(_optional(raw, "party", "UNKNOWN"), F.lit("UNKNOWN")))).alias("party"),
        (num("share") * 100.0).alias("share"),
        n.cast("int").alias("sample_size"),
        margin(num(_optional(raw, "margin_error", None).cast("string")), n).alias("margin_error"),
        F.lit("unknown").alias("collection_mode"),
        F.lit("registered_voters").alias("target_population"),
        num(_optional(raw, "undecided_share", 0.0), 0.0, 0.0, 99.0).alias("undecided_share"),
        F.lit("national").alias("scope"),
        F.lit("BR").alias("uf"),
        _optional(raw, "source_url", "").alias("source_url"),
    ).where(F.col("share").isNotNull())
    keys = ["poll_id", "candidate_id"]
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    out = ["field_date", "institute", "candidate_name", "party", "share", "sample_size", "margin_error",
           "collection_mode", "target_population", "undecided_share", "scope", "uf", "source_url"]
    return kept.select(*keys, *[F.col(f"r.{c}").alias(c) for c in out])


def with_defaults(polls: DataFrame) -> DataFrame:
    """Missing optional columns filled; national polls carry the country as their place."""
    require_columns(polls, REQUIRED, "polls")
    out = polls
    for name, default in DEFAULTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default))
    return out.withColumn(
        "uf", F.when(F.col("scope") == "national", "BR").otherwise(F.coalesce("uf", F.lit("BR")))
    ).withColumn("field_date", F.to_date("field_date"))


def poll_meta(polls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per poll. Attributes constant within a poll are taken by minimum."""
    return polls.groupBy(*keys, "poll_id").agg(
        F.max("field_date").alias("field_date"),
        *[F.min(c).alias(c) for c in ("institute", "collection_mode", "target_population", "scope", "uf")],
        *[F.max(c).alias(c) for c in ("sample_size", "margin_error", "undecided_share")],
    )


def poll_signature(polls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct candidates of every poll."""
    distinct = polls.select(*keys, "poll_id", F.col("candidate_id").cast("string")).distinct()
    return distinct.groupBy(*keys, "poll_id").agg(
        F.array_sort(F.collect_list("candidate_id")).alias("signature")
    )


def poll_counts(meta: DataFrame, by: str) -> DataFrame:
    """Distinct polls per place or institute; the country row is not a place."""
    rows = meta.where(F.col("uf") != "BR") if by == "uf" else meta
    return rows.select(by, "poll_id").distinct().groupBy(by).agg(F.count("*").alias("polls"))


def poll_vectors(polls: DataFrame, keys: Sequence[str] = (), floor: float = 0.01) -> DataFrame:
    """One row per poll: metadata, the slate and the closed shares in slate order.

    Repeated (poll, candidate) rows are averaged first, with map-side combining,
    so the arrays hold one entry per candidate whatever the number of copies.
    """
    extra = [c for c in ("institute", "collection_mode", "target_population", "scope", "uf") if c in polls.columns]
    sizes = [c for c in ("sample_size", "margin_error", "undecided_share") if c in polls.columns]
    once = polls.groupBy(*keys, "poll_id", "candidate_id").agg(
        F.avg("share").alias("share"),
        F.max("field_date").alias("field_date"),
        *[F.min(c).alias(c) for c in extra],
        *[F.max(c).alias(c) for c in sizes],
    ).where(F.col("share").isNotNull())
    vector = once.groupBy(*keys, "poll_id").agg(
        F.array_sort(F.collect_list(F.struct("candidate_id", "share"))).alias("_v"),
        F.max("field_date").alias("field_date"),
        *[F.min(c).alias(c) for c in extra],
        *[F.max(c).alias(c) for c in sizes],
    )
    floored = F.transform("_v.share", lambda x: F.greatest(x, F.lit(floor)))
    total = F.aggregate("_f", F.lit(0.0), lambda a, x: a + x)
    return (
        vector.withColumn("slate", F.col("_v.candidate_id"))
        .withColumn("_f", floored)
        .withColumn("_t", total)
        .withColumn("shares", F.transform("_f", lambda x: x / F.col("_t")))
        .drop("_v", "_f", "_t")
    )


def key_slates(polls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every candidate seen under a key, in id order."""
    return (
        polls.select(*keys, "candidate_id").distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("candidate_id")).alias("slate"))
    )


def complete_vectors(polls: DataFrame, keys: Sequence[str], floor: float = 0.01) -> DataFrame:
    """Poll vectors that hold every candidate of their key."""
    return spread_join(poll_vectors(polls, keys, floor), key_slates(polls, keys), [*keys, "slate"], ["poll_id"], "left_semi")


def complete_polls(polls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the polls that hold every candidate of their key."""
    slates = key_slates(polls, keys).withColumnRenamed("slate", "signature")
    kept = spread_join(poll_signature(polls, keys), slates, [*keys, "signature"], ["poll_id"], "left_semi")
    return polls.join(kept.select(*keys, "poll_id"), [*keys, "poll_id"], "left_semi")


def incomplete_polls(polls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All polls that lack a candidate of their key."""
    sig = poll_signature(polls, keys)
    kept = key_slates(polls, keys).withColumnRenamed("slate", "signature")
    return spread_join(sig, kept, [*keys, "signature"], ["poll_id"], "left_anti").select(*keys, "poll_id")


def require_complete(polls: DataFrame, keys: Sequence[str]) -> None:
    """Fail with the first offenders if any poll lacks a candidate of its key."""
    first = incomplete_polls(polls, keys).orderBy("poll_id").limit(5).collect()  # for the error text only
    if first:
        raise ValueError(f"polls without every candidate of their key: {[r['poll_id'] for r in first]}")


def alr_array(shares: str = "shares") -> Column:
    """Log ratios of a share array to its last entry."""
    last = F.element_at(shares, -1)
    return F.transform(F.slice(F.col(shares), 1, F.size(shares) - 1), lambda x: F.log(x / last))
