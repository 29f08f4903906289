"""Polling baselines: weighted means with their covariance, and the local-level filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import METHODS, poll_weight
from tallyframe.operators.polls import alr_array, complete_vectors
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.skew import spread_join


def polling_baseline(
    polls: DataFrame, keys: Sequence[str], as_of: str, half_life: float = 24.0, methods: Sequence[str] = METHODS
) -> DataFrame:
    """Centre and covariance of the complete polls of every key, under all methods in one pass.

    Rows (keys, method, i, j, center_i, center_j, covariance). A poll adds one
    product per candidate pair of its slate; the weighted sums combine on the
    map side, and the methods are columns of the same aggregation.
    """
    keys = list(keys)
    polls = polls.where(F.col("field_date").isNotNull() & (F.col("field_date") <= F.col(as_of)))
    key = [*keys, as_of]
    v = complete_vectors(polls, key)
    sizes = v.select(*key, "field_date", "sample_size")
    latest = grouped_quantiles(sizes, key, "sample_size", [0.5], [F.max("field_date").alias("_latest")])
    latest = latest.select(*key, "_latest", F.col("q0").alias("_median_n"))
    v = spread_join(v, latest, key, ["poll_id"])
    for m in methods:
        v = v.withColumn(f"w_{m}", poll_weight(m, "field_date", as_of, "sample_size", "_latest", half_life))
    pairs = v.select(*key, "_median_n", *[f"w_{m}" for m in methods], "slate", "shares", F.posexplode("shares").alias("_i", "a")).select(
        "*", F.posexplode("shares").alias("_j", "b")
    ).where(F.col("_i") <= F.col("_j"))
    sums = []
    for m in methods:
        w = F.col(f"w_{m}")
        sums += [F.sum(w).alias(f"s_{m}"), F.sum(w * F.col("a")).alias(f"a_{m}"),
                 F.sum(w * F.col("b")).alias(f"b_{m}"), F.sum(w * F.col("a") * F.col("b")).alias(f"p_{m}")]
    # Candidates are identified by their place in the (single) complete slate of the key.
    g = pairs.groupBy(*key, "_i", "_j", "slate", "_median_n").agg(
        F.count("*").alias("polls"), F.sum("a").alias("_sa"), F.sum("b").alias("_sb"), F.sum(F.col("a") * F.col("b")).alias("_sp"), *sums
    )

    def stats(m: str):
        ok = F.col(f"s_{m}") > 0
        w = F.when(ok, F.col(f"s_{m}")).otherwise(F.col("polls"))
        ca = F.when(ok, F.col(f"a_{m}")).otherwise(F.col("_sa")) / w
        cb = F.when(ok, F.col(f"b_{m}")).otherwise(F.col("_sb")) / w
        cov = F.when(ok, F.col(f"p_{m}")).otherwise(F.col("_sp")) / w - ca * cb
        return F.struct(F.lit(m).alias("method"), ca.alias("ca"), cb.alias("cb"), cov.alias("cov"))

    long = g.select(*key, "slate", "_i", "_j", "polls", "_median_n", F.explode(F.array(*[stats(m) for m in methods])).alias("s"))
    same = F.col("_i") == F.col("_j")
    spread = F.when(F.col("polls") > 1, F.col("s.cov")).otherwise(F.when(same, 0.0004).otherwise(0.0))
    c = F.col("s.ca")
    floor = F.when(same, F.greatest(c * (1 - c) / F.greatest(F.col("_median_n"), F.lit(500.0)), F.lit(1e-6))).otherwise(0.0)
    one = F.struct(
        F.element_at("slate", F.col("_i") + 1).alias("i"), F.element_at("slate", F.col("_j") + 1).alias("j"),
        F.col("s.ca").alias("center_i"), F.col("s.cb").alias("center_j"),
    )
    other = F.struct(one["j"].alias("i"), one["i"].alias("j"), one["center_j"].alias("center_i"), one["center_i"].alias("center_j"))
    return long.withColumn("covariance", 0.75 * spread + 0.25 * floor + F.when(same, 1e-7).otherwise(0.0)).select(
        *key, "s.method", "polls", "covariance",
        F.explode(F.when(same, F.array(one)).otherwise(F.array(one, other))).alias("p"),
    ).select(*key, "method", "p.*", "covariance", "polls")


def baseline_centers(baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    return baseline.where(F.col("i") == F.col("j")).select(
        *keys, "method", F.col("i").alias("candidate_id"), F.col("center_i").alias("share"),
        F.col("covariance").alias("variance"), "polls",
    )


def local_level(polls: DataFrame, keys: Sequence[str], as_of: str, forecast_date: str, process_sd: float = 0.025) -> DataFrame:
    """Random-walk filter of the log ratios of every key; mean and variance per dimension.

    Process and observation noise are isotropic, so each dimension is a scalar
    filter. Polls of one day add their precisions, so the fold runs over one
    element per day, whatever the number of polls; the first poll sets the start.
    """
    keys = list(keys)
    key = [*keys, as_of, forecast_date]
    known = polls.where(F.col("field_date").isNotNull() & (F.col("field_date") <= F.col(as_of)))
    v = complete_vectors(known, key, 1e-4)
    moe = F.coalesce(F.col("margin_error").cast("double"), F.lit(2.5))
    sd = F.greatest(F.lit(0.075), 2.5 * F.greatest(moe / 100.0 / 1.96, F.lit(0.008)))
    obs = v.withColumn("r", sd * sd).select(*key, "poll_id", "field_date", "slate", "r", F.posexplode(alr_array()).alias("dim", "y"))
    daily = obs.groupBy(*key, "slate", "dim", "field_date").agg(
        F.sum(1.0 / F.col("r")).alias("precision"),
        F.sum(F.col("y") / F.col("r")).alias("info"),
        F.min_by("y", "poll_id").alias("first"),
        F.count("*").alias("n"),
    )
    days = daily.groupBy(*key, "slate", "dim").agg(
        F.array_sort(F.collect_list(F.struct("field_date", "precision", "info", "first"))).alias("days"),
        F.sum("n").alias("polls"),
    )
    q = process_sd**2

    def step(s, d):
        p = s["p"] + q * F.datediff(d["field_date"], s["day"]).cast("double")
        precision = 1.0 / p + d["precision"]
        return F.struct(
            ((s["m"] / p + d["info"]) / precision).alias("m"), (1.0 / precision).alias("p"), d["field_date"].alias("day")
        )

    first = F.element_at("days", 1)
    start = F.struct(first["first"].alias("m"), F.lit(0.35).alias("p"), first["field_date"].alias("day"))
    ahead = F.greatest(F.datediff(F.col(forecast_date), F.col("s.day")), F.lit(0))
    return days.withColumn("s", F.aggregate("days", start, step)).select(
        *key, F.element_at("slate", F.col("dim") + 1).alias("candidate_id"), F.element_at("slate", -1).alias("reference_id"),
        F.col("s.m").alias("mean"), (F.col("s.p") + q * ahead + 1e-8).alias("variance"), "polls",
    )
