"""Forecast scores, reliability, drift and back-test summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip, col_of
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.skew import spread_join


def brier(y, p) -> Column:
    d = col_of(p) - col_of(y)
    return F.avg(d * d)


def log_loss(y, p, eps: float = 1e-12) -> Column:
    y, p = col_of(y), clip(p, eps, 1 - eps)
    return -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))


def mae(actual, forecast) -> Column:
    return F.avg(F.abs(col_of(actual) - col_of(forecast)))


def coverage(actual, lower, upper) -> Column:
    """Share of actual values inside their interval; a reversed interval fails the job."""
    a, lo, hi = col_of(actual), col_of(lower), col_of(upper)
    inside = F.coalesce((a >= lo) & (a <= hi), F.lit(False)).cast("double")
    return F.avg(F.when(lo > hi, F.raise_error(F.lit("lower interval cannot exceed upper interval")).cast("double")).otherwise(inside))


def bin_of(p, bins) -> Column:
    """Index of the equal-width bin of a probability; the last bin is closed, outside is null."""
    p = col_of(p)
    if isinstance(bins, int):
        width = 1.0 / bins
        index = reduce(lambda a, b: a + b, [(p >= F.lit(i * width)).cast("int") for i in range(1, bins)])
    else:
        steps = F.sequence(F.lit(1), bins - 1)
        index = F.size(F.filter(steps, lambda i: p >= i * (F.lit(1.0) / bins)))
    return F.when((p >= 0) & (p <= 1), index)


def scored(df: DataFrame) -> DataFrame:
    """Records that may be scored: in the scoring period, with outcome and actual share."""
    return df.where(F.col("scorable") & F.col("outcome").isNotNull() & F.col("actual_share").isNotNull())


def reliability_bins(df: DataFrame, bins: int = 10, keys: Sequence[str] = (), y: str = "outcome", p: str = "win_probability") -> DataFrame:
    """Count, mean probability and observed frequency of every non-empty bin."""
    return df.withColumn("bin", bin_of(p, bins)).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(
        F.count("*").alias("count"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_frequency")
    )


def ece(df: DataFrame, keys: Sequence[str] = (), bins: int = 10, y: str = "outcome", p: str = "win_probability") -> DataFrame:
    """Expected calibration error per key."""
    if isinstance(bins, int) and bins < 2:
        raise ValueError("bins must be at least 2")
    parts = df.withColumn("_b", bin_of(p, bins)).groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y")
    )
    gap = F.when(F.col("_b").isNotNull(), F.col("_n") * F.abs(F.col("_p") - F.col("_y")))
    return parts.groupBy(*keys).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("ece"))


def metric_columns(columns: Sequence[str], eps: float = 1e-12) -> list[Column]:
    out = [
        F.count("*").alias("observations"),
        brier("outcome", "win_probability").alias("brier"),
        log_loss("outcome", "win_probability", eps).alias("log_loss"),
    ]
    if {"actual_share", "predicted_share"} <= set(columns):
        out.append(mae("actual_share", "predicted_share").alias("vote_share_mae"))
    if {"actual_share", "lower", "upper"} <= set(columns):
        out.append(coverage("actual_share", "lower", "upper").alias("interval_coverage"))
    return out


def backtest_metrics(df: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """All scores overall or per key in one aggregation.

    Rows are pre-aggregated per (key, bin); the calibration error and the other
    means then combine from those few rows.
    """
    y, p = F.col("outcome").cast("double"), F.col("win_probability")
    q = clip(p, 1e-12, 1 - 1e-12)
    sums = {
        "brier": (p - y) * (p - y),
        "log_loss": -(y * F.log(q) + (1 - y) * F.log(1 - q)),
    }
    if {"actual_share", "predicted_share"} <= set(df.columns):
        sums["vote_share_mae"] = F.abs(F.col("actual_share") - F.col("predicted_share"))
    if {"actual_share", "lower", "upper"} <= set(df.columns):
        a, lo, hi = F.col("actual_share"), F.col("lower"), F.col("upper")
        inside = F.coalesce((a >= lo) & (a <= hi), F.lit(False)).cast("double")
        sums["interval_coverage"] = F.when(
            lo > hi, F.raise_error(F.lit("lower interval cannot exceed upper interval")).cast("double")
        ).otherwise(inside)
    parts = df.withColumn("_b", bin_of(p, bins)).groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"),
        *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()],
        *[F.count(c).alias(f"_n_{k}") for k, c in sums.items()],
    )
    gap = F.when(F.col("_b").isNotNull(), F.abs(F.col("_p") - F.col("_y")))
    return parts.groupBy(*keys).agg(
        F.sum("_n").alias("observations"),
        *[F.try_divide(F.sum(f"_s_{k}"), F.sum(f"_n_{k}")).alias(k) for k in sums],
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("calibration_error"),
    )


def calibration_by_group(df: DataFrame, keys: Sequence[str], div: int = 4) -> DataFrame:
    """Scores per group, with ``min(10, max(2, n div div))`` bins in each group."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    bins = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("_size") / div).cast("int")))
    sized = spread_join(df, size.withColumn("_bins", bins).drop("_size"), keys, df.columns, null_safe=True)
    y, p = F.col("outcome").cast("double"), F.col("win_probability")
    err = F.abs(F.col("actual_share") - F.col("predicted_share"))
    inside = F.coalesce(F.col("actual_share").between(F.col("lower"), F.col("upper")), F.lit(False)).cast("double")
    parts = sized.withColumn("_b", bin_of("win_probability", F.col("_bins"))).groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"),
        F.sum((p - y) * (p - y)).alias("_q"), F.sum(err).alias("_e"), F.sum(inside).alias("_c"),
    )
    gap = F.when(F.col("_b").isNotNull(), F.abs(F.col("_p") - F.col("_y")))
    n = F.sum("_n")
    return parts.groupBy(*keys).agg(
        n.alias("observations"), (F.sum("_q") / n).alias("brier"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / n).alias("ece"),
        (F.sum("_e") / n).alias("vote_share_mae"), (F.sum("_c") / n).alias("interval_coverage"),
    )


def snapshot_metrics(df: DataFrame, keys: Sequence[str] = ("election_year", "days_before_election", "level")) -> DataFrame:
    """Scores per snapshot and level over the scoreable records (null keys are no group)."""
    rows = scored(df)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(*metric_columns(df.columns, 1e-9))


def state_metrics(df: DataFrame, states: Sequence[str] | None = None, keys: Sequence[str] = ("election_year", "uf")) -> DataFrame:
    """Scores per state over the scoreable state records."""
    rows = scored(df).where(F.col("level") == "state")
    if states is not None:
        rows = rows.where(F.col("uf").isin(*states))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        mae("actual_share", "predicted_share").alias("vote_share_mae"),
        coverage("actual_share", "lower", "upper").alias("interval_coverage"),
        brier("outcome", "win_probability").alias("winner_brier"),
    )


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def psi(reference: DataFrame, current: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over the distinct quantile bins of the reference."""
    probs = [i / bins for i in range(bins + 1)]
    edges = grouped_quantiles(reference, keys, value, probs).select(
        *keys, F.array_sort(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)]))).alias("_edges")
    )
    x = F.col(value).cast("double")
    both = reference.select(*keys, x.alias("_x"), F.lit(1).alias("_ref")).unionByName(
        current.select(*keys, x.alias("_x"), F.lit(0).alias("_ref"))
    ).where(F.col("_x").isNotNull())
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    binned = spread_join(both, edges, keys, ["_x"], null_safe=True).withColumn("_bin", F.size(F.filter(inner, lambda e: e <= F.col("_x"))))
    counts = binned.groupBy(*keys, "_bin").agg(
        F.max(F.size("_edges")).alias("_m"), F.sum("_ref").alias("_r"), F.sum(1 - F.col("_ref")).alias("_c"),
        F.sum(F.when(F.col("_ref") == 1, F.col("_x"))).alias("_sr"), F.sum(F.when(F.col("_ref") == 0, F.col("_x"))).alias("_sc"),
    )
    w = Window.partitionBy(*keys)  # at most ``bins`` rows per key
    r = F.greatest(F.col("_r") / F.sum("_r").over(w), F.lit(eps))
    c = F.greatest(F.col("_c") / F.sum("_c").over(w), F.lit(eps))
    terms = counts.withColumn("_t", (c - r) * F.log(c / r))
    same = _close(F.sum("_sr") / F.sum("_r"), F.sum("_sc") / F.sum("_c"))
    return terms.groupBy(*keys).agg(
        F.when(F.max("_m") >= 3, F.sum("_t")).when(same, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("psi")
    )


def mean_shift(reference: DataFrame, current: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Difference of means in reference standard deviations."""
    x = F.col(value).cast("double")
    both = reference.select(*keys, x.alias("_r"), F.lit(None).cast("double").alias("_c")).unionByName(
        current.select(*keys, F.lit(None).cast("double").alias("_r"), x.alias("_c"))
    )
    scale = F.coalesce(F.stddev_samp("_r"), F.lit(0.0))
    shift = F.abs(F.avg("_c") - F.avg("_r"))
    return both.groupBy(*keys).agg(
        F.when(scale != 0, F.try_divide(shift, scale)).when(_close(F.avg("_r"), F.avg("_c")), F.lit(0.0))
        .otherwise(F.lit(float("inf"))).alias("mean_shift")
    )


def calibration_slope(df: DataFrame, keys: Sequence[str] = (), y: str = "outcome", p: str = "win_probability") -> DataFrame:
    """Calibration intercept and slope: one weighted least-squares step on the logit."""
    q = clip(p, 1e-5, 1 - 1e-5)
    x = F.log(q / (1 - q))
    w = F.greatest(q * (1 - q), F.lit(1e-4))
    t = x + (F.col(y) - q) / w
    s = df.groupBy(*keys).agg(
        F.sum(w).alias("a"), F.sum(w * x).alias("b"), F.sum(w * x * x).alias("c"),
        F.sum(w * t).alias("u"), F.sum(w * x * t).alias("v"),
    )
    a, b, c, u, v = (F.col(k) for k in "abcuv")
    det, trace2 = a * c - b * b, (a + c) * (a + c)
    regular = det > 1e-14 * trace2
    # A singular matrix (one distinct probability) has the pseudo-inverse M / trace(M)^2.
    return s.select(
        *keys,
        F.when(regular, F.try_divide(c * u - b * v, det)).otherwise(F.try_divide(a * u + b * v, trace2)).alias("intercept"),
        F.when(regular, F.try_divide(a * v - b * u, det)).otherwise(F.try_divide(b * u + c * v, trace2)).alias("slope"),
    )
