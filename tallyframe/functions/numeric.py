"""Scalar number and date expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, where an expression uses it many times."""
    return F.element_at(F.transform(F.array(c), body), 1)


def clip(c, lo=None, hi=None) -> Column:
    """Bounded value; null stays null (``greatest`` alone would drop it)."""
    c = col_of(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def child_seed(root, namespace) -> Column:
    """Stable 32-bit seed of a namespace under a root seed."""
    root = F.lit(root) if isinstance(root, int) else root
    namespace = F.lit(namespace) if isinstance(namespace, str) else namespace
    digest = F.sha2(F.concat_ws(":", root.cast("string"), namespace.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform in (0, 1) from a hash of the parts; the same under any partitioning."""
    text = F.concat_ws(":", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    word = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return (word + 0.5) / F.lit(4294967296.0)


def hash_normal(*parts) -> Column:
    """Standard normal by Box-Muller over two hash uniforms."""
    radius = F.sqrt(-2.0 * F.log(hash_uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(*parts, "a"))


def as_date(c) -> Column:
    """Date of a string or timestamp by its first ten characters."""
    return F.try_to_date(F.substring(col_of(c).cast("string"), 1, 10))


def num(c, default=None, lo=None, hi=None) -> Column:
    """Number with a default for unreadable values, then bounded."""
    value = col_of(c).cast("string").try_cast("double")
    if default is not None:
        value = F.coalesce(value, F.lit(float(default)))
    return clip(value, lo, hi)


def margin(reported, n) -> Column:
    """Reported margin of error, or the one the sample size implies."""
    reported, n = col_of(reported), col_of(n)
    return F.coalesce(F.when(reported > 0, reported), 98.0 / F.sqrt(n))


def logit(c, eps: float = 1e-5) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.log(p / (1.0 - p))


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, -30.0, 30.0)))


def recency_weight(field_date, as_of, half_life: float = 24.0) -> Column:
    """Weight that halves every ``half_life`` days; future dates count as age zero."""
    age = F.greatest(F.datediff(col_of(as_of), col_of(field_date)), F.lit(0))
    return F.exp(F.lit(-math.log(2.0)) * age / F.lit(float(half_life)))


def sample_weight(n) -> Column:
    n = F.coalesce(col_of(n).cast("double"), F.lit(1000.0))
    return F.sqrt(F.greatest(n, F.lit(100.0)) / 1000.0)


# The baseline weighting methods.
METHODS = ("latest_poll", "recency_weighted", "sample_recency_weighted", "simple_mean")


def poll_weight(method: str, field_date, as_of, n, latest, half_life: float = 24.0) -> Column:
    """Weight of a poll under one of the baseline methods."""
    if method == "simple_mean":
        return F.lit(1.0)
    if method == "recency_weighted":
        return recency_weight(field_date, as_of, half_life)
    if method == "sample_recency_weighted":
        return recency_weight(field_date, as_of, half_life) * sample_weight(n)
    if method == "latest_poll":
        return F.when(col_of(field_date) == col_of(latest), 1.0).otherwise(0.0)
    raise ValueError(f"unknown weighting method: {method}")


def base_precision(field_date, as_of, moe, half_life: float = 24.0) -> Column:
    """Recency over the sampling variance on the log-ratio scale."""
    sigma = F.greatest(col_of(moe) / 1.96 / 10.0, F.lit(0.08))
    return recency_weight(field_date, as_of, half_life) / (sigma * sigma)


def drift_level(psi) -> Column:
    psi = col_of(psi)
    return F.when(psi < 0.1, "stable").when(psi < 0.25, "watch").otherwise("drifted")
