"""Pollster calibration from past errors and monotone probability calibration."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import base_precision, clip
from tallyframe.operators.polls import require_columns
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.skew import spread_join

LEVELS = ("institute", "collection_mode", "target_population")
PRIOR_DF = 8.0


class PollsterCalibration(NamedTuple):
    """``variance`` (kind, level, variance, n, global_variance), ``residual`` (i, j, correlation), ``institutes`` (left_id, right_id, correlation)."""

    variance: DataFrame
    residual: DataFrame
    institutes: DataFrame


def pollster_variance(df: DataFrame, prior_df: float = PRIOR_DF) -> DataFrame:
    """Shrunk error variance per institute, mode and population."""
    e = F.col("poll_share").cast("double") - F.col("result_share").cast("double")
    cells = df.withColumn("_e", e).groupBy(*LEVELS).agg(
        F.sum(F.col("_e") * F.col("_e")).alias("ss"), F.sum("_e").alias("s"), F.count("_e").alias("n")
    )
    mean = F.sum("s") / F.sum("n")
    total = cells.agg(
        F.greatest(F.try_divide(F.sum("ss") - F.sum("n") * mean * mean, F.sum("n") - 1), F.lit(0.25)).alias("g")
    )
    parts = cells.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("level")) for k in LEVELS])).alias("l"), "ss", "n"
    ).where(F.col("l.level").isNotNull())
    summed = parts.groupBy("l.kind", "l.level").agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    return summed.withColumn("global_variance", total.scalar()).select(
        "kind", "level", ((prior_df * F.col("global_variance") + F.col("ss")) / (prior_df + F.col("n"))).alias("variance"), "n", "global_variance"
    )


def residual_correlation(df: DataFrame) -> DataFrame:
    """Correlation of log-ratio errors between candidates, shrunk by a quarter to the identity."""
    means = df.groupBy("poll_id", "candidate_id").agg(F.avg("poll_share").alias("p"), F.avg("result_share").alias("r"))
    polls = means.where(F.col("p").isNotNull() & F.col("r").isNotNull()).groupBy("poll_id").agg(
        F.array_sort(F.collect_list(F.struct("candidate_id", "p", "r"))).alias("v")
    )
    k = means.where(F.col("p").isNotNull() & F.col("r").isNotNull()).agg(F.count_distinct("candidate_id")).scalar()
    complete = polls.where(F.size("v") == k)

    def logs(name: str) -> Column:
        return F.transform(F.col(f"v.{name}"), lambda x: F.log(F.greatest(x, F.lit(0.05))))

    error = complete.select(
        F.col("v.candidate_id").alias("ids"), F.zip_with(logs("p"), logs("r"), lambda a, b: a - b).alias("e")
    ).select("ids", F.transform(F.slice("e", 1, F.size("e") - 1), lambda x: x - F.element_at("e", -1)).alias("e"))
    pairs = error.select("ids", "e", F.posexplode("e").alias("_i", "a")).select("ids", "_i", "a", F.posexplode("e").alias("_j", "b"))
    g = pairs.groupBy(F.element_at("ids", F.col("_i") + 1).alias("i"), F.element_at("ids", F.col("_j") + 1).alias("j")).agg(
        F.corr("a", "b").alias("c"), F.count("*").alias("n")
    )
    c = F.coalesce(F.when(~F.isnan("c"), F.col("c")), F.lit(0.0))
    eye = (F.col("i") == F.col("j")).cast("double")
    return g.select("i", "j", F.when(F.col("n") >= 3, 0.75 * c + 0.25 * eye).otherwise(eye).alias("correlation"), "n")


def institute_correlation(df: DataFrame) -> DataFrame:
    """Correlation of mean errors between institutes over shared (election, candidate) cells."""
    means = df.groupBy("election_id", "institute", "candidate_id").agg(
        F.avg(F.col("poll_share").cast("double") - F.col("result_share").cast("double")).alias("e")
    )
    left = means.select("election_id", "candidate_id", F.col("institute").alias("left_id"), F.col("e").alias("le"))
    right = means.select("election_id", "candidate_id", F.col("institute").alias("right_id"), F.col("e").alias("re"))
    paired = left.join(right, ["election_id", "candidate_id"]).where(F.col("left_id") != F.col("right_id"))
    stats = paired.groupBy("left_id", "right_id").agg(
        F.corr("le", "re").alias("c"), F.count("*").alias("n"), F.stddev_samp("le").alias("sl"), F.stddev_samp("re").alias("sr")
    )
    names = means.select(F.col("institute").alias("left_id")).distinct()
    everyone = names.agg(F.collect_set("left_id")).scalar()  # one name per institute
    grid = names.select("left_id", F.explode(everyone).alias("right_id"))
    weak = F.coalesce(F.col("n"), F.lit(0)) < 8
    flat = (F.col("sl") == 0) | (F.col("sr") == 0)
    estimate = clip(F.col("c") * F.col("n") / (F.col("n") + 30.0), -0.15, 0.65)
    return grid.join(stats, ["left_id", "right_id"], "left").select(
        "left_id", "right_id",
        F.when(F.col("left_id") == F.col("right_id"), 0.55).when(weak | flat, 0.08).otherwise(estimate).alias("correlation"),
    )


def pollster_calibration(df: DataFrame, prior_df: float = PRIOR_DF) -> PollsterCalibration:
    require_columns(df, ("election_id", "poll_id", *LEVELS, "candidate_id", "poll_share", "result_share"), "calibration")
    return PollsterCalibration(pollster_variance(df, prior_df), residual_correlation(df), institute_correlation(df))


def quality_score(variance: DataFrame) -> DataFrame:
    """Historical quality of every institute from its variance relative to all."""
    score = clip(F.sqrt(F.col("global_variance") / F.greatest(F.col("variance"), F.lit(1e-9))), 0.25, 2.5)
    return variance.where(F.col("kind") == "institute").select(F.col("level").alias("institute"), score.alias("quality_score"))


def with_prior_variance(meta: DataFrame, variance: DataFrame) -> DataFrame:
    """Mean of the three level variances of every poll; unknown levels use the global one."""
    out = meta.withColumn("_g", variance.agg(F.max("global_variance")).scalar())
    for k in LEVELS:
        own = variance.where(F.col("kind") == k).select(F.col("level").alias(f"_l_{k}"), F.col("variance").alias(f"_v_{k}"))
        out = out.join(own, F.col(k).cast("string") == F.col(f"_l_{k}"), "left")
    level = [F.coalesce(f"_v_{k}", "_g") for k in LEVELS]
    return out.withColumn("prior_variance", (level[0] + level[1] + level[2]) / 3.0).drop("_g", *[f"_{x}_{k}" for k in LEVELS for x in "lv"])


def calibrated_precision(meta: DataFrame, keys, as_of: str, variance: DataFrame | None = None, half_life: float = 24.0) -> DataFrame:
    """Base precision of every poll, optionally scaled by its median-normalised calibration."""
    out = meta.withColumn("base_precision", base_precision("field_date", as_of, "margin_error", half_life))
    if variance is None:
        return out
    out = with_prior_variance(out, variance).withColumn("_pen", 1.0 / F.greatest(F.col("prior_variance"), F.lit(0.05)))
    median = grouped_quantiles(out.select(*keys, "_pen"), keys, "_pen", [0.5]).select(*keys, F.col("q0").alias("_med"))
    out = spread_join(out, median, keys, ["poll_id"])
    return out.withColumn("base_precision", F.col("base_precision") * clip(F.col("_pen") / F.col("_med"), 0.25, 4.0)).drop("_pen", "_med")


def fit_isotonic(df: DataFrame, p: str = "win_probability", y: str = "outcome") -> IsotonicRegressionModel:
    """Monotone calibration curve. Equal probabilities are merged to one weighted point first."""
    points = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("features")).agg(
        F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("weight")
    )
    ends = points.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if ends["lo"] is None or (ends["lo"] == ends["hi"] and ends["lo"] in (0.0, 1.0)):
        raise ValueError("calibration requires both outcome classes")
    return IsotonicRegression(weightCol="weight").fit(points)


def apply_isotonic(model: IsotonicRegressionModel, df: DataFrame, p: str = "win_probability", out: str = "calibrated") -> DataFrame:
    fitted = model.setFeaturesCol("_features").setPredictionCol("_prediction").transform(df.withColumn("_features", F.col(p).cast("double")))
    return fitted.withColumn(out, clip("_prediction", 0.0, 1.0)).drop("_features", "_prediction")
