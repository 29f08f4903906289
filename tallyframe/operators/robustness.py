"""Paired comparisons, cluster bootstrap and leave-one-election-out summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import child_seed
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.skew import global_place, join_dimension
from tallyframe.session import cut_lineage


def paired_difference(df: DataFrame, cluster: str, treatment: str, control: str, value: str, model: str = "model") -> DataFrame:
    """Treatment minus control per cluster, each averaged within the cluster first."""
    def mean_of(name):
        return F.avg(F.when(F.col(model) == name, F.col(value)))

    return df.groupBy(cluster).agg(mean_of(treatment).alias("treatment"), mean_of(control).alias("control")).where(
        F.col("treatment").isNotNull() & F.col("control").isNotNull()
    ).withColumn("difference", F.col("treatment") - F.col("control"))


def cluster_bootstrap(paired: DataFrame, draws: int = 20_000, seed: int = 42, alpha: float = 0.05, column: str = "difference", cluster: str | None = None) -> DataFrame:
    """Bootstrap of the mean difference over clusters.

    Slot ``i`` of draw ``d`` takes the cluster that a hash of (seed, d, i) names. Draws and slots are one range of
    numbers spread over the tasks; the clusters, numbered in order, are joined to them, and slots add up per draw
    on the map side. So neither the clusters nor a draw's slots are held in one place.
    """
    if draws < 100:
        raise ValueError("draws must be >= 100")
    spark = paired.sparkSession
    order = [cluster, column] if cluster else [column]
    values = cut_lineage(global_place(paired.where(F.col(column).isNotNull()).select(*order), order, "_pick").select("_pick", F.col(column).cast("double").alias("_v")))
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean")).first()
    n = whole["n"]
    if n < 2:
        raise ValueError("at least two independent clusters are required")
    slots = spark.range(draws * n).select(F.expr(f"id div {n}").alias("draw"), (F.col("id") % n).alias("slot"))
    name = F.concat_ws(":", F.col("draw").cast("string"), F.col("slot").cast("string"))
    picked = join_dimension(slots.withColumn("_pick", child_seed(F.lit(seed), name) % n), values, ["_pick"], ["draw", "slot"])
    sampled = picked.groupBy("draw").agg(F.avg("_v").alias("m"))
    out = grouped_quantiles(sampled.select("m"), [], "m", [alpha / 2, 1 - alpha / 2], [
        F.avg((F.col("m") < 0).cast("double")).alias("probability_improvement"),
        F.avg((F.col("m") > 0).cast("double")).alias("probability_positive"),
        F.count("*").alias("draws"),
    ])
    return out.select(F.lit(whole["mean"]).alias("mean_difference"), F.col("q0").alias("lower"), F.col("q1").alias("upper"),
                      "probability_improvement", "probability_positive", "draws")


def _leave_one_out(df: DataFrame, group: Sequence[str], year: str, sums: dict[str, Column]) -> DataFrame:
    """Means over all other years, from totals minus the year's own part: no row meets another.

    Years and groups (models, strengths) are short lists, so after the first
    aggregation only year x group rows remain.
    """
    per_year = df.where(F.col(year).isNotNull()).groupBy(*group, year).agg(
        *[F.sum(c).alias(f"s_{k}") for k, c in sums.items()],
        *[F.count(c).alias(f"n_{k}") for k, c in sums.items()],
        F.count("*").alias("n"),
    )
    parts = [c for c in per_year.columns if c not in (*group, year)]
    total = per_year.groupBy(*group).agg(*[F.sum(c).alias(f"t_{c}") for c in parts])
    years = per_year.agg(F.collect_set(year)).scalar()
    slots = total.withColumn("omitted", F.explode(years))
    own = per_year.withColumnRenamed(year, "omitted")
    out = slots.join(own, [*group, "omitted"], "left")
    rest = {c: F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0)) for c in parts}
    return out.select(
        *group, "omitted", rest["n"].alias("observations"),
        *[F.try_divide(rest[f"s_{k}"], F.when(rest[f"n_{k}"] > 0, rest[f"n_{k}"])).alias(k) for k in sums],
        *[F.try_divide(F.col(f"s_{k}"), F.col(f"n_{k}")).alias(f"own_{k}") for k in sums],
        F.col("n").alias("own_observations"),
    ).where(F.col("observations") > 0)


def loeo_influence(records: DataFrame, metrics: Sequence[str] = ("vote_share_mae", "coverage", "winner_brier"), year: str = "election_year") -> DataFrame:
    """Mean metrics of every model with each election left out in turn."""
    out = _leave_one_out(records, ["model"], year, {m: F.col(m) for m in metrics})
    return out.select(F.col("omitted").alias("omitted_election"), "model", *metrics, "observations")


def loeo_select(
    sensitivity: DataFrame,
    weights: dict[str, float] | None = None,
    report: Sequence[str] = ("vote_share_mae",),
    year: str = "election_year",
    strength: str = "prior_strength",
) -> DataFrame:
    """For every held-out election the best strength on the others, and its held-out score.

    ``weights`` is the objective (default: mean absolute error). Ties go to the
    smaller strength.
    """
    weights = weights or {"vote_share_mae": 1.0}
    names = list(dict.fromkeys([*weights, *report]))
    out = _leave_one_out(sensitivity, [strength], year, {m: F.col(m) for m in names})
    objective = None
    for m, w in weights.items():
        term = F.col(m) * w
        objective = term if objective is None else objective + term
    scored = out.withColumn("objective", objective)
    best = F.struct("objective", strength)
    return scored.groupBy(F.col("omitted").alias("test_election")).agg(
        F.min_by(strength, best).alias("selected_prior_strength"),
        F.min("objective").alias("train_objective"),
        *[F.min_by(f"own_{m}", best).alias(f"test_{m}") for m in report],
        F.min_by("own_observations", best).alias("test_observations"),
    )
