"""Whole jobs: back-test, model comparison, prior ablation, sensitivity grid and prediction.

Elections, horizons and model variants are key columns, so one plan covers all
of them; no driver loop runs over keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.compose import closed
from tallyframe.functions.numeric import METHODS
from tallyframe.operators import baselines as bl, candidates as cd, draws as dr, fits as ft
from tallyframe.operators import priors as pr, regression as rg, results as rs, scoring as sc, snapshots as sn
from tallyframe.operators.skew import join_dimension, spread_work
from tallyframe.session import cut_lineage

KEYS = ["election_year", "days_before_election"]
# Grid of prior strengths and the default one.
STRENGTHS = (0.5, 1.0, 2.5, 5.0, 10.0)


class Inputs(NamedTuple):
    """What every study shares: snapshots, their candidates and dates, priors and actual shares."""

    snapshots: DataFrame
    candidates: DataFrame
    dates: DataFrame
    priors: DataFrame
    actual: DataFrame
    previous: DataFrame


def study_inputs(polls: DataFrame, results: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = sn.OFFSETS, states_only: bool = True, absent: str = "null") -> Inputs:
    """Snapshots of all elections with priors from the last earlier results and the actual shares.

    ``results``: (year, round, uf, candidate_name, party, votes).
    """
    snaps = cut_lineage(sn.build_snapshots(polls, elections, offsets))
    columns = [*KEYS, "candidate_id", "candidate_name"] + (["party"] if "party" in snaps.columns else [])
    # Written before names are normalised, else the optimizer normalises the name of every poll row.
    candidates = cut_lineage(snaps.select(*columns).distinct())
    dates = cut_lineage(snaps.select(*KEYS, "snapshot_date", "scorable").distinct())
    first_round = results.where(F.col("round") == 1)
    # Votes per (year, place, candidate) are few; they are copied to the horizons, polls are not.
    votes = cut_lineage(first_round.groupBy("year", "round", "uf", "candidate_name", "party").agg(F.sum("votes").alias("votes")))
    years = votes.select("year").unionByName(dates.select(F.col("election_year").alias("year")))
    earlier = rs.previous_year(years)
    have = votes.agg(F.collect_set("year")).scalar()
    earlier = earlier.withColumn("_have", have).select(
        F.col("year").alias("election_year"), F.array_max(F.filter("_have", lambda y: y < F.col("year"))).alias("year")
    )
    horizon = dates.select(*KEYS).join(earlier, "election_year")
    previous = rs.with_vote_share(votes, ["year", "uf"]).join(horizon, "year").drop("year")
    priors = pr.build_state_priors(previous, candidates, KEYS, states_only=states_only)
    current = votes.withColumnRenamed("year", "election_year").join(dates.select(*KEYS), "election_year")
    actual = rs.actual_shares(current, candidates, KEYS, absent=absent, states_only=states_only)
    named = candidates.select(*KEYS, "candidate_id", cd.canonical_candidate("candidate_name").alias("canonical"))
    actual = actual.join(named, [*KEYS, "canonical"]).select(*KEYS, F.col("uf").alias("geo"), "candidate_id", "actual_share")
    return Inputs(snaps, candidates, dates, cut_lineage(priors), cut_lineage(actual), previous)


def with_strengths(priors: DataFrame, strengths: Sequence[float] = STRENGTHS, column: str = "prior_strength_grid") -> DataFrame:
    """The same prior shares under every strength; the level decides how much of it applies."""
    out = priors.withColumn(column, F.explode(F.array(*[F.lit(float(s)) for s in strengths])))
    s = F.col(column)
    weak = F.greatest(F.lit(0.25), 0.3 * s)
    level = (
        F.when(F.col("prior_source") == "same_candidate", s)
        .when(F.col("prior_source") == "same_party", 0.8 * s)
        .when(F.col("prior_source") == "neutral", 0.5 * weak)
        .otherwise(weak)
    )
    return out.withColumn("prior_strength", level).withColumn("prior_concentration", F.greatest(F.lit(6.0), 20.0 * level))


def fitted_draws(inputs: Inputs, n: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One fit per snapshot; returns its draws, shock roots and state poll counts."""
    ahead = "days_before_election"
    fits, _, obs, *_ = ft.fit_snapshots(
        inputs.snapshots.withColumn("_days_ahead", F.col(ahead)), KEYS, "snapshot_date", "_days_ahead",
        inputs.priors.select(*KEYS, "uf"),
    )
    draws, _ = ft.posterior_draws(fits, KEYS, n, seed)
    return draws, dr.cholesky(ft.residual_covariance(fits, KEYS), KEYS), ft.state_poll_counts(obs, KEYS)


def predictive_draws(draws: DataFrame, roots: DataFrame, counts: DataFrame, priors: DataFrame, slate: DataFrame, seed: int, variant: str | None = None) -> DataFrame:
    """Draws blended with state priors and given their predictive error, per prior variant if there is one."""
    keys = KEYS if variant is None else [*KEYS, variant]
    # Dealt by draw before the variants copy them: every later step groups within a draw and needs no further shuffle.
    draws = spread_work(draws, *KEYS, "draw_id")
    if variant is not None:
        names = priors.select(*keys).distinct()
        draws = join_dimension(draws, names.groupBy(*KEYS).agg(F.collect_list(variant).alias("_v")), KEYS, ["draw_id", "geo"])
        draws = draws.withColumn(variant, F.explode("_v")).drop("_v")
        roots, counts, slate = (x.join(names, KEYS) for x in (roots, counts, slate))
    return dr.add_predictive_error(dr.blend_state_prior(draws, priors, counts, keys, slate), roots, keys, seed)


def run_backtest(polls: DataFrame, results: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = sn.OFFSETS, n: int = 4000, seed: int = 42, states_only: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecast records of every snapshot, and their metrics per snapshot and per state."""
    inputs = study_inputs(polls, results, elections, offsets, states_only)
    draws, roots, counts = fitted_draws(inputs, n, seed)
    final = predictive_draws(draws, roots, counts, inputs.priors, inputs.candidates, seed + 1)
    records = cut_lineage(dr.forecast_records(final, inputs.actual, inputs.dates, KEYS))
    return records, sc.snapshot_metrics(records), sc.state_metrics(records)


def baseline_draws(baseline: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Draws of the polling baselines around their centre."""
    keys = list(keys)
    full = [*keys, "method"]
    roots = dr.cholesky(baseline, full)
    centers = bl.baseline_centers(baseline, keys).select(*full, "candidate_id", "share")
    slate = centers.join(roots, [*full, "candidate_id"]).groupBy(*full).agg(
        F.array_sort(F.collect_list(F.struct("candidate_id", "share", "root"))).alias("v")
    )
    rows = dr.spread_draws(slate, n)
    z = dr.normals(seed, F.size("v"), *[F.col(k) for k in full], F.col("draw_id"))
    rows = rows.withColumn("_z", z).select(*full, "draw_id", "_z", F.explode("v").alias("c"))
    x = F.col("c.share") + F.aggregate(F.zip_with("c.root", "_z", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select(*full, "draw_id", F.lit("BR").alias("geo"), F.col("c.candidate_id").alias("candidate_id"), F.greatest(x, F.lit(1e-6)).alias("_x")).withColumn(
        "share", closed(F.col("_x"), [*full, "draw_id"]) * 100.0
    ).drop("_x")


def compare_models(polls: DataFrame, results: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = (15, 7, 3, 1), n: int = 3000, seed: int = 2026, states_only: bool = True) -> DataFrame:
    """Records of the four baselines, the national model, the full model and the neutral prior."""
    inputs = study_inputs(polls, results, elections, offsets, states_only)
    base = bl.polling_baseline(inputs.snapshots, KEYS, "snapshot_date", methods=METHODS).drop("snapshot_date")
    draws, roots, counts = fitted_draws(inputs, n, seed)
    draws = cut_lineage(draws)
    neutral = pr.neutral_priors(inputs.priors, inputs.candidates, KEYS, 0.75, "neutral_ablation", national=False)
    full = predictive_draws(draws, roots, counts, inputs.priors, inputs.candidates, seed + 1)
    flat = dr.blend_state_prior(draws, neutral, counts, KEYS, inputs.candidates).where(F.col("geo") != "BR")
    model = ["model", *KEYS]
    parts = [
        baseline_draws(base, KEYS, n, seed + 2).withColumnRenamed("method", "model"),
        draws.where(F.col("geo") == "BR").withColumn("model", F.lit("hierarchical_national")),
        full.withColumn("model", F.lit("hierarchical_full")),
        flat.withColumn("model", F.lit("hierarchical_neutral_state_prior")),
    ]
    columns = [*model, "draw_id", "geo", "candidate_id", "share"]
    records = None
    for part in parts:
        r = dr.forecast_records(part.select(*columns), inputs.actual, inputs.dates.join(part.select(*model).distinct(), KEYS), model, require_votes=False)
        records = r if records is None else records.unionByName(r)
    return records


def comparison_metrics(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics per model and snapshot, and their means per model and level."""
    keys = ["model", *KEYS, "level"]
    scored = sc.scored(records)
    losses = scored.groupBy(*keys).agg(sc.log_loss("outcome", "win_probability", 1e-9).alias("log_loss"))
    metrics = sc.calibration_by_group(scored, keys, 3).join(losses, keys)
    aggregate = rs.aggregate_metrics(metrics, ["model", "level"], ["brier", "log_loss", "ece", "vote_share_mae", "interval_coverage"])
    return metrics, aggregate


def ablate_priors(polls: DataFrame, results: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = (15, 7, 3, 1), n: int = 3000, seed: int = 9090, states_only: bool = True) -> DataFrame:
    """Scores per state of the historical lean and of equal shares, from the same fits."""
    inputs = study_inputs(polls, results, elections, offsets, states_only)
    draws, roots, counts = fitted_draws(inputs, n, seed)
    priors = inputs.priors.withColumn("model", F.lit("historical_state_lean")).unionByName(
        pr.neutral_priors(inputs.priors, inputs.candidates, KEYS).withColumn("model", F.lit("neutral_state_prior"))
    )
    final = predictive_draws(draws, roots, counts, priors, inputs.candidates, seed + 1, "model").where(F.col("geo") != "BR")
    return dr.score_draws(final, inputs.actual, [*KEYS, "model"])


def sensitivity_grid(polls: DataFrame, results: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = (15, 7, 3, 1), n: int = 2000, seed: int = 12345, strengths: Sequence[float] = STRENGTHS, states_only: bool = True) -> DataFrame:
    """Scores per state under every prior strength, from the same fits."""
    inputs = study_inputs(polls, results, elections, offsets, states_only, absent="zero")
    draws, roots, counts = fitted_draws(inputs, n, seed)
    priors = with_strengths(inputs.priors, strengths, "grid_strength")
    final = predictive_draws(draws, roots, counts, priors, inputs.candidates, seed + 1, "grid_strength").where(F.col("geo") != "BR")
    return dr.score_draws(final, inputs.actual, [*KEYS, "grid_strength"]).withColumnRenamed("grid_strength", "prior_strength")


def robustness_records(polls: DataFrame, results: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = (15, 7, 3, 1), n: int = 2000, seed: int = 12345, states_only: bool = True) -> DataFrame:
    """Scores per place of the random walk, the recency mean, the full model, the neutral prior and the state lean."""
    inputs = study_inputs(polls, results, elections, offsets, states_only, absent="zero")
    walk = bl.local_level(inputs.snapshots, KEYS, "snapshot_date", "election_date").withColumn("root", F.sqrt("variance"))
    slate = walk.groupBy(*KEYS, "reference_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "mean", "root"))).alias("v"))
    rows = dr.spread_draws(slate, n)
    z = dr.normals(seed + 3, F.size("v"), *[F.col(k) for k in KEYS], F.col("draw_id"))
    latent = F.zip_with("v", z, lambda c, e: F.struct(c["candidate_id"].alias("candidate_id"), F.exp(F.least(F.greatest(c["mean"] + c["root"] * e, F.lit(-20.0)), F.lit(20.0))).alias("e")))
    last = F.array(F.struct(F.col("reference_id").alias("candidate_id"), F.lit(1.0).alias("e")))
    walk_draws = rows.select(*KEYS, "draw_id", F.explode(F.concat(latent, last)).alias("c")).select(*KEYS, "draw_id", F.lit("BR").alias("geo"), "c.candidate_id", F.col("c.e").alias("share"))
    base = bl.polling_baseline(inputs.snapshots, KEYS, "snapshot_date", methods=("recency_weighted",)).drop("snapshot_date")
    recency = cut_lineage(baseline_draws(base, KEYS, n, seed + 2).drop("method"))
    draws, roots, counts = fitted_draws(inputs, n, seed)
    priors = inputs.priors.withColumn("model", F.lit("hierarchical_full")).unionByName(
        pr.neutral_priors(inputs.priors, inputs.candidates, KEYS).withColumn("model", F.lit("neutral_state_prior"))
    )
    model = predictive_draws(draws, roots, counts, priors, inputs.candidates, seed + 1, "model")
    model = model.where((F.col("model") == "hierarchical_full") | (F.col("geo") != "BR"))
    lean = dr.project_state_lean(recency.drop("geo"), inputs.priors, KEYS)
    columns = ["model", *KEYS, "draw_id", "geo", "candidate_id", "share"]
    everything = model.select(*columns)
    for part, name in ((walk_draws, "dynamic_random_walk"), (recency, "recency_weighted"), (lean, "national_swing_state_lean")):
        everything = everything.unionByName(part.withColumn("model", F.lit(name)).select(*columns))
    out = dr.score_draws(everything, inputs.actual, ["model", *KEYS])
    return out.withColumn("level", F.when(F.col("geo") == "BR", "national").otherwise("state"))


class Prediction(NamedTuple):
    candidates: DataFrame
    states: DataFrame
    reliability: DataFrame
    diagnostics: DataFrame


def predict(
    polls: DataFrame,
    fundamentals: DataFrame,
    keys: Sequence[str],
    as_of: str,
    winner_model,
    n: int = 50_000,
    seed: int = 42,
    priors: DataFrame | None = None,
    turnout: DataFrame | None = None,
    calibration=None,
    turnout_fit=None,
    transfer_fit=None,
) -> Prediction:
    """Polls to win probabilities: fit, structural model, turnout, undecided voters and runoff."""
    keys = list(keys)
    states = None if priors is None else priors.select(*keys, "uf")
    fits, rel, obs, *_ = ft.fit_snapshots(polls, keys, as_of, states=states, calibration=calibration)
    draws, undecided = ft.posterior_draws(fits, keys, n, seed)
    if priors is not None:
        draws = dr.blend_state_prior(draws, priors, ft.state_poll_counts(obs, keys), keys, fundamentals)
    draws = cut_lineage(draws)
    national = dr.posterior_summary(draws.where(F.col("geo") == "BR"), keys)
    trend = fits.where(F.col("response") == "support").select(*keys, F.explode(F.arrays_zip("slate", "trend_14d")).alias("t")).select(
        *keys, F.col("t.slate").alias("candidate_id"), F.col("t.trend_14d").alias("poll_trend_14d")
    )
    names = polls.select(*keys, "candidate_id", "candidate_name").distinct()
    summary = national.join(trend, [*keys, "candidate_id"]).join(names, [*keys, "candidate_id"]).select(
        *keys, "candidate_id", "candidate_name", F.col("mean_share").alias("poll_mean"), F.col("lower").alias("poll_lower"),
        F.col("upper").alias("poll_upper"), F.col("uncertainty").alias("poll_uncertainty"), "poll_trend_14d",
    )
    features, problems = cd.build_feature_frame(summary, cd.guard_signals(fundamentals, keys), keys)
    broken = [r["candidate_id"] for r in problems.limit(10).collect()]
    if broken:
        raise ValueError(f"fundamentals are incomplete for: {broken}")
    scored = cut_lineage(rg.score_winner(winner_model, features, keys))
    # States are simulated where there are any; else the country as one place.
    places = draws.select(*keys, "geo").distinct()
    with_states = places.where(F.col("geo") != "BR").select(*keys).distinct().withColumn("_s", F.lit(True))

    def simulated(df: DataFrame) -> DataFrame:
        j = df.join(with_states, keys, "left")
        return j.where((F.col("geo") != "BR") | F.col("_s").isNull()).drop("_s")

    inputs = cd.turnout_inputs(simulated(places).select(F.col("geo").alias("uf")).distinct(), priors if priors is not None and "registered_voters" in priors.columns else None, turnout)
    inputs = simulated(places).withColumnRenamed("geo", "uf").join(inputs, "uf")
    if turnout_fit is not None:
        rates = rg.turnout_draws(rg.predict_turnout(turnout_fit, inputs), keys, n, seed + 101, turnout_fit.residual_sd)
    else:
        rates = rg.fallback_turnout_draws(inputs, keys, n, seed + 101)
    tilted = dr.tilt(simulated(draws), scored, keys)
    final = cut_lineage(dr.allocate_undecided(tilted, undecided, scored, keys))
    votes = cut_lineage(dr.national_votes(final, rates, keys))
    pairs = cd.pair_features(scored, keys)
    pairs = rg.predict_transfer(transfer_fit, pairs) if transfer_fit is not None else cd.fallback_transfer(pairs)
    second = cut_lineage(dr.runoff(votes, pairs, keys))
    electorate = inputs.select(*keys, F.col("uf").alias("geo"), "registered_voters")
    candidates = dr.candidate_summary(votes, second, keys).join(
        scored.select(*keys, "candidate_id", "candidate_name", "poll_mean", "poll_lower", "poll_upper", "poll_uncertainty", "ml_probability"),
        [*keys, "candidate_id"],
    )
    return Prediction(
        candidates, dr.state_summary(final, rates, keys), rel, dr.turnout_diagnostics(votes, second, electorate, keys)
    )
