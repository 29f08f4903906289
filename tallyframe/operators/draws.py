"""Draw tables: generation, shocks, state projection, national votes, runoff and summaries.

A draws table is long: (keys, draw_id, geo, candidate_id, share in percent).
Every step groups within a draw, so work splits evenly over draws; random
numbers are hashes of (seed, key, draw, dimension) and do not depend on the
partitioning or on retries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.compose import closed
from tallyframe.functions.numeric import clip, hash_normal
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.skew import join_dimension, spread_work

BLOCK = 4096


def spread_draws(keys_df: DataFrame, n: int) -> DataFrame:
    """Every key ``n`` times with ``draw_id``; blocks of draws are spread before they unfold."""
    if n < 1:
        raise ValueError("at least one draw is required")
    if n <= BLOCK:
        return keys_df.withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    blocks = -(-n // BLOCK)
    rows = keys_df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    out = spread_work(rows, "_block")
    start = F.col("_block") * BLOCK
    return out.withColumn(
        "draw_id", F.explode(F.sequence(start, F.least(start + (BLOCK - 1), F.lit(n - 1).cast("bigint"))))
    ).drop("_block")


def normals(seed: int, dims: Column, *parts: Column) -> Column:
    """Array of standard normals, one per dimension."""
    return F.transform(F.sequence(F.lit(0), dims - 1), lambda i: hash_normal(F.lit(seed), *parts, i))


def draw_grid(keys_df: DataFrame, keys: Sequence[str], n: int, dims: int, seed: int) -> DataFrame:
    """Standard normals per (key, draw, dimension)."""
    z = normals(seed, F.lit(dims), *[F.col(k) for k in keys], F.col("draw_id"))
    return spread_draws(keys_df.select(*keys), n).select(*keys, "draw_id", F.posexplode(z).alias("dim", "z"))


def cholesky(cov: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower Cholesky rows per key of a long covariance (i, j, covariance); a group is one small matrix."""
    keys = list(keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cov.select(*keys).schema.fields)

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["i"].unique())
        m = pdf.pivot_table(index="i", columns="j", values="covariance").loc[ids, ids].to_numpy()
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        fixed = (vectors * np.clip(values, 1e-8, None)) @ vectors.T
        rows = np.linalg.cholesky(fixed)
        out = pd.DataFrame({"candidate_id": ids, "root": list(rows)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = f"{types}, candidate_id string, root array<double>" if keys else "candidate_id string, root array<double>"
    return cov.select(*keys, "i", "j", "covariance").groupBy(*keys).applyInPandas(root, schema)


def add_predictive_error(draws: DataFrame, roots: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """One correlated log-ratio shock per draw, shared by all places of the draw.

    Adding a shock in log ratios multiplies a share by its exponential, so only
    the root row of each candidate is joined (slate-sized); the last candidate
    has no row and keeps weight one.
    """
    keys = list(keys)
    out = join_dimension(draws, roots, [*keys, "candidate_id"], ["draw_id", "geo"], "left")
    # One row of a draw makes its normals, the others take them over: normals per row were most of the work.
    draw = Window.partitionBy(*keys, "draw_id")
    line = draw.orderBy("geo")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_at", F.row_number().over(line)).withColumn("_dims", F.max(F.size("root")).over(whole))
    z = F.when((F.col("_at") == 1) & (F.col("_dims") > 0), normals(seed, F.col("_dims"), *[F.col(k) for k in keys], F.col("draw_id")))
    out = out.withColumn("_z", F.max(z).over(draw))
    own = F.slice("_z", 1, F.greatest(F.size("root"), F.lit(0)))
    shock = F.aggregate(F.zip_with("root", own, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    base = closed(F.greatest(F.col("share") / 100.0, F.lit(1e-6)), [*keys, "draw_id", "geo"])
    weight = base * F.exp(F.when(F.col("root").isNotNull(), shock).otherwise(F.lit(0.0)))
    return out.withColumn("_w", weight).withColumn(
        "share", closed(F.col("_w"), [*keys, "draw_id", "geo"]) * 100.0
    ).drop("_w", "root", "_at", "_dims", "_z")


def blend_state_prior(
    draws: DataFrame, priors: DataFrame, counts: DataFrame, keys: Sequence[str], slate: DataFrame, national: str = "BR"
) -> DataFrame:
    """State draws pulled to national level plus historical lean, by their number of state polls.

    States whose prior lacks a candidate of the ``slate`` (keys, candidate_id)
    keep their draws. ``priors`` without national shares are read as absolute
    state shares.
    """
    keys = list(keys)
    place = [*keys, "geo"]
    slate = slate.select(*keys, "candidate_id").distinct()
    p = priors.withColumnRenamed("uf", "geo").join(slate, [*keys, "candidate_id"], "left_semi")
    slate = slate.groupBy(*keys).agg(F.count("*").alias("_k"))
    nat = F.col("national_prior_share") if "national_prior_share" in priors.columns else F.lit(None).cast("double")
    w = Window.partitionBy(*place)
    strength = F.avg("prior_strength").over(w) if "prior_strength" in priors.columns else F.lit(3.0)
    p = (
        p.withColumn("_np", nat)
        .withColumn("_have", F.count("prior_share").over(w)).withColumn("_have_n", F.count("_np").over(w))
        .withColumn("_sum", F.sum("prior_share").over(w)).withColumn("_sum_n", F.sum("_np").over(w))
        .withColumn("_strength", strength)
        .join(slate, keys)
        .where((F.col("_have") == F.col("_k")) & (F.col("_sum") > 0))
    )
    sp = F.log(F.greatest(F.col("prior_share") / F.col("_sum"), F.lit(1e-6)))
    lean = F.col("_have_n") == F.col("_k")
    np_ = F.log(F.greatest(F.col("_np") / F.col("_sum_n"), F.lit(1e-6)))
    p = p.select(*place, "candidate_id", "_strength", lean.alias("_lean"), F.when(lean, sp - np_).otherwise(sp).alias("_prior"))
    p = p.join(counts.withColumnRenamed("uf", "geo").withColumnRenamed("polls", "_polls"), place, "left")
    n = F.coalesce(F.col("_polls").cast("double"), F.lit(0.0))
    p = p.withColumn("_dw", n / (n + F.greatest(F.col("_strength"), F.lit(1e-6)))).drop("_polls", "_strength")
    nation = F.max(F.when(F.col("geo") == national, F.log("share"))).over(Window.partitionBy(*keys, "draw_id", "candidate_id"))
    out = join_dimension(draws.withColumn("_nat", nation), p, [*place, "candidate_id"], ["draw_id"], "left")
    target = F.when(F.col("_lean"), F.col("_nat") + F.col("_prior")).otherwise(F.col("_prior"))
    log_share = F.when(
        F.col("_prior").isNotNull(), F.col("_dw") * F.log("share") + (1 - F.col("_dw")) * target
    ).otherwise(F.log("share"))
    return out.withColumn("_e", F.exp(log_share)).withColumn(
        "share", closed(F.col("_e"), [*keys, "draw_id", "geo"]) * 100.0
    ).drop("_nat", "_prior", "_lean", "_dw", "_e")


def project_state_lean(national: DataFrame, priors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """National draws times the state-to-national ratio of the last election; an incomplete prior fails."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "uf")

    def part(c: str) -> Column:
        floored = F.greatest(F.col(c), F.lit(1e-6))
        return floored / F.sum(floored).over(w)

    lean = priors.select(
        *keys, "uf", "candidate_id",
        F.when(F.col("prior_share").isNotNull() & F.col("national_prior_share").isNotNull(),
               part("prior_share") / part("national_prior_share")).alias("_lean"),
    )
    slate = Window.partitionBy(*keys, "draw_id")
    rows = national.withColumn("_k", F.count("*").over(slate)).withColumn(
        "_s", closed(F.greatest(F.col("share"), F.lit(1e-9)), [*keys, "draw_id"])
    )
    slates = lean.groupBy(*keys, "candidate_id").agg(F.collect_list(F.struct("uf", "_lean")).alias("_l"))
    out = join_dimension(rows, slates, [*keys, "candidate_id"], ["draw_id"]).withColumn("_l", F.explode("_l")).select(
        *rows.columns, "_l.*"
    )
    full = F.count("_lean").over(Window.partitionBy(*keys, "draw_id", "uf")) == F.col("_k")
    x = F.when(full, F.greatest(F.col("_s") * F.col("_lean"), F.lit(1e-9))).otherwise(
        F.raise_error(F.concat(F.lit("incomplete state prior for "), F.col("uf"))).cast("double")
    )
    return out.withColumn("_x", x).select(
        *keys, "draw_id", F.col("uf").alias("geo"), "candidate_id",
        (closed(F.col("_x"), [*keys, "draw_id", "uf"]) * 100.0).alias("share"),
    )


def tilt(draws: DataFrame, probabilities: DataFrame, keys: Sequence[str], factor: float = 0.20) -> DataFrame:
    """Shares tilted by the structural win probability of each candidate."""
    place = [*keys, "draw_id", "geo"]
    out = join_dimension(
        draws, probabilities.select(*keys, "candidate_id", "ml_probability"), [*keys, "candidate_id"], ["draw_id", "geo"]
    )
    k = F.count("*").over(Window.partitionBy(*place))
    return out.withColumn("_x", F.col("share") * F.exp((F.col("ml_probability") - 1.0 / k) * factor)).withColumn(
        "share", closed(F.col("_x"), place) * 100.0
    ).drop("_x", "ml_probability")


def allocate_undecided(draws: DataFrame, undecided: DataFrame, fund: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final shares (0-1) after the expected allocation of undecided voters.

    ``undecided``: (keys, draw_id, geo, undecided in percent). Propensity rises
    with support, late momentum and low rejection.
    """
    keys = list(keys)
    place = [*keys, "draw_id", "geo"]
    late = F.coalesce(F.col("late_decider_score"), F.lit(0.0))
    appeal = fund.select(*keys, "candidate_id", F.exp(late + (50.0 - F.col("rejection")) / 140.0).alias("_appeal"))
    out = join_dimension(draws, appeal, [*keys, "candidate_id"], ["draw_id", "geo"]).join(undecided, place)
    s = F.col("share") / 100.0
    u = clip(F.col("undecided") / 100.0, 0.0, 0.60)
    k = F.count("*").over(Window.partitionBy(*place))
    out = out.withColumn("_k", k).withColumn("_p", closed(F.greatest(s, F.lit(1e-5)) * F.col("_appeal"), place))
    given = (70.0 * F.col("_p") + 0.5) / (70.0 + 0.5 * F.col("_k"))
    return out.withColumn("_f", s * (1 - u) + given * u).withColumn("share", closed(F.col("_f"), place)).drop(
        "_appeal", "undecided", "_k", "_p", "_f"
    )


def national_votes(final: DataFrame, turnout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Votes per draw and candidate over all states, with share and leader flag.

    ``turnout``: (keys, draw_id, geo, turnout, registered_voters).
    """
    keys = list(keys)
    votes = F.col("share") * F.col("registered_voters") * clip("turnout", 0.35, 0.95)
    n = final.join(turnout, [*keys, "draw_id", "geo"]).groupBy(*keys, "draw_id", "candidate_id").agg(F.sum(votes).alias("votes"))
    w = Window.partitionBy(*keys, "draw_id")
    rank = F.row_number().over(w.orderBy(F.desc("votes"), "candidate_id"))
    return n.withColumn("national_share", F.col("votes") / F.sum("votes").over(w) * 100.0).withColumn("leads", rank == 1)


def lead_probability(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return votes.groupBy(*keys, "candidate_id").agg(F.avg(F.col("leads").cast("double")).alias("lead_probability"))


def finalists(votes: DataFrame, keys: Sequence[str], k: int = 2) -> DataFrame:
    """Top candidates of every draw; ties go to the smaller id."""
    w = Window.partitionBy(*keys, "draw_id").orderBy(F.desc("votes"), "candidate_id")
    return votes.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def runoff(votes: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second round of every draw: votes of both finalists after transfers, winner and abstention.

    ``pairs``: (keys, [draw_id,] source_id, a_id, b_id, p_a, p_abstain).
    """
    keys = list(keys)
    ballot = votes.groupBy(*keys, "draw_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "candidate_id", "votes"))).alias("v"),
        F.sum("votes").alias("total_votes"),
    )
    sides = ballot.select(
        *keys, "draw_id", "total_votes", F.element_at("v", 1).alias("a"), F.element_at("v", 2).alias("b"),
        F.explode_outer(F.slice("v", 3, F.greatest(F.size("v") - 2, F.lit(0)))).alias("e"),
    ).select(
        *keys, "draw_id", "total_votes", F.col("a.candidate_id").alias("a_id"), F.col("a.votes").alias("_a"),
        F.col("b.candidate_id").alias("b_id"), F.col("b.votes").alias("_b"),
        F.col("e.candidate_id").alias("source_id"), F.coalesce("e.votes", F.lit(0.0)).alias("_e"),
    )
    on = [*keys, "source_id", "a_id", "b_id"] + (["draw_id"] if "draw_id" in pairs.columns else [])
    probabilities = pairs.select(*on, "p_a", "p_abstain")
    if "draw_id" in on:
        j = sides.join(probabilities, on, "left")
    else:
        j = join_dimension(sides, probabilities, on, ["draw_id"], "left")
    known = F.col("p_a").isNotNull() | F.col("source_id").isNull()
    moved = F.when(known, F.col("_e") * (1.0 - F.coalesce("p_abstain", F.lit(0.0)))).otherwise(
        F.raise_error(F.lit("no transfer probability for an eliminated candidate")).cast("double")
    )
    p = F.coalesce("p_a", F.lit(0.0))
    r = j.groupBy(*keys, "draw_id", "total_votes", "a_id", "b_id", "_a", "_b").agg(
        F.sum(moved * p).alias("_ta"), F.sum(moved * (1.0 - p)).alias("_tb"),
        F.sum(F.col("_e") * F.coalesce("p_abstain", F.lit(0.0))).alias("abstained_votes"),
    )
    r = r.withColumn("runoff_a", F.col("_a") + F.col("_ta")).withColumn("runoff_b", F.col("_b") + F.col("_tb"))
    return r.withColumn("winner_id", F.when(F.col("runoff_a") >= F.col("runoff_b"), F.col("a_id")).otherwise(F.col("b_id"))).drop(
        "_a", "_b", "_ta", "_tb"
    )


def candidate_summary(votes: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Win and lead probability and first-round share of every candidate."""
    keys = list(keys)
    first = grouped_quantiles(votes.select(*keys, "candidate_id", "leads", "national_share"), [*keys, "candidate_id"], "national_share", [0.05, 0.95], [
        F.avg(F.col("leads").cast("double")).alias("first_round_lead_probability"),
        F.avg("national_share").alias("expected_first_round_share"), F.count("*").alias("_n"),
    ]).drop("n").withColumnsRenamed({"q0": "expected_first_round_share_low", "q1": "expected_first_round_share_high"})
    wins = second.groupBy(*keys, F.col("winner_id").alias("candidate_id")).agg(F.count("*").alias("_w"))
    return first.join(wins, [*keys, "candidate_id"], "left").withColumn(
        "win_probability", F.coalesce("_w", F.lit(0)) / F.col("_n")
    ).drop("_w", "_n")


def state_summary(final: DataFrame, turnout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turnout, leading candidate and expected shares of every state."""
    keys = list(keys)
    place = [*keys, "geo"]
    w = Window.partitionBy(*place, "draw_id").orderBy(F.desc("share"), "candidate_id")
    lead = final.withColumn("_lead", (F.row_number().over(w) == 1).cast("double"))
    per = lead.groupBy(*place, "candidate_id").agg(F.avg("_lead").alias("p"), (F.avg("share") * 100.0).alias("mean"))
    first = F.min(F.struct((-F.col("p")).alias("n"), "candidate_id"))
    s = per.groupBy(*place).agg(
        first["candidate_id"].alias("leading_candidate"), (-first["n"]).alias("leader_probability"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("candidate_id", "mean")))).alias("expected_shares"),
    )
    t = grouped_quantiles(turnout.select(*place, "turnout"), place, "turnout", [0.05, 0.95], [F.avg("turnout").alias("expected_turnout")])
    t = t.select(*place, "expected_turnout", F.col("q0").alias("turnout_low"), F.col("q1").alias("turnout_high"))
    return t.join(s, place)


def turnout_diagnostics(votes: DataFrame, second: DataFrame, electorate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """National turnout of the draws and the extra abstention of the second round."""
    keys = list(keys)
    total = electorate.groupBy(*keys).agg(F.sum("registered_voters").alias("_e"))
    t = votes.groupBy(*keys, "draw_id").agg(F.sum("votes").alias("_v")).join(total, keys)
    rate = t.select(*keys, (F.col("_v") / F.col("_e")).alias("_rate"))
    first = grouped_quantiles(rate, keys, "_rate", [0.05, 0.95], [F.avg("_rate").alias("turnout_national_mean")])
    first = first.select(*keys, "turnout_national_mean", F.col("q0").alias("turnout_national_low"), F.col("q1").alias("turnout_national_high"))
    lost = F.col("abstained_votes") / F.greatest(F.col("total_votes"), F.lit(1.0))
    return first.join(second.groupBy(*keys).agg(F.avg(lost).alias("runoff_additional_abstention")), keys)


def posterior_summary(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median, 5 % and 95 % points, deviation and win probability per place and candidate."""
    place = [*keys, "geo"]
    w = Window.partitionBy(*place, "draw_id").orderBy(F.desc("share"), "candidate_id")
    led = draws.withColumn("_lead", (F.row_number().over(w) == 1).cast("double"))
    led = led.select(*place, "candidate_id", "share", "_lead")
    out = grouped_quantiles(led, [*place, "candidate_id"], "share", [0.05, 0.5, 0.95], [
        F.avg("share").alias("mean_share"), F.stddev_samp("share").alias("uncertainty"), F.avg("_lead").alias("win_probability"),
    ])
    return out.drop("n").withColumnsRenamed({"q0": "lower", "q1": "median_share", "q2": "upper"})


def posterior_interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.8) -> DataFrame:
    """Central interval and median at any level."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    a = (1.0 - level) / 2.0
    q = grouped_quantiles(df, keys, value, [a, 0.5, 1.0 - a])
    return q.select(*keys, F.col("q0").alias("low"), F.col("q1").alias("median"), F.col("q2").alias("high"))


def variance_decomposition(df: DataFrame, component: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Share of every named component in the total variance (a window row is one component)."""
    v = df.groupBy(*keys, component).agg(F.var_samp(value).alias("variance"))
    total = F.sum(F.greatest(F.coalesce("variance", F.lit(0.0)), F.lit(0.0))).over(Window.partitionBy(*keys))
    return v.withColumn("_t", total).withColumn(
        "variance_share", F.when(F.col("_t") > 0, F.col("variance") / F.col("_t")).otherwise(F.lit(0.0))
    ).drop("_t")


def effective_sample_size(df: DataFrame, weight: str, keys: Sequence[str]) -> DataFrame:
    """Number of equal weights that carry the same information; negative weights fail."""
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("weights cannot be negative")).cast("double")).otherwise(F.col(weight))
    s = df.groupBy(*keys).agg(F.sum(w).alias("_s"), F.sum(w * w).alias("_q"))
    return s.select(*keys, F.when(F.col("_s") > 0, F.col("_s") * F.col("_s") / F.col("_q")).otherwise(F.lit(0.0)).alias("effective_sample_size"))


def cov_to_corr(cov: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of a long covariance matrix (a matrix is slate-sized)."""
    keys = list(keys)
    sd = cov.where(F.col("i") == F.col("j")).select(*keys, "i", F.sqrt(F.greatest("covariance", F.lit(1e-12))).alias("_s"))
    out = cov.join(sd.withColumnRenamed("_s", "_si"), [*keys, "i"]).join(sd.select(*keys, F.col("i").alias("j"), F.col("_s").alias("_sj")), [*keys, "j"])
    c = clip(F.col("covariance") / (F.col("_si") * F.col("_sj")), -1.0, 1.0)
    return out.select(*keys, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(c).alias("correlation"))


def score_draws(draws: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error, coverage, winner score and width of every place; places without actual shares give nulls.

    ``actual``: (subset of keys + geo, candidate_id, actual_share 0-1). Percent
    draws are recognised and scaled, as shares never exceed one.
    """
    keys = list(keys)
    place = [*keys, "geo"]
    closed_draws = draws.withColumn(
        "share", closed(F.greatest(F.col("share"), F.lit(1e-9)), [*keys, "draw_id", "geo"]) * 100.0  # in the order of the steps before
    )
    s = posterior_summary(closed_draws, keys)
    on = [c for c in actual.columns if c != "actual_share"]
    j = s.join(actual, on, "left")
    w = Window.partitionBy(*place)
    top = F.max_by("candidate_id", F.struct(F.coalesce("actual_share", F.lit(-1.0)), F.col("_rev"))).over(w)
    j = j.withColumn("_rev", -F.row_number().over(w.orderBy("candidate_id"))).withColumn("_top", top)
    a = F.col("actual_share")
    m, lo, hi = (F.col(c) / 100.0 for c in ("mean_share", "lower", "upper"))
    hit = (F.col("candidate_id") == F.col("_top")).cast("double")
    any_actual = F.count("actual_share") > 0
    return j.groupBy(*place).agg(
        F.avg(F.abs(m - a)).alias("vote_share_mae"),
        F.avg(F.when(a.isNotNull(), a.between(lo, hi).cast("double"))).alias("coverage"),
        F.when(any_actual, F.avg((F.col("win_probability") - hit) * (F.col("win_probability") - hit))).alias("winner_brier"),
        F.avg(F.when(a.isNotNull(), hi - lo)).alias("interval_width"),
    )


def forecast_records(draws: DataFrame, actual: DataFrame, snaps: DataFrame, keys: Sequence[str], national: str = "BR", require_votes: bool = True) -> DataFrame:
    """Forecast, interval, actual share and outcome of every place and candidate.

    ``actual``: (subset of keys, geo, candidate_id, actual_share); ``snaps``:
    (keys, snapshot_date, scorable). The outcome marks the actual winner of a
    scoreable place (smaller id on a tie).
    """
    keys = list(keys)
    place = [*keys, "geo"]
    s = posterior_summary(draws, keys)
    on = [c for c in actual.columns if c != "actual_share"]
    j = s.join(actual, on, "left").join(snaps, keys)
    w = Window.partitionBy(*place)
    best = F.min(F.struct((-F.coalesce("actual_share", F.lit(-1.0))).alias("n"), "candidate_id")).over(w)
    known = F.count("actual_share").over(w) > 0
    if require_votes:
        known = known & (F.sum("actual_share").over(w) > 0)
    outcome = F.when(F.col("scorable") & F.col("_known"), (F.col("candidate_id") == F.col("_top.candidate_id")).cast("int"))
    return j.withColumn("_top", best).withColumn("_known", known).select(
        *keys, "snapshot_date", "scorable", F.col("geo").alias("uf"),
        F.when(F.col("geo") == national, "national").otherwise("state").alias("level"), "candidate_id",
        "win_probability", (F.col("mean_share") / 100.0).alias("predicted_share"),
        (F.col("lower") / 100.0).alias("lower"), (F.col("upper") / 100.0).alias("upper"), "actual_share", outcome.alias("outcome"),
    )
