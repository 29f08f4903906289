"""Checks of the hierarchical fit and of the whole jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyframe.operators import fits as ft, regression as rg
from tallyframe.operators.polls import complete_polls
from tallyframe.plans import jobs, views as v
from tallyframe.plans.q_models import structural
from tallyframe.plans.q_priors import SQL_VEC, calibration_input
from tallyframe.plans.q_scalars import R
from tallyframe.plans.q_scores import CALENDAR, stored_polls, stored_snapshots
from tallyframe.plans.registry import query, r6
from tallyframe.session import cut_lineage

KEYS = ["election_year", "days_before_election"]

SQL_OBS = SQL_VEC.format(floor="0.01e0") + """, ob AS (SELECT *, ln(x / last_value(x) OVER (PARTITION BY election_year, days, poll_id ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y,
  candidate_id = max(candidate_id) OVER (PARTITION BY election_year, days) AS ref, dense_rank() OVER (PARTITION BY election_year, days ORDER BY candidate_id) - 1 AS dim,
  exp(-ln(2e0) * (cutoff - field_date) / 24e0) / pow(greatest(margin_error / 1.96e0 / 10e0, 0.08e0), 2) AS w FROM vec),
 pl AS (SELECT election_year, days, poll_id, any_value(institute) AS institute, any_value(uf) AS uf, any_value(collection_mode) AS collection_mode, any_value(target_population) AS target_population,
  any_value(w) AS w, CAST(any_value(field_date) - any_value(cutoff) AS INTEGER) AS day FROM ob GROUP BY ALL),
 tm AS (SELECT election_year, days, poll_id, w, 'intercept' AS term, 1e0 AS x FROM pl UNION ALL SELECT election_year, days, poll_id, w, 'time|trend', day / 14e0 FROM pl
  UNION ALL SELECT election_year, days, poll_id, w, 'institute|' || institute, 1e0 FROM pl UNION ALL SELECT election_year, days, poll_id, w, 'collection_mode|' || collection_mode, 1e0 FROM pl
  UNION ALL SELECT election_year, days, poll_id, w, 'target_population|' || target_population, 1e0 FROM pl UNION ALL SELECT election_year, days, poll_id, w, 'uf|' || uf, 1e0 FROM pl WHERE uf <> 'BR')"""


def obs(spark, d):
    return cut_lineage(ft.observations(stored_snapshots(spark, d), KEYS, "snapshot_date"))


@query("E01_house_effect_stats", f"""
WITH {SQL_OBS} SELECT a.election_year, a.days AS days_before_election, a.term AS i, b.term AS j, {R("sum(a.w * a.x * b.x)", "value")} FROM tm a JOIN tm b USING (election_year, days, poll_id) GROUP BY ALL
UNION ALL SELECT tm.election_year, tm.days, term, CAST(dim AS VARCHAR), {R("sum(tm.w * tm.x * y)", "value")} FROM tm JOIN ob ON ob.election_year = tm.election_year AND ob.days = tm.days AND ob.poll_id = tm.poll_id WHERE NOT ref GROUP BY ALL""", ("polls",))
def _(spark, d):
    xtx, xty = ft.house_effect_stats(obs(spark, d), KEYS)
    return xtx.select(*KEYS, "i", "j", r6("xtx", "value")).unionByName(xty.select(*KEYS, "i", F.col("dim").cast("string").alias("j"), r6("xty", "value")))


@query("E01_solve_house_effects")
def _(spark, d):
    xtx, xty = ft.house_effect_stats(obs(spark, d), KEYS)
    return ft.solve_house_effects(xtx, xty, KEYS).select(*KEYS, "term", "dim", r6("estimate"))


@query("E01_house_effect_residual", f"""
WITH {SQL_OBS} SELECT DISTINCT tm.election_year, tm.days AS days_before_election, term, CAST(dim AS INTEGER) AS dim, 0e0 AS residual
FROM tm JOIN ob ON ob.election_year = tm.election_year AND ob.days = tm.days AND ob.poll_id = tm.poll_id WHERE NOT ref""", ("polls",))
def _(spark, d):
    xtx, xty = ft.house_effect_stats(obs(spark, d), KEYS)
    return ft.house_effect_residual(xtx, xty, ft.solve_house_effects(xtx, xty, KEYS), KEYS).select(*KEYS, "term", "dim", r6("residual"))


@query("E03_reliability", f"""
WITH {SQL_OBS}, rs AS (SELECT election_year, days, poll_id, any_value(institute) AS institute, sum(pow(y, 2)) AS ss, count(*) AS n FROM ob WHERE NOT ref GROUP BY ALL),
 md AS (SELECT election_year, days, median(ss / n) + 1e-6 AS m FROM rs GROUP BY ALL)
SELECT election_year, days AS days_before_election, institute, {R("greatest(least(any_value(m) / ((8 * any_value(m) + sum(ss)) / (8 + sum(n))), 4e0), 0.2e0)", "reliability")} FROM rs JOIN md USING (election_year, days) GROUP BY election_year, days, institute""", ("polls",))
def _(spark, d):
    ss = F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)
    return ft.reliability(obs(spark, d).select(*KEYS, "institute", ss.alias("ss"), F.size("y").alias("n")), KEYS).select(*KEYS, "institute", r6("reliability"))


SQL_PAIRS = """pr AS (SELECT a.election_year, a.days, a.poll_id, a.institute, a.uf, a.day, b.institute AS other_institute, a.w AS wa, b.w AS wb, CASE WHEN a.institute = b.institute THEN 0.35e0 ELSE 0.08e0 END * exp(-abs(a.day - b.day) / 18e0)
  * CASE WHEN a.uf = b.uf THEN 1e0 WHEN a.uf = 'BR' OR b.uf = 'BR' THEN 0.65e0 ELSE 0.3e0 END AS rho FROM pl a JOIN pl b ON a.election_year = b.election_year AND a.days = b.days AND a.poll_id <> b.poll_id AND abs(a.day - b.day) <= 42)"""


@query("J05_pair_correlation", f"""
WITH {SQL_OBS}, {SQL_PAIRS}, pp AS (SELECT election_year, days, poll_id, count(*) AS partners, sum(rho) AS s FROM pr GROUP BY ALL)
SELECT pl.election_year, pl.days AS days_before_election, institute, uf, day, count(*) AS polls, CAST(coalesce(any_value(partners), 0) AS BIGINT) AS partners, {R("coalesce(any_value(s), 0)", "correlation_sum")}
FROM pl LEFT JOIN pp USING (election_year, days, poll_id) GROUP BY pl.election_year, pl.days, institute, uf, day""", ("polls",))
def _(spark, d):
    p = ft.pair_correlation(obs(spark, d), KEYS)
    return p.select(*KEYS, "institute", "uf", "day", "polls", "partners", r6("correlation_sum"))


@query("E04_pair_covariance", f"""
WITH {SQL_OBS}, {SQL_PAIRS} SELECT election_year, days AS days_before_election, institute, other_institute, {R("sum(rho / sqrt(wa * wb))", "covariance_sum")} FROM pr GROUP BY ALL""", ("polls",))
def _(spark, d):
    c = ft.pair_covariance(obs(spark, d), KEYS)
    return c.select(*KEYS, "institute", "other_institute", r6("covariance_sum")).where(F.abs("covariance_sum") > 1e-9)


@query("E02_fit_snapshots")
def _(spark, d):
    fits = ft.fit_snapshots(stored_snapshots(spark, d), KEYS, "snapshot_date").fits
    return ft.coefficients(fits, KEYS).select(*KEYS, "response", "term", "dim", r6("estimate"))


SQL_SYSTEM = f"""
WITH {SQL_OBS}, rs AS (SELECT unnest(['support', 'undecided']) AS response),
 dm AS (SELECT DISTINCT election_year, days, response, CASE response WHEN 'support' THEN CAST(dim AS INTEGER) ELSE 0 END AS dim FROM ob, rs WHERE NOT ref)
SELECT DISTINCT pl.election_year, pl.days AS days_before_election, response, 'cell|' || institute || '|' || uf || '|' || day AS equation, dim, 0e0 AS residual
FROM pl JOIN dm USING (election_year, days)
UNION ALL SELECT DISTINCT tm.election_year, tm.days, response, term, dim, 0e0 FROM tm JOIN dm USING (election_year, days)"""


def _system(spark, d, calibration=None, polls=None):
    fit = ft.fit_snapshots(stored_snapshots(spark, d, polls), KEYS, "snapshot_date", calibration=calibration)
    cells, terms = ft.normal_residuals(fit, KEYS, calibration)
    rk = [*KEYS, "response"]
    name = F.concat_ws("|", F.lit("cell"), "institute", "uf", F.col("day").cast("string"))
    return cells.select(*rk, name.alias("equation"), "dim", r6("residual")).unionByName(
        terms.select(*rk, F.col("term").alias("equation"), "dim", r6("residual")))


@query("E02_normal_residuals", SQL_SYSTEM, ("polls",))
def _(spark, d):
    return _system(spark, d)


@query("E02_calibrated_residuals", SQL_SYSTEM, ("polls",))
def _(spark, d):
    from tallyframe.operators.calibration import pollster_calibration
    polls = stored_polls(spark, d)
    return _system(spark, d, pollster_calibration(calibration_input(spark, d, polls)), polls)


@query("E02_calibrated_reliability")
def _(spark, d):
    from tallyframe.operators.calibration import pollster_calibration
    polls = stored_polls(spark, d)
    calibration = pollster_calibration(calibration_input(spark, d, polls))
    rel = ft.fit_snapshots(stored_snapshots(spark, d, polls), KEYS, "snapshot_date", calibration=calibration).reliability
    return rel.select(*KEYS, "institute", r6("reliability"))


STUDY = CALENDAR


@query("B10_run_backtest")
def _(spark, d):
    _, metrics, _ = jobs.run_backtest(stored_polls(spark, d), v.results(spark, d), STUDY, states_only=False)
    return metrics


@query("B11_compare_models")
def _(spark, d):
    records = jobs.compare_models(stored_polls(spark, d), v.results(spark, d), STUDY, states_only=False)
    return jobs.comparison_metrics(records)[1]


@query("B12_ablate_priors")
def _(spark, d):
    s = jobs.ablate_priors(stored_polls(spark, d), v.results(spark, d), STUDY, states_only=False)
    return s.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("vote_share_mae", "coverage", "winner_brier")], F.count("*").alias("observations"))


@query("B13_sensitivity_grid")
def _(spark, d):
    s = jobs.sensitivity_grid(stored_polls(spark, d), v.results(spark, d), STUDY, states_only=False)
    return s.groupBy("prior_strength").agg(*[F.avg(c).alias(c) for c in ("vote_share_mae", "coverage", "winner_brier", "interval_width")], F.count("*").alias("observations"))


@query("B13_robustness_records")
def _(spark, d):
    s = jobs.robustness_records(stored_polls(spark, d), v.results(spark, d), STUDY, states_only=False)
    return s.groupBy("model", "level").agg(*[F.avg(c).alias(c) for c in ("vote_share_mae", "coverage", "winner_brier", "interval_width")], F.count("*").alias("observations"))


FEATURES = ("poll_mean", "rejection", "incumbency", "search_share_guarded", "media_sentiment_guarded", "digital_signal_reliability")


@query("D17_predict")
def _(spark, d):
    from tallyframe.operators.priors import build_state_priors
    from tallyframe.operators.results import with_vote_share
    as_of = date(1998, 1, 1)
    p = stored_polls(spark, d).where(F.col("field_date") <= F.lit(as_of)).withColumn("election_id", F.lit("E98")).withColumn("as_of", F.lit(as_of))
    p = cut_lineage(complete_polls(p, ["election_id"]))  # the fit refuses incomplete polls; P08_incomplete_polls lists them
    # Votes are written before their names are normalised, else the optimizer normalises the name of every line.
    r = cut_lineage(with_vote_share(v.results(spark, d).where(F.col("year") == 1997), ["year", "uf"]).withColumn("election_id", F.lit("E98")))
    cand = p.select("election_id", "candidate_id", "candidate_name").distinct()
    priors = cut_lineage(build_state_priors(r, cand, ["election_id"], states_only=False).join(
        v.turnout(spark, d).where(F.col("year") == 1997).select("uf", F.col("eligible").cast("bigint").alias("registered_voters")), "uf"))
    f = v.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("candidate_id")).agg(
        (F.avg("l_tax") * 1000).alias("rejection"), (F.avg("l_linenumber") - 4).alias("ideology_score"), F.max("l_linestatus").alias("bloc"), F.lit(0).alias("incumbency"),
        (F.avg("l_quantity") + 8).alias("search_share"), (F.avg("l_discount") - 0.05).alias("media_sentiment"), F.lit(0.8).alias("search_reliability"), F.lit(0.7).alias("sentiment_reliability"),
        F.lit(0.1).alias("search_anomaly_score"), F.lit(0.2).alias("sentiment_anomaly_score"), F.lit(0.0).alias("late_decider_score"))
    f = cut_lineage(f.withColumn("election_id", F.lit("E98")).withColumn("candidate_name", F.concat(F.lit("Candidate "), "candidate_id")))
    model = rg.fit_winner(structural(spark, d), FEATURES)
    out = jobs.predict(p, f, ["election_id"], "as_of", model, 2000, 42, priors)
    return out.candidates.select("candidate_id", r6("poll_mean"), r6("ml_probability"), r6("first_round_lead_probability"), r6("win_probability"), r6("expected_first_round_share"))
