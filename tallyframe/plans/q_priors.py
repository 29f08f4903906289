"""Checks of priors, baselines and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import baselines as bl, calibration as ca, priors as pr, polls as po, results as rs
from tallyframe.operators.skew import join_dimension
from tallyframe.plans import views as v
from tallyframe.plans.q_scalars import R
from tallyframe.plans.q_scores import SQL_SNAP, stored_polls, stored_snapshots
from tallyframe.plans.registry import query, r6
from tallyframe.session import cut_lineage

SQL_PRIOR = """prev AS (SELECT "year" + 1 AS "year", uf, replace(candidate_name, ' ', '_') AS canonical, upper(party) AS party, votes,
  votes / sum(votes) OVER (PARTITION BY "year", uf) AS vote_share FROM sparse_results),
 cand AS (SELECT "year", replace(candidate_name, ' ', '_') AS candidate_id, candidate_name, replace(candidate_name, ' ', '_') AS canonical, upper(max(party)) AS party FROM sparse_results GROUP BY "year", candidate_name
  UNION ALL SELECT DISTINCT "year", 'novo_nome', 'Novo Nome', 'novo_nome', 'UNKNOWN' FROM sparse_results),
 k AS (SELECT "year", count(*) AS k FROM cand GROUP BY "year"),
 sc AS (SELECT "year", uf, canonical, sum(vote_share) AS s_c FROM prev GROUP BY ALL), sp AS (SELECT "year", uf, party, sum(vote_share) AS s_p FROM prev GROUP BY ALL),
 nc AS (SELECT "year", canonical, sum(votes) / (SELECT sum(votes) FROM prev p2 WHERE p2."year" = prev."year") AS n_c FROM prev GROUP BY "year", canonical),
 np AS (SELECT "year", party, sum(votes) / (SELECT sum(votes) FROM prev p2 WHERE p2."year" = prev."year") AS n_p FROM prev GROUP BY "year", party),
 gr AS (SELECT u."year", u.uf, c.candidate_id, s_c, CASE WHEN c.party <> 'UNKNOWN' THEN s_p END AS s_p, n_c, CASE WHEN c.party <> 'UNKNOWN' THEN n_p END AS n_p, 1e0 / k AS neutral
  FROM (SELECT DISTINCT "year", uf FROM prev) u JOIN cand c USING ("year") JOIN k USING ("year") LEFT JOIN sc ON sc."year" = u."year" AND sc.uf = u.uf AND sc.canonical = c.canonical
  LEFT JOIN sp ON sp."year" = u."year" AND sp.uf = u.uf AND sp.party = c.party LEFT JOIN nc ON nc."year" = u."year" AND nc.canonical = c.canonical LEFT JOIN np ON np."year" = u."year" AND np.party = c.party),
 pv AS (SELECT *, CASE WHEN s_c IS NOT NULL THEN s_c WHEN s_p IS NOT NULL THEN s_p WHEN n_c IS NOT NULL THEN n_c WHEN n_p IS NOT NULL THEN n_p ELSE neutral END AS sv,
  CASE WHEN s_c IS NOT NULL THEN coalesce(n_c, neutral) WHEN s_p IS NOT NULL THEN coalesce(n_p, neutral) WHEN n_c IS NOT NULL THEN n_c WHEN n_p IS NOT NULL THEN n_p ELSE neutral END AS nv,
  CASE WHEN s_c IS NOT NULL THEN 2.5e0 WHEN s_p IS NOT NULL THEN 2e0 WHEN n_c IS NOT NULL OR n_p IS NOT NULL THEN 0.75e0 ELSE 0.375e0 END AS strength,
  CASE WHEN s_c IS NOT NULL THEN 'same_candidate' WHEN s_p IS NOT NULL THEN 'same_party' WHEN n_c IS NOT NULL THEN 'candidate_national' WHEN n_p IS NOT NULL THEN 'party_national' ELSE 'neutral' END AS prior_source FROM gr)"""


def prior_inputs(spark, d):
    s = cut_lineage(v.sparse_results(spark, d))
    prev = rs.with_vote_share(s, ["year", "uf"]).withColumn("year", F.col("year") + 1)
    cand = s.groupBy("year", "candidate_name").agg(F.max("party").alias("party")).withColumn("candidate_id", F.translate("candidate_name", " ", "_"))
    new = s.select("year").distinct().select("year", F.lit("Novo Nome").alias("candidate_name"), F.lit("UNKNOWN").alias("party"), F.lit("novo_nome").alias("candidate_id"))
    return prev, cand.unionByName(new)


@query("B06_build_state_priors", f"""WITH {SQL_PRIOR} SELECT "year", uf, candidate_id, {R('100e0 * sv / sum(sv) OVER (PARTITION BY "year", uf)', "prior_share")},
 {R('100e0 * nv / sum(nv) OVER (PARTITION BY "year", uf)', "national_prior_share")}, {R("strength", "prior_strength")}, {R("greatest(6, strength * 20)", "prior_concentration")}, prior_source FROM pv""", ("sparse_results",))
def _(spark, d):
    prev, cand = prior_inputs(spark, d)
    return pr.build_state_priors(prev, cand, ["year"], states_only=False).select(
        "year", "uf", "candidate_id", r6("prior_share"), r6("national_prior_share"), r6("prior_strength"), r6("prior_concentration"), "prior_source")


@query("J08_priority_lookup", f"""WITH {SQL_PRIOR} SELECT "year", prior_source, count(*) AS n FROM pv GROUP BY ALL""", ("sparse_results",))
def _(spark, d):
    prev, cand = prior_inputs(spark, d)
    return pr.build_state_priors(prev, cand, ["year"], states_only=False).groupBy("year", "prior_source").agg(F.count("*").alias("n"))


@query("J12_neutral_priors", f"""
WITH c AS (SELECT DISTINCT "year", candidate_id FROM results), n AS (SELECT "year", count(*) AS k FROM c GROUP BY "year"), s AS (SELECT DISTINCT "year", uf FROM results)
SELECT "year", uf, candidate_id, {R("100e0 / k", "prior_share")}, {R("50", "prior_concentration")} FROM s JOIN c USING ("year") JOIN n USING ("year")""", ("results",))
def _(spark, d):
    r = v.results(spark, d)
    return pr.neutral_priors(r, r.select("year", "candidate_id", "candidate_name").distinct(), ["year"]).select("year", "uf", "candidate_id", r6("prior_share"), r6("prior_concentration"))


SQL_VEC = f"""{SQL_SNAP}, kk AS (SELECT election_year, days, count(DISTINCT candidate_id) AS k FROM snap GROUP BY ALL),
 cp AS (SELECT election_year, days, poll_id FROM snap JOIN kk USING (election_year, days) GROUP BY ALL HAVING count(DISTINCT candidate_id) = any_value(k)),
 vec AS (SELECT snap.*, greatest(share, {{floor}}) / sum(greatest(share, {{floor}})) OVER (PARTITION BY election_year, days, poll_id) AS x FROM snap JOIN cp USING (election_year, days, poll_id))"""


@query("E05_polling_baseline", f"""
WITH {SQL_VEC.format(floor="0.01e0")}, lt2 AS (SELECT election_year, days, max(field_date) AS ld, median(sample_size) AS mn, count(DISTINCT poll_id) AS np FROM vec GROUP BY ALL),
 wt AS (SELECT vec.*, ld, mn, np, exp(-ln(2e0) * (cutoff - field_date) / 24e0) AS rw, sqrt(greatest(sample_size, 100) / 1000e0) AS sw FROM vec JOIN lt2 USING (election_year, days)),
 wm AS (SELECT *, 'simple_mean' AS method, 1e0 AS w FROM wt UNION ALL SELECT *, 'recency_weighted', rw FROM wt UNION ALL SELECT *, 'sample_recency_weighted', rw * sw FROM wt
  UNION ALL SELECT *, 'latest_poll', CASE WHEN field_date = ld THEN 1e0 ELSE 0e0 END FROM wt),
 cn AS (SELECT election_year, days, method, candidate_id, sum(w * x) / sum(w) AS c FROM wm GROUP BY ALL),
 ct AS (SELECT wm.*, x - c AS z, c FROM wm JOIN cn USING (election_year, days, method, candidate_id)),
 cv AS (SELECT a.election_year, a.days, a.method, a.candidate_id AS i, b.candidate_id AS j, any_value(a.c) AS ci, any_value(a.np) AS np, any_value(a.mn) AS mn, sum(a.w * a.z * b.z) / sum(a.w) AS cov
  FROM ct a JOIN ct b USING (election_year, days, method, poll_id) GROUP BY ALL)
SELECT election_year, days AS days_before_election, method, i, j, {R("ci", "center_i")},
 {R("0.75e0 * CASE WHEN np > 1 THEN cov WHEN i = j THEN 0.0004e0 ELSE 0 END + CASE WHEN i = j THEN 0.25e0 * greatest(ci * (1 - ci) / greatest(mn, 500), 1e-6) + 1e-7 ELSE 0 END", "covariance")} FROM cv""", ("polls",))
def _(spark, d):
    b = bl.polling_baseline(stored_snapshots(spark, d), ["election_year", "days_before_election"], "snapshot_date")
    return b.select("election_year", "days_before_election", "method", "i", "j", r6("center_i"), r6("covariance"))


@query("E06_local_level", f"""
WITH RECURSIVE {SQL_VEC.format(floor="1e-4")}, ob AS (SELECT election_year, days, eday, poll_id, field_date, candidate_id, ln(x / last_value(x) OVER (PARTITION BY election_year, days, poll_id ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y,
   candidate_id = max(candidate_id) OVER (PARTITION BY election_year, days) AS ref, pow(greatest(0.075e0, 2.5e0 * greatest(margin_error / 100e0 / 1.96e0, 0.008e0)), 2) AS r FROM vec),
 sq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY election_year, days, candidate_id ORDER BY field_date, poll_id) AS rn FROM ob WHERE NOT ref),
 kf AS (SELECT election_year, days, candidate_id, rn, field_date, eday, y AS m, 1e0 / (1e0 / 0.35e0 + 1e0 / r) AS p FROM sq WHERE rn = 1
  UNION ALL SELECT s.election_year, s.days, s.candidate_id, s.rn, s.field_date, s.eday, m + (p + 0.000625e0 * (s.field_date - kf.field_date)) / (p + 0.000625e0 * (s.field_date - kf.field_date) + r) * (y - m),
   (1 - (p + 0.000625e0 * (s.field_date - kf.field_date)) / (p + 0.000625e0 * (s.field_date - kf.field_date) + r)) * (p + 0.000625e0 * (s.field_date - kf.field_date))
  FROM kf JOIN sq s ON s.election_year = kf.election_year AND s.days = kf.days AND s.candidate_id = kf.candidate_id AND s.rn = kf.rn + 1)
SELECT election_year, days AS days_before_election, candidate_id, CAST(rn AS BIGINT) AS polls, {R("m", "mean")}, {R("p + 0.000625e0 * greatest(eday - field_date, 0) + 1e-8", "variance")}
FROM (SELECT *, row_number() OVER (PARTITION BY election_year, days, candidate_id ORDER BY rn DESC) AS k FROM kf) WHERE k = 1""", ("polls",))
def _(spark, d):
    f = bl.local_level(stored_snapshots(spark, d), ["election_year", "days_before_election"], "snapshot_date", "election_date")
    return f.select("election_year", "days_before_election", "candidate_id", "polls", r6("mean"), r6("variance"))


# ---- pollster calibration -------------------------------------------------------


def calibration_input(spark, d, polls=None):
    """Polls beside the mean share of their year and candidate, which stands in for the result.

    The means are counted before they are broadcast: a year and candidate owns a large part of all polls, too much to sort in one task.
    """
    p = (stored_polls(spark, d) if polls is None else polls).withColumn("election_id", F.year("field_date"))
    res = p.groupBy("election_id", "candidate_id").agg(F.avg("share").alias("result_share"))
    return join_dimension(p.withColumnRenamed("share", "poll_share"), res, ["election_id", "candidate_id"], ["poll_id"])


SQL_CAL = """ci AS (SELECT *, CAST(year(field_date) AS INTEGER) AS election_id, avg(share) OVER (PARTITION BY year(field_date), candidate_id) AS result_share FROM polls),
 er AS (SELECT *, share - result_share AS e FROM ci), gv AS (SELECT greatest(var_samp(e), 0.25e0) AS g FROM er),
 lv AS (SELECT 'institute' AS kind, institute AS level, e FROM er UNION ALL SELECT 'collection_mode', collection_mode, e FROM er UNION ALL SELECT 'target_population', target_population, e FROM er),
 va AS (SELECT kind, level, (8 * any_value(g) + sum(e * e)) / (8 + count(*)) AS variance, count(*) AS n FROM lv, gv GROUP BY kind, level)"""


@query("E07_pollster_variance", f"""WITH {SQL_CAL} SELECT kind, level, {R("variance", "variance")}, n FROM va""", ("polls",))
def _(spark, d):
    return ca.pollster_calibration(calibration_input(spark, d)).variance.select("kind", "level", r6("variance"), "n")


@query("E07_residual_correlation", f"""
WITH {SQL_CAL}, c AS (SELECT poll_id FROM er GROUP BY poll_id HAVING count(*) = (SELECT count(DISTINCT candidate_id) FROM er)),
 l AS (SELECT poll_id, candidate_id, ln(greatest(share, 0.05e0)) - ln(greatest(result_share, 0.05e0)) AS z FROM er JOIN c USING (poll_id)),
 a AS (SELECT poll_id, candidate_id, z - last_value(z) OVER (PARTITION BY poll_id ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, candidate_id = max(candidate_id) OVER (PARTITION BY poll_id) AS ref FROM l),
 m AS (SELECT x.candidate_id AS i, y.candidate_id AS j, corr(x.z, y.z) AS c, count(*) AS n FROM a x JOIN a y USING (poll_id) WHERE NOT x.ref AND NOT y.ref GROUP BY ALL)
SELECT i, j, {R("0.75e0 * c + CASE WHEN i = j THEN 0.25e0 ELSE 0 END", "correlation")}, n FROM m""", ("polls",))
def _(spark, d):
    return ca.residual_correlation(calibration_input(spark, d)).select("i", "j", r6("correlation"), "n")


SQL_J04 = """im AS (SELECT election_id, institute, candidate_id, avg(e) AS e FROM er GROUP BY ALL),
 pc AS (SELECT l.institute AS left_id, r.institute AS right_id, corr(l.e, r.e) AS c, count(*) AS n FROM im l JOIN im r USING (election_id, candidate_id) WHERE l.institute <> r.institute GROUP BY ALL),
 ic AS (SELECT left_id, right_id, CASE WHEN n < 8 THEN 0.08e0 ELSE greatest(least(c * n / (n + 30e0), 0.65e0), -0.15e0) END AS rho FROM pc UNION ALL SELECT DISTINCT institute, institute, 0.55e0 FROM im)"""


@query("E07_institute_correlation", f"""WITH {SQL_CAL}, {SQL_J04} SELECT left_id, right_id, {R("rho", "correlation")} FROM ic""", ("polls",))
def _(spark, d):
    return ca.institute_correlation(calibration_input(spark, d)).select("left_id", "right_id", r6("correlation"))


@query("J04_institute_pairs", f"""WITH {SQL_CAL}, {SQL_J04} SELECT left_id, right_id, {R("c", "corr")}, n FROM pc""", ("polls",))
def _(spark, d):
    m = calibration_input(spark, d).groupBy("election_id", "institute", "candidate_id").agg(F.avg(F.col("poll_share") - F.col("result_share")).alias("e"))
    r = m.select("election_id", "candidate_id", F.col("institute").alias("right_id"), F.col("e").alias("re"))
    j = m.withColumnRenamed("institute", "left_id").join(r, ["election_id", "candidate_id"]).where("left_id <> right_id")
    return j.groupBy("left_id", "right_id").agg(r6(F.corr("e", "re"), "corr"), F.count("*").alias("n"))


@query("E07_quality_score", f"""WITH {SQL_CAL} SELECT level AS institute, {R("greatest(least(sqrt(g / variance), 2.5e0), 0.25e0)", "quality_score")} FROM va, gv WHERE kind = 'institute'""", ("polls",))
def _(spark, d):
    return ca.quality_score(ca.pollster_variance(calibration_input(spark, d))).select("institute", r6("quality_score"))


SQL_BASE = """me AS (SELECT poll_id, max(field_date) AS day, min(institute) AS institute, min(collection_mode) AS collection_mode, min(target_population) AS target_population, max(margin_error) AS moe FROM polls WHERE field_date <= DATE '1998-01-01' GROUP BY poll_id),
 pe AS (SELECT me.*, exp(-ln(2e0) * (DATE '1998-01-01' - day) / 24e0) / pow(greatest(moe / 1.96e0 / 10e0, 0.08e0), 2) AS base, 1e0 / greatest((a.variance + b.variance + c.variance) / 3e0, 0.05e0) AS pen
  FROM me JOIN va a ON a.kind = 'institute' AND a.level = institute JOIN va b ON b.kind = 'collection_mode' AND b.level = collection_mode JOIN va c ON c.kind = 'target_population' AND c.level = target_population)"""


@query("F23_base_precision", f"""WITH {SQL_CAL}, {SQL_BASE} SELECT poll_id, {R("base * greatest(least(pen / (SELECT median(pen) FROM pe), 4e0), 0.25e0)", "base_precision")} FROM pe""", ("polls",))
def _(spark, d):
    meta = po.poll_meta(v.polls(spark, d).where(F.col("field_date") <= F.lit("1998-01-01").cast("date"))).withColumn("as_of", F.lit("1998-01-01").cast("date"))
    return ca.calibrated_precision(meta, [], "as_of", ca.pollster_variance(calibration_input(spark, d))).select("poll_id", r6("base_precision"))


@query("E12_isotonic", f"""
WITH p AS (SELECT win_probability AS x, sum(outcome) AS s, count(*) AS w FROM forecasts WHERE outcome IS NOT NULL GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM p),
 m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS v FROM o a JOIN o b ON b.i >= a.i),
 lo AS (SELECT b, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM m),
 f AS (SELECT b AS i, max(v) AS f FROM lo GROUP BY b)
SELECT win_probability, calibrated, CAST(sum(w) AS BIGINT) AS n FROM (SELECT {R("x", "win_probability")}, {R("f", "calibrated")}, w FROM o JOIN f USING (i)) GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    f = v.forecasts(spark, d).where(F.col("outcome").isNotNull())
    out = ca.apply_isotonic(ca.fit_isotonic(f), f)
    return out.groupBy(r6("win_probability"), r6("calibrated")).agg(F.count("*").alias("n"))

