"""Checks of draw-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import draws as dr, results as rs
from tallyframe.operators.candidates import fallback_transfer, pair_features
from tallyframe.plans import views as v
from tallyframe.plans.q_scalars import R
from tallyframe.plans.registry import query, r6
from tallyframe.session import cut_lineage


def r3(name):
    """Vote counts have more digits before the point, so fewer after it."""
    return F.round(F.col(name) + 1e-6, 3).alias(name)


def R3(expr, name):
    return f"round(CAST({expr} AS DOUBLE) + 1e-6, 3) AS {name}"


def keyed(df):
    """The draw tables of the checks have one key."""
    return df.withColumn("race", F.lit(1))


@query("D01_draw_grid", f"""
SELECT k, draw_id, dim, {R(v.sql_normal("'7:' || k || ':' || draw_id || ':' || dim"), "z")} FROM (SELECT o_orderkey AS k FROM orders), (SELECT unnest(range(4)) AS draw_id), (SELECT CAST(unnest(range(2)) AS INTEGER) AS dim)""")
def _(spark, d):
    return dr.draw_grid(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"], 4, 2, 7).select("k", "draw_id", "dim", r6("z"))


SQL_COV = """nr AS (SELECT l_orderkey, avg(l_tax) AS a, avg(l_discount) AS b FROM lineitem GROUP BY l_orderkey),
 cm AS (SELECT var_samp(a) * 20 AS ca, var_samp(b) * 20 AS cb, covar_samp(a, b) * 20 AS cab FROM nr),
 rt AS (SELECT sqrt(ca) AS l11, cab / sqrt(ca) AS l21, sqrt(cb - cab * cab / ca) AS l22 FROM cm)"""


def small_cov(spark, d):
    n = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"))
    c = n.agg(*[(f("a", "b") if f is F.covar_samp else f(x)).__mul__(20).alias(nm) for f, x, nm in
                ((F.var_samp, "a", "aa"), (F.covar_samp, "a", "ab"), (F.var_samp, "b", "bb"))])
    return c.select(F.lit(1).alias("race"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(k).alias("covariance")) for i, j, k in
        (("A", "A", "aa"), ("A", "N", "ab"), ("N", "A", "ab"), ("N", "N", "bb"))])).alias("m")).select("race", "m.*")


def _z(dim):
    return v.sql_normal(f"'9:1:' || draw_id || ':{dim}'")


@query("D02_predictive_error", f"""
WITH {SQL_COV}, sh AS (SELECT draws.*, share / 100 * exp(CASE candidate_id WHEN 'A' THEN l11 * {_z(0)} WHEN 'N' THEN l21 * {_z(0)} + l22 * {_z(1)} ELSE 0 END) AS e FROM draws, rt)
SELECT draw_id, geo, candidate_id, {R("100e0 * e / sum(e) OVER (PARTITION BY draw_id, geo)", "share")} FROM sh""", ("draws",))
def _(spark, d):
    roots = dr.cholesky(small_cov(spark, d), ["race"])
    return dr.add_predictive_error(keyed(v.draws(spark, d)), roots, ["race"], 9).select("draw_id", "geo", "candidate_id", r6("share"))


SQL_REGP = """rp AS (SELECT n_nationkey, r_name AS geo, l_returnflag AS candidate_id, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 pp AS (SELECT geo, candidate_id, 100e0 * sum(q) / sum(sum(q)) OVER (PARTITION BY geo) AS prior_share FROM rp GROUP BY geo, candidate_id),
 npz AS (SELECT candidate_id, 100e0 * sum(q) / sum(sum(q)) OVER () AS national_prior_share FROM rp GROUP BY candidate_id)"""


def region_priors(spark, d):
    li = v.table(spark, d, "lineitem").join(v.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        v.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = li.groupBy(F.lit(1).alias("race"), F.col("r_name").alias("uf"), F.col("l_returnflag").alias("candidate_id")).agg(F.sum("l_quantity").alias("votes"))
    st = rs.with_vote_share(g, ["race", "uf"]).withColumn("prior_share", F.col("vote_share") * 100)
    nat = rs.national_map(g, "candidate_id", ["race"]).withColumn("national_prior_share", F.col("national_share") * 100)
    return st.join(nat, ["race", "candidate_id"]).select("race", "uf", "candidate_id", "prior_share", "national_prior_share", F.lit(2.5).alias("prior_strength"))


@query("D03_blend_state_prior", f"""
WITH {SQL_REGP}, al AS (SELECT draw_id, geo, candidate_id, share FROM draws UNION ALL SELECT draw_id, 'BR', candidate_id, share FROM national_draws),
 ct AS (SELECT r_name AS geo, count(*) FILTER (n_nationkey % 2 = 1) AS polls FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' GROUP BY r_name),
 x AS (SELECT a.*, ln(n.share) AS nat, pp.prior_share, npz.national_prior_share, coalesce(polls, 0) / (coalesce(polls, 0) + 2.5e0) AS w
  FROM al a JOIN national_draws n USING (draw_id, candidate_id) LEFT JOIN pp ON pp.geo = a.geo AND pp.candidate_id = a.candidate_id AND pp.geo <> 'ASIA' LEFT JOIN npz ON npz.candidate_id = a.candidate_id LEFT JOIN ct ON ct.geo = a.geo),
 e AS (SELECT *, exp(CASE WHEN prior_share IS NULL THEN ln(share) ELSE w * ln(share) + (1 - w) * (nat + ln(prior_share / 100) - ln(national_prior_share / 100)) END) AS e FROM x)
SELECT draw_id, geo, candidate_id, {R("100e0 * e / sum(e) OVER (PARTITION BY draw_id, geo)", "share")} FROM e""", ("draws", "national_draws"))
def _(spark, d):
    al = v.draws(spark, d).unionByName(v.national_draws(spark, d).withColumn("geo", F.lit("BR")))
    n = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = n.where(F.col("r_name") != "EUROPE").groupBy(F.lit(1).alias("race"), F.col("r_name").alias("uf")).agg(F.count_if(F.col("n_nationkey") % 2 == 1).alias("polls"))
    priors = region_priors(spark, d).withColumn("prior_share", F.when((F.col("uf") != "ASIA") | (F.col("candidate_id") != "N"), F.col("prior_share")))
    return dr.blend_state_prior(keyed(al), priors, counts, ["race"], flag_fund(spark, d)).select("draw_id", "geo", "candidate_id", r6("share"))


@query("D04_project_state_lean", f"""
WITH {SQL_REGP}, x AS (SELECT draw_id, pp.geo, candidate_id, share * prior_share / national_prior_share AS e FROM national_draws JOIN pp USING (candidate_id) JOIN npz USING (candidate_id))
SELECT draw_id, geo, candidate_id, {R("100e0 * e / sum(e) OVER (PARTITION BY draw_id, geo)", "share")} FROM x""", ("national_draws",))
def _(spark, d):
    return dr.project_state_lean(keyed(v.national_draws(spark, d)), region_priors(spark, d), ["race"]).select("draw_id", "geo", "candidate_id", r6("share"))


SQL_MLP = """ml AS (SELECT l_returnflag AS candidate_id, avg(l_discount) * 10 AS ml_probability, avg(l_tax) * 1000 AS rejection, avg(l_tax) * 10 - 0.4e0 AS late FROM lineitem GROUP BY l_returnflag)"""


def flag_fund(spark, d):
    return v.table(spark, d, "lineitem").groupBy(F.lit(1).alias("race"), F.col("l_returnflag").alias("candidate_id")).agg(
        (F.avg("l_discount") * 10).alias("ml_probability"), (F.avg("l_tax") * 1000).alias("rejection"), (F.avg("l_tax") * 10 - 0.4).alias("late_decider_score"))


@query("D05_tilt", f"""
WITH {SQL_MLP}, x AS (SELECT draws.*, share * exp((ml_probability - 1e0 / 3) * 0.2e0) AS e FROM draws JOIN ml USING (candidate_id))
SELECT draw_id, geo, candidate_id, {R("100e0 * e / sum(e) OVER (PARTITION BY draw_id, geo)", "share")} FROM x""", ("draws",))
def _(spark, d):
    return dr.tilt(keyed(v.draws(spark, d)), flag_fund(spark, d), ["race"]).select("draw_id", "geo", "candidate_id", r6("share"))


SQL_FINAL = f"""{SQL_MLP}, un AS (SELECT l_orderkey AS draw_id, avg(l_discount) * 700 AS undecided FROM lineitem GROUP BY l_orderkey),
 pz AS (SELECT d.*, least(undecided / 100, 0.6e0) AS u, greatest(share / 100, 1e-5) * exp(late + (50 - rejection) / 140) AS p FROM draws d JOIN ml USING (candidate_id) JOIN un USING (draw_id)),
 al AS (SELECT *, share / 100 * (1 - u) + (70 * p / sum(p) OVER (PARTITION BY draw_id, geo) + 0.5e0) / (70 + 0.5e0 * 3) * u AS f FROM pz),
 fin AS (SELECT draw_id, geo, candidate_id, f / sum(f) OVER (PARTITION BY draw_id, geo) AS share FROM al)"""


def final_shares(spark, d):
    dd = keyed(v.draws(spark, d))
    geos = v.table(spark, d, "region").agg(F.collect_list("r_name")).scalar()
    und = v.table(spark, d, "lineitem").groupBy(F.lit(1).alias("race"), F.col("l_orderkey").alias("draw_id")).agg((F.avg("l_discount") * 700).alias("undecided"))
    return dr.allocate_undecided(dd, und.select("race", "draw_id", F.explode(geos).alias("geo"), "undecided"), flag_fund(spark, d), ["race"])


@query("D06_allocate_undecided", f"WITH {SQL_FINAL} SELECT draw_id, geo, candidate_id, {R('share', 'share')} FROM fin", ("draws",))
def _(spark, d):
    return final_shares(spark, d).select("draw_id", "geo", "candidate_id", r6("share"))


SQL_VOTES = f"""{SQL_FINAL}, el AS (SELECT r_name AS geo, sum(eligible) AS rv FROM turnout t JOIN region ON r_name = t.region GROUP BY r_name),
 tn AS (SELECT o_orderkey AS draw_id, geo, rv, 0.3e0 + 0.7e0 * ({v.sql_uniform("'5:' || geo || ':' || o_orderkey")}) AS turnout FROM orders, el),
 nv AS (SELECT draw_id, candidate_id, sum(share * rv * least(greatest(turnout, 0.35e0), 0.95e0)) AS votes FROM fin JOIN tn USING (draw_id, geo) GROUP BY ALL),
 rk AS (SELECT *, 100e0 * votes / sum(votes) OVER (PARTITION BY draw_id) AS national_share, row_number() OVER (PARTITION BY draw_id ORDER BY votes DESC, candidate_id) AS rn FROM nv)"""


def electorate(spark, d):
    return v.turnout(spark, d).groupBy(F.lit(1).alias("race"), F.col("region").alias("geo")).agg(F.sum("eligible").alias("registered_voters"))


def turnout_draws(spark, d):
    from tallyframe.functions.numeric import hash_uniform
    el = electorate(spark, d).agg(F.collect_list(F.struct("geo", "registered_voters"))).scalar()
    t = v.table(spark, d, "orders").select(F.lit(1).alias("race"), F.col("o_orderkey").alias("draw_id"), F.explode(el).alias("g")).select("race", "draw_id", "g.*")
    return t.withColumn("turnout", 0.3 + 0.7 * hash_uniform(5, F.col("geo"), F.col("draw_id")))


def votes(spark, d):
    return dr.national_votes(final_shares(spark, d), turnout_draws(spark, d), ["race"])


@query("D07_national_votes", f"WITH {SQL_VOTES} SELECT draw_id, candidate_id, {R3('votes', 'votes')}, {R('national_share', 'national_share')}, rn = 1 AS leads FROM rk", ("draws", "turnout"))
def _(spark, d):
    return votes(spark, d).select("draw_id", "candidate_id", r3("votes"), r6("national_share"), "leads")


@query("W06_lead_probability", f"WITH {SQL_VOTES} SELECT candidate_id, {R('avg(CAST(rn = 1 AS DOUBLE))', 'lead_probability')} FROM rk GROUP BY candidate_id", ("draws", "turnout"))
def _(spark, d):
    return dr.lead_probability(votes(spark, d), ["race"]).select("candidate_id", r6("lead_probability"))


@query("T02_finalists", f"WITH {SQL_VOTES} SELECT draw_id, candidate_id, CAST(rn AS INTEGER) AS position FROM rk WHERE rn <= 2", ("draws", "turnout"))
def _(spark, d):
    return dr.finalists(votes(spark, d), ["race"]).select("draw_id", "candidate_id", "position")


def transfer_pairs(spark, d):
    f = v.table(spark, d, "lineitem").groupBy(F.lit(1).alias("race"), F.col("l_returnflag").alias("candidate_id")).agg(
        (F.avg("l_tax") * 1000).alias("rejection"), (F.avg("l_linenumber") - 4).alias("ideology_score"), F.lit("b").alias("bloc"), F.lit(0).alias("incumbency"))
    return fallback_transfer(pair_features(f, ["race"]))


SQL_RUN = f"""{SQL_VOTES}, fd AS (SELECT l_returnflag AS c, avg(l_tax) * 1000 AS rej, avg(l_linenumber) - 4 AS ideo FROM lineitem GROUP BY l_returnflag),
 ru AS (SELECT draw_id, max(candidate_id) FILTER (rn = 1) AS a, max(candidate_id) FILTER (rn = 2) AS b, max(candidate_id) FILTER (rn = 3) AS s, max(votes) FILTER (rn = 1) AS va, max(votes) FILTER (rn = 2) AS vb, max(votes) FILTER (rn = 3) AS vs, sum(votes) AS total FROM rk GROUP BY draw_id),
 rp2 AS (SELECT ru.*, 1e0 / (1e0 + exp(-(1.8e0 * (abs(fs.ideo - fb.ideo) - abs(fs.ideo - fa.ideo)) + 0.025e0 * (fb.rej - fa.rej)))) AS pa,
  least(greatest(0.06e0 + 0.0015e0 * fs.rej + 0.04e0 * least(abs(fs.ideo - fa.ideo), abs(fs.ideo - fb.ideo)), 0.03e0), 0.35e0) AS pz FROM ru JOIN fd fs ON fs.c = s JOIN fd fa ON fa.c = a JOIN fd fb ON fb.c = b),
 rr AS (SELECT *, va + vs * (1 - pz) * pa AS ra, vb + vs * (1 - pz) * (1 - pa) AS rb FROM rp2), rw AS (SELECT *, CASE WHEN ra >= rb THEN a ELSE b END AS winner FROM rr)"""


@query("D08_runoff", f"WITH {SQL_RUN} SELECT draw_id, a AS a_id, b AS b_id, {R3('ra', 'runoff_a')}, {R3('rb', 'runoff_b')}, {R3('vs * pz', 'abstained_votes')}, winner AS winner_id FROM rw", ("draws", "turnout"))
def _(spark, d):
    return dr.runoff(votes(spark, d), transfer_pairs(spark, d), ["race"]).select("draw_id", "a_id", "b_id", r3("runoff_a"), r3("runoff_b"), r3("abstained_votes"), "winner_id")


@query("D09_candidate_summary", f"""
WITH {SQL_RUN} SELECT candidate_id, {R("avg(CAST(rn = 1 AS DOUBLE))", "first_round_lead_probability")}, {R("avg(national_share)", "expected_first_round_share")}, {R("quantile_cont(national_share, 0.05e0)", "expected_first_round_share_low")},
 {R("quantile_cont(national_share, 0.95e0)", "expected_first_round_share_high")}, {R("avg(CAST(winner = candidate_id AS DOUBLE))", "win_probability")} FROM rk JOIN rw USING (draw_id) GROUP BY candidate_id""", ("draws", "turnout"))
def _(spark, d):
    nv = cut_lineage(votes(spark, d))  # the first round and the runoff read it
    s = dr.candidate_summary(nv, dr.runoff(nv, transfer_pairs(spark, d), ["race"]), ["race"])
    return s.select("candidate_id", r6("first_round_lead_probability"), r6("expected_first_round_share"), r6("expected_first_round_share_low"),
                    r6("expected_first_round_share_high"), r6("win_probability"))


@query("D10_state_summary", f"""
WITH {SQL_VOTES}, l AS (SELECT *, row_number() OVER (PARTITION BY draw_id, geo ORDER BY share DESC, candidate_id) AS k FROM fin),
 c AS (SELECT geo, candidate_id, avg(CAST(k = 1 AS DOUBLE)) AS p, avg(share) * 100 AS m FROM l GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY p DESC, candidate_id) AS r FROM c),
 t AS (SELECT geo, avg(turnout) AS et, quantile_cont(turnout, 0.05e0) AS lo, quantile_cont(turnout, 0.95e0) AS hi FROM tn GROUP BY geo)
SELECT geo, {R("et", "expected_turnout")}, {R("lo", "turnout_low")}, {R("hi", "turnout_high")}, max(candidate_id) FILTER (r = 1) AS leading_candidate, {R("max(p) FILTER (r = 1)", "leader_probability")},
 {R("max(m) FILTER (candidate_id = 'A')", "share_a")}, {R("max(m) FILTER (candidate_id = 'N')", "share_n")} FROM b JOIN t USING (geo) GROUP BY geo, et, lo, hi""", ("draws", "turnout"))
def _(spark, d):
    s = dr.state_summary(final_shares(spark, d), turnout_draws(spark, d), ["race"])
    return s.select("geo", r6("expected_turnout"), r6("turnout_low"), r6("turnout_high"), "leading_candidate", r6("leader_probability"),
                    r6(F.col("expected_shares")["A"], "share_a"), r6(F.col("expected_shares")["N"], "share_n"))


@query("D11_turnout_diagnostics", f"""
WITH {SQL_RUN}, x AS (SELECT total / (SELECT sum(rv) FROM el) AS t, vs * pz / total AS ab FROM rw)
SELECT {R("avg(t)", "turnout_national_mean")}, {R("quantile_cont(t, 0.05e0)", "turnout_national_low")}, {R("quantile_cont(t, 0.95e0)", "turnout_national_high")}, {R("avg(ab)", "runoff_additional_abstention")} FROM x""", ("draws", "turnout"))
def _(spark, d):
    nv = cut_lineage(votes(spark, d))  # the first round and the runoff read it
    t = dr.turnout_diagnostics(nv, dr.runoff(nv, transfer_pairs(spark, d), ["race"]), electorate(spark, d), ["race"])
    return t.select(r6("turnout_national_mean"), r6("turnout_national_low"), r6("turnout_national_high"), r6("runoff_additional_abstention"))


@query("D12_posterior_summary", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY draw_id, geo ORDER BY share DESC, candidate_id) AS k FROM draws)
SELECT geo, candidate_id, {R("avg(share)", "mean_share")}, {R("median(share)", "median_share")}, {R("quantile_cont(share, 0.05e0)", "lower")}, {R("quantile_cont(share, 0.95e0)", "upper")},
 {R("stddev_samp(share)", "uncertainty")}, {R("avg(CAST(k = 1 AS DOUBLE))", "win_probability")} FROM l GROUP BY geo, candidate_id""", ("draws",))
def _(spark, d):
    return dr.posterior_summary(v.draws(spark, d), []).select("geo", "candidate_id", r6("mean_share"), r6("median_share"), r6("lower"), r6("upper"), r6("uncertainty"), r6("win_probability"))


@query("D13_posterior_interval", f"SELECT candidate_id, {R('quantile_cont(share, 0.1e0)', 'low')}, {R('median(share)', 'median')}, {R('quantile_cont(share, 0.9e0)', 'high')} FROM national_draws GROUP BY candidate_id", ("national_draws",))
def _(spark, d):
    return dr.posterior_interval(v.national_draws(spark, d), ["candidate_id"], "share").select("candidate_id", r6("low"), r6("median"), r6("high"))


@query("D14_variance_decomposition", f"""
WITH x AS (SELECT user_id % 10 AS grp, event_type, var_samp(value) AS v FROM events GROUP BY ALL)
SELECT grp, event_type, {R("v / sum(v) OVER (PARTITION BY grp)", "variance_share")} FROM x""")
def _(spark, d):
    e = v.table(spark, d, "events").withColumn("grp", F.col("user_id") % 10)
    return dr.variance_decomposition(e, "event_type", "value", ["grp"]).select("grp", "event_type", r6("variance_share"))


@query("D15_effective_sample_size", f"SELECT event_type, {R('pow(sum(value), 2) / sum(value * value)', 'ess')} FROM events GROUP BY event_type")
def _(spark, d):
    return dr.effective_sample_size(v.table(spark, d, "events"), "value", ["event_type"]).select("event_type", r6("effective_sample_size", "ess"))


@query("D16_cov_to_corr", f"""
WITH x AS (SELECT geo, candidate_id, draw_id, share FROM draws), c AS (SELECT a.geo, a.candidate_id AS i, b.candidate_id AS j, covar_samp(a.share, b.share) AS covariance FROM x a JOIN x b USING (geo, draw_id) GROUP BY ALL),
 s AS (SELECT geo, i, covariance AS v FROM c WHERE i = j)
SELECT geo, i, j, {R("CASE WHEN i = j THEN 1 ELSE greatest(least(covariance / sqrt(a.v * b.v), 1), -1) END", "correlation")} FROM c JOIN s a USING (geo, i) JOIN (SELECT geo, i AS j, v FROM s) b USING (geo, j)""", ("draws",))
def _(spark, d):
    wide = v.draws(spark, d).groupBy("geo", "draw_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "share"))).alias("x"))
    p = wide.select("geo", F.explode("x").alias("a"), "x").select("geo", "a", F.explode("x").alias("b"))
    cov = p.groupBy("geo", F.col("a.candidate_id").alias("i"), F.col("b.candidate_id").alias("j")).agg(F.covar_samp("a.share", "b.share").alias("covariance"))
    return dr.cov_to_corr(cov, ["geo"]).select("geo", "i", "j", r6("correlation"))


SQL_ACT = """ac AS (SELECT r_name AS geo, l_returnflag AS candidate_id, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY r_name) AS actual_share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT (r_name = 'ASIA' AND l_returnflag = 'N') AND r_name <> 'EUROPE' GROUP BY r_name, l_returnflag)"""


def region_actual(spark, d):
    li = v.table(spark, d, "lineitem").join(v.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        v.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    li = li.where(~((F.col("r_name") == "ASIA") & (F.col("l_returnflag") == "N")) & (F.col("r_name") != "EUROPE"))
    g = li.groupBy(F.col("r_name").alias("geo"), F.col("l_returnflag").alias("candidate_id")).agg(F.sum("l_quantity").alias("votes"))
    return rs.with_vote_share(g, ["geo"]).select("geo", "candidate_id", F.col("vote_share").alias("actual_share"))


SQL_SUM = """ps AS (SELECT geo, candidate_id, avg(share) / 100 AS m, quantile_cont(share, 0.05e0) / 100 AS lo, quantile_cont(share, 0.95e0) / 100 AS hi, avg(CAST(k = 1 AS DOUBLE)) AS wp
 FROM (SELECT *, row_number() OVER (PARTITION BY draw_id, geo ORDER BY share DESC, candidate_id) AS k FROM draws) GROUP BY geo, candidate_id),
 pa AS (SELECT ps.*, actual_share, row_number() OVER (PARTITION BY geo ORDER BY actual_share DESC NULLS LAST, candidate_id) AS ar, count(actual_share) OVER (PARTITION BY geo) AS ka FROM ps LEFT JOIN ac USING (geo, candidate_id))"""


@query("M09_score_draws", f"""
WITH {SQL_ACT}, {SQL_SUM} SELECT geo, {R("avg(abs(m - actual_share))", "vote_share_mae")}, {R("avg(CASE WHEN actual_share IS NOT NULL THEN CAST(actual_share BETWEEN lo AND hi AS DOUBLE) END)", "coverage")},
 {R("CASE WHEN any_value(ka) > 0 THEN avg(pow(wp - CAST(ar = 1 AS INTEGER), 2)) END", "winner_brier")}, {R("avg(CASE WHEN actual_share IS NOT NULL THEN hi - lo END)", "interval_width")} FROM pa GROUP BY geo""", ("draws",))
def _(spark, d):
    s = dr.score_draws(v.draws(spark, d), region_actual(spark, d), [])
    return s.select("geo", r6("vote_share_mae"), r6("coverage"), r6("winner_brier"), r6("interval_width"))


@query("B07_forecast_records", f"""
WITH {SQL_ACT}, {SQL_SUM} SELECT 1998 AS election_year, geo AS uf, CASE WHEN geo = 'AMERICA' THEN 'national' ELSE 'state' END AS level, candidate_id, {R("wp", "win_probability")}, {R("m", "predicted_share")},
 {R("lo", "lower")}, {R("hi", "upper")}, {R("actual_share", "actual_share")}, CASE WHEN ka > 0 THEN CAST(ar = 1 AS INTEGER) END AS outcome FROM pa""", ("draws",))
def _(spark, d):
    snaps = v.table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate")).alias("snapshot_date")).withColumn("election_year", F.lit(1998)).withColumn("scorable", F.lit(True))
    f = dr.forecast_records(v.draws(spark, d).withColumn("election_year", F.lit(1998)), region_actual(spark, d), snaps, ["election_year"], "AMERICA")
    return f.select("election_year", "uf", "level", "candidate_id", r6("win_probability"), r6("predicted_share"), r6("lower"), r6("upper"), r6("actual_share"), "outcome")


@query("J10_actual_lookup", f"WITH {SQL_ACT}, {SQL_SUM} SELECT geo, candidate_id, {R('m', 'mean_share')}, {R('actual_share', 'actual_share')} FROM pa", ("draws",))
def _(spark, d):
    s = dr.posterior_summary(v.draws(spark, d), []).join(region_actual(spark, d), ["geo", "candidate_id"], "left")
    return s.select("geo", "candidate_id", r6(F.col("mean_share") / 100, "mean_share"), r6("actual_share"))


@query("W05_normalize_by_group", f"""SELECT race, candidate_id, {R("CASE WHEN sum(search_share) OVER (PARTITION BY race) <= 0 THEN 1e0 / count(*) OVER (PARTITION BY race) ELSE search_share / sum(search_share) OVER (PARTITION BY race) END", "p")} FROM fund""", ("fund",))
def _(spark, d):
    from tallyframe.operators.regression import normalize_by_group
    return normalize_by_group(v.fund(spark, d), ["race"], "search_share", "p").select("race", "candidate_id", r6("p"))


@query("W07_winner_accuracy", f"""
WITH x AS (SELECT race, incumbency, row_number() OVER (PARTITION BY race ORDER BY search_share DESC, candidate_id) AS k FROM fund) SELECT {R("avg(incumbency)", "accuracy")}, count(*) AS races FROM x WHERE k = 1""", ("fund",))
def _(spark, d):
    from tallyframe.operators.regression import winner_accuracy
    return winner_accuracy(v.fund(spark, d), ["race"], "search_share", "incumbency").select(r6("accuracy"), "races")

