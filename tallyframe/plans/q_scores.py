"""Checks of snapshots, folds, scores, drift, robustness and lineage."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import recency_weight, sample_weight
from tallyframe.operators import lineage as ln, robustness as rb, scoring as sc, snapshots as sn
from tallyframe.plans import views as v
from tallyframe.plans.q_scalars import R
from tallyframe.plans.q_tables import SQL_REC, record_metrics
from tallyframe.plans.registry import query, r6
from tallyframe.session import cut_lineage, scratch_dir

CALENDAR = tuple(
    (y, date(y, 1, 1), None, None if y == 1996 else date(y - 1, 11, 15)) for y in range(1996, 2002)
)

SQL_SNAP = f"""hz AS (SELECT y AS election_year, make_date(y, 1, 1) AS eday, d AS days, CAST(make_date(y, 1, 1) - d AS DATE) AS cutoff,
  y = 1996 OR make_date(y, 1, 1) - d >= make_date(y - 1, 11, 15) AS scorable
  FROM (SELECT CAST(unnest(range(1996, 2002)) AS INTEGER) AS y), (SELECT CAST(unnest({list(sn.OFFSETS)}) AS INTEGER) AS d)),
 el AS (SELECT * FROM polls JOIN hz ON field_date BETWEEN cutoff - 90 AND cutoff),
 sg AS (SELECT election_year, days, poll_id, max(field_date) AS day, string_agg(DISTINCT candidate_id, '|' ORDER BY candidate_id) AS sig FROM el GROUP BY ALL),
 lt AS (SELECT election_year, days, sig FROM (SELECT *, row_number() OVER (PARTITION BY election_year, days ORDER BY day DESC, poll_id DESC) AS rn FROM sg) WHERE rn = 1 AND contains(sig, '|')),
 snap AS (SELECT el.*, substr(sha1(sig), 1, 12) AS slate FROM el JOIN sg USING (election_year, days, poll_id) JOIN lt USING (election_year, days, sig))"""


def stored_polls(spark, d):
    """The poll view written once, for queries that read it along several paths."""
    return cut_lineage(v.polls(spark, d))


def snapshots(spark, d, polls=None):
    return sn.build_snapshots(stored_polls(spark, d) if polls is None else polls, CALENDAR)


def stored_snapshots(spark, d, polls=None):
    return cut_lineage(snapshots(spark, d, polls))


@query("B01_build_snapshots", f"""WITH {SQL_SNAP} SELECT election_year, days AS days_before_election, poll_id, candidate_id, strftime(cutoff, '%Y-%m-%d') AS snapshot_date,
 slate AS candidate_slate_hash, scorable, {R("share", "share")} FROM snap""", ("polls",))
def _(spark, d):
    return snapshots(spark, d).select("election_year", "days_before_election", "poll_id", "candidate_id", F.col("snapshot_date").cast("string").alias("snapshot_date"),
                                      "candidate_slate_hash", "scorable", r6("share"))


@query("B01_snapshot_average", f"""
WITH {SQL_SNAP}, x AS (SELECT *, share / sum(share) OVER (PARTITION BY election_year, days, poll_id) AS s,
  exp(-ln(2e0) * (cutoff - field_date) / 24e0) * sqrt(greatest(sample_size, 100) / 1000e0) AS w FROM snap)
SELECT election_year, days AS days_before_election, candidate_id, count(*) AS polls, {R("sum(s * w) / sum(w)", "share")} FROM x GROUP BY ALL""", ("polls",))
def _(spark, d):
    from tallyframe.functions.compose import close_composition
    snap = close_composition(snapshots(spark, d), ["election_year", "days_before_election", "poll_id"], "share")
    w = recency_weight("field_date", "snapshot_date") * sample_weight("sample_size")
    return snap.withColumn("w", w).groupBy("election_year", "days_before_election", "candidate_id").agg(
        F.count("*").alias("polls"), r6(F.sum(F.col("share") * F.col("w")) / F.sum("w"), "share"))


@query("W03_latest_slate", f"WITH {SQL_SNAP} SELECT election_year, days AS days_before_election, min(sig) AS slate, count(*) AS horizons FROM lt GROUP BY ALL", ("polls",))
def _(spark, d):
    s = snapshots(spark, d).groupBy("election_year", "days_before_election").agg(F.array_join(F.array_sort(F.collect_set("candidate_id")), "|").alias("slate"))
    return s.withColumn("horizons", F.lit(1).cast("bigint"))


@query("J06_compatible_polls", f"WITH {SQL_SNAP} SELECT DISTINCT election_year, days AS days_before_election, poll_id FROM snap", ("polls",))
def _(spark, d):
    return snapshots(spark, d).select("election_year", "days_before_election", "poll_id").distinct()


@query("J07_cutoff_join", f"WITH {SQL_SNAP} SELECT election_year, days AS days_before_election, count(*) AS n, {R('sum(share)', 'total')} FROM el GROUP BY ALL", ("polls",))
def _(spark, d):
    return sn.match_horizons(v.polls(spark, d), CALENDAR).groupBy(
        F.col("horizon.election_year").alias("election_year"), F.col("horizon.days").alias("days_before_election")).agg(F.count("*").alias("n"), r6(F.sum("share"), "total"))


@query("J01_meta_signature", """
SELECT poll_id, strftime(max(field_date), '%Y-%m-%d') AS field_date, string_agg(DISTINCT candidate_id, '|' ORDER BY candidate_id) AS signature FROM polls GROUP BY poll_id""", ("polls",))
def _(spark, d):
    from tallyframe.operators.polls import poll_meta, poll_signature
    p = v.polls(spark, d)
    return poll_meta(p).join(poll_signature(p), "poll_id").select("poll_id", F.col("field_date").cast("string").alias("field_date"), F.array_join("signature", "|").alias("signature"))


@query("B02_election_calendar", """
SELECT min(y) AS election_year, count(*) AS orders_before FROM (SELECT o_orderkey, min(y) AS y FROM orders JOIN (SELECT CAST(unnest(range(1996, 2002)) AS INTEGER) AS y) ON make_date(y, 1, 1) >= CAST(o_orderdate AS DATE) GROUP BY o_orderkey) GROUP BY y""")
def _(spark, d):
    years = sn.election_calendar(spark, CALENDAR).select(F.col("year").alias("election_year"))
    o = v.table(spark, d, "orders").groupBy(sn.next_election(F.to_date("o_orderdate"), CALENDAR).alias("election_year")).agg(F.count("*").alias("orders_before"))
    return o.join(F.broadcast(years), "election_year")


@query("B03_scorable_flag", f"WITH {SQL_SNAP} SELECT election_year, days AS days_before_election, bool_and(scorable) AS scorable, count(*) AS n FROM snap GROUP BY ALL", ("polls",))
def _(spark, d):
    return snapshots(spark, d).groupBy("election_year", "days_before_election").agg(F.bool_and("scorable").alias("scorable"), F.count("*").alias("n"))


@query("B04_rolling_origin", f"""
WITH dd AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events))
SELECT fold, strftime(any_value(dd.day), '%Y-%m-%d') AS test_day, count(*) FILTER (CAST(ts AS DATE) < dd.day) AS n_train, count(*) FILTER (CAST(ts AS DATE) = dd.day) AS n_test,
 {R("sum(value) FILTER (CAST(ts AS DATE) < dd.day)", "train_value")} FROM dd, events WHERE fold >= 3 GROUP BY fold""")
def _(spark, d):
    return sn.rolling_origin(v.table(spark, d, "events"), "ts", 3, ["value"]).select(
        "fold", F.col("test_day").cast("string").alias("test_day"), "n_train", "n_test", r6("train_value"))


@query("B04_fold_assignment", """
WITH r AS (SELECT event_id, CAST(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k >= 3 THEN k END AS test_fold, greatest(k + 1, 3) AS train_from FROM r""")
def _(spark, d):
    return sn.assign_folds(v.table(spark, d, "events"), "ts", 3).select("event_id", "test_fold", "train_from")


@query("B05_group_kfold", """
WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5(CAST(user_id AS VARCHAR)), user_id) AS k FROM events GROUP BY user_id),
 p(k, user_id, fold, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT g.k, g.user_id, (list_position(loads, list_min(loads)) - 1)::INTEGER,
   list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END) FROM p JOIN g ON g.k = p.k + 1)
SELECT event_id, fold FROM events JOIN p USING (user_id)""")
def _(spark, d):
    return sn.group_kfold(v.table(spark, d, "events"), "user_id").select("event_id", "fold")


# ---- scores -------------------------------------------------------------------

P = "greatest(least(win_probability, 1 - {e}), {e})"
LOSS = "-avg(outcome * ln(" + P + ") + (1 - outcome) * ln(1 - " + P + "))"
SCORED = "FROM forecasts WHERE scorable AND outcome IS NOT NULL AND actual_share IS NOT NULL"


@query("M01_brier", f"SELECT model, {R('avg(pow(win_probability - outcome, 2))', 'brier')} FROM forecasts GROUP BY model", ("forecasts",))
def _(spark, d):
    return v.forecasts(spark, d).groupBy("model").agg(r6(sc.brier("outcome", "win_probability"), "brier"))


@query("M02_log_loss", f"SELECT model, {R(LOSS.format(e='1e-12'), 'log_loss')} FROM forecasts GROUP BY model", ("forecasts",))
def _(spark, d):
    return v.forecasts(spark, d).groupBy("model").agg(r6(sc.log_loss("outcome", "win_probability"), "log_loss"))


@query("M03_mae", f"SELECT uf, {R('avg(abs(predicted_share - actual_share))', 'mae')} FROM forecasts GROUP BY uf", ("forecasts",))
def _(spark, d):
    return v.forecasts(spark, d).groupBy("uf").agg(r6(sc.mae("actual_share", "predicted_share"), "mae"))


@query("M04_coverage", f"SELECT uf, {R('avg(CAST(actual_share >= lower AND actual_share <= upper AS DOUBLE))', 'coverage')} FROM forecasts GROUP BY uf", ("forecasts",))
def _(spark, d):
    return v.forecasts(spark, d).groupBy("uf").agg(r6(sc.coverage("actual_share", "lower", "upper"), "coverage"))


def sql_bins(bins: str, source: str = "forecasts") -> str:
    return f"(SELECT *, len(list_filter(range(1, {bins}), lambda i: win_probability >= i * (1e0 / {bins}))) AS bin FROM {source})"


@query("M05_ece", f"""
WITH b AS (SELECT model, level, bin, count(*) AS n, avg(win_probability) AS p, avg(outcome) AS y FROM {sql_bins("10", "(FROM forecasts WHERE outcome IS NOT NULL)")} GROUP BY ALL)
SELECT model, level, {R("sum(n * abs(p - y)) / sum(n)", "ece")} FROM b GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    f = v.forecasts(spark, d).where(F.col("outcome").isNotNull())
    return sc.ece(f, ["model", "level"]).select("model", "level", r6("ece"))


@query("M06_reliability_bins", f"""
SELECT model, CAST(bin AS INTEGER) AS bin, count(*) AS count, {R("avg(win_probability)", "mean_probability")}, {R("avg(outcome)", "observed_frequency")} FROM {sql_bins("7")} GROUP BY model, bin""", ("forecasts",))
def _(spark, d):
    return sc.reliability_bins(v.forecasts(spark, d), 7, ["model"]).select("model", "bin", "count", r6("mean_probability"), r6("observed_frequency"))


@query("M07_calibration_by_group", f"""
WITH s AS (SELECT * {SCORED}), k AS (SELECT *, CAST(least(10, greatest(2, count(*) OVER (PARTITION BY election_year, uf, days_before_election) // 4)) AS BIGINT) AS nb FROM s),
 b AS (SELECT *, len(list_filter(range(1, nb), lambda i: win_probability >= i * (1e0 / nb))) AS bin FROM k),
 g AS (SELECT election_year, uf, days_before_election, bin, count(*) AS n, avg(win_probability) AS p, avg(outcome) AS y, sum(pow(win_probability - outcome, 2)) AS q,
  sum(abs(predicted_share - actual_share)) AS e, sum(CAST(actual_share BETWEEN lower AND upper AS DOUBLE)) AS c FROM b GROUP BY ALL)
SELECT election_year, uf, days_before_election, CAST(sum(n) AS BIGINT) AS observations, {R("sum(q) / sum(n)", "brier")}, {R("sum(n * abs(p - y)) / sum(n)", "ece")},
 {R("sum(e) / sum(n)", "vote_share_mae")}, {R("sum(c) / sum(n)", "interval_coverage")} FROM g GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    g = sc.calibration_by_group(sc.scored(v.forecasts(spark, d)), ["election_year", "uf", "days_before_election"])
    return g.select("election_year", "uf", "days_before_election", "observations", r6("brier"), r6("ece"), r6("vote_share_mae"), r6("interval_coverage"))


@query("M08_backtest_metrics", f"""
WITH f AS (FROM forecasts WHERE outcome IS NOT NULL), b AS (SELECT *, len(list_filter(range(1, 10), lambda i: win_probability >= i * (1e0 / 10))) AS bin FROM f),
 c AS (SELECT model, sum(n * abs(p - y)) / sum(n) AS ce FROM (SELECT model, bin, count(*) AS n, avg(win_probability) AS p, avg(outcome) AS y FROM b GROUP BY ALL) GROUP BY model)
SELECT model, count(*) AS observations, {R("avg(pow(win_probability - outcome, 2))", "brier")}, {R(LOSS.format(e="1e-12"), "log_loss")}, {R("any_value(ce)", "calibration_error")},
 {R("avg(abs(predicted_share - actual_share))", "vote_share_mae")}, {R("avg(CAST(actual_share BETWEEN lower AND upper AS DOUBLE))", "interval_coverage")} FROM f JOIN c USING (model) GROUP BY model""", ("forecasts",))
def _(spark, d):
    g = sc.backtest_metrics(v.forecasts(spark, d).where(F.col("outcome").isNotNull()), ["model"])
    return g.select("model", "observations", r6("brier"), r6("log_loss"), r6("calibration_error"), r6("vote_share_mae"), r6("interval_coverage"))


@query("B08_snapshot_metrics", f"""
SELECT election_year, days_before_election, level, count(*) AS observations, {R("avg(pow(win_probability - outcome, 2))", "brier")}, {R(LOSS.format(e="1e-9"), "log_loss")},
 {R("avg(abs(predicted_share - actual_share))", "vote_share_mae")}, {R("avg(CAST(actual_share BETWEEN lower AND upper AS DOUBLE))", "interval_coverage")} {SCORED} GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    g = sc.snapshot_metrics(v.forecasts(spark, d))
    return g.select("election_year", "days_before_election", "level", "observations", r6("brier"), r6("log_loss"), r6("vote_share_mae"), r6("interval_coverage"))


@query("B09_state_metrics", f"""
SELECT election_year, uf, count(*) AS observations, {R("avg(abs(predicted_share - actual_share))", "vote_share_mae")}, {R("avg(CAST(actual_share BETWEEN lower AND upper AS DOUBLE))", "interval_coverage")},
 {R("avg(pow(win_probability - outcome, 2))", "winner_brier")} {SCORED} AND level = 'state' GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    return sc.state_metrics(v.forecasts(spark, d)).select("election_year", "uf", "observations", r6("vote_share_mae"), r6("interval_coverage"), r6("winner_brier"))


@query("E13_calibration_slope", f"""
WITH x AS (SELECT model, greatest(least(win_probability, 1 - 1e-5), 1e-5) AS p, outcome AS y FROM forecasts WHERE outcome IS NOT NULL),
 w AS (SELECT model, ln(p / (1 - p)) AS x, greatest(p * (1 - p), 1e-4) AS w, ln(p / (1 - p)) + (y - p) / greatest(p * (1 - p), 1e-4) AS t FROM x),
 s AS (SELECT model, sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(w * t) AS u, sum(w * x * t) AS v FROM w GROUP BY model)
SELECT model, {R("(c * u - b * v) / (a * c - b * b)", "intercept")}, {R("(a * v - b * u) / (a * c - b * b)", "slope")} FROM s""", ("forecasts",))
def _(spark, d):
    return sc.calibration_slope(v.forecasts(spark, d).where(F.col("outcome").isNotNull()), ["model"]).select("model", r6("intercept"), r6("slope"))


def event_halves(spark, d):
    e = v.table(spark, d, "events").select("event_type", "value", "ts")
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    return e.where(F.col("ts") < mid), e.where(F.col("ts") >= mid)


_EDGES = "[" + ", ".join(f"quantile_cont(value, {i}e0 / 10)" for i in range(11)) + "]"


@query("M10_psi", f"""
WITH r AS (SELECT event_type, list_sort(list_distinct({_EDGES})) AS e FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY event_type),
 b AS (SELECT event_type, ts < TIMESTAMP '2024-01-16' AS ref, len(list_filter(e[2:len(e) - 1], lambda z: z <= value)) AS bin FROM events JOIN r USING (event_type)),
 c AS (SELECT event_type, bin, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc FROM b GROUP BY ALL),
 s AS (SELECT event_type, greatest(nr / sum(nr) OVER (PARTITION BY event_type), 1e-6) AS pr, greatest(nc / sum(nc) OVER (PARTITION BY event_type), 1e-6) AS pc FROM c)
SELECT event_type, {R("sum((pc - pr) * ln(pc / pr))", "psi")} FROM s GROUP BY event_type""")
def _(spark, d):
    ref, cur = event_halves(spark, d)
    return sc.psi(ref, cur, "value", ["event_type"]).select("event_type", r6("psi"))


@query("M11_mean_shift", f"""
SELECT event_type, {R("abs(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') - avg(value) FILTER (ts < TIMESTAMP '2024-01-16')) / stddev_samp(value) FILTER (ts < TIMESTAMP '2024-01-16')", "mean_shift")}
FROM events GROUP BY event_type""")
def _(spark, d):
    ref, cur = event_halves(spark, d)
    return sc.mean_shift(ref, cur, "value", ["event_type"]).select("event_type", r6("mean_shift"))


# ---- robustness ---------------------------------------------------------------


def paired(spark, d):
    return rb.paired_difference(record_metrics(spark, d), "election_year", "model_O", "model_F", "vote_share_mae")


SQL_PAIR = """pr AS (SELECT election_year, avg(vote_share_mae) FILTER (model = 'model_O') - avg(vote_share_mae) FILTER (model = 'model_F') AS d FROM rec GROUP BY election_year)"""


@query("M12_paired_difference", f"WITH {SQL_REC}, {SQL_PAIR} SELECT election_year, {R('d', 'difference')} FROM pr WHERE d IS NOT NULL", ("forecasts",))
def _(spark, d):
    return paired(spark, d).select("election_year", r6("difference"))


@query("M13_cluster_bootstrap", f"""
WITH {SQL_REC}, {SQL_PAIR}, vs AS (SELECT list(d ORDER BY election_year) AS v FROM pr),
 m AS (SELECT id, avg(v[CAST(('0x' || substr(sha256('42:' || id || ':' || i), 1, 8))::UBIGINT % len(v) AS INTEGER) + 1]) AS m
  FROM (SELECT unnest(range(20000)) AS id), (SELECT v, unnest(range(len(v))) AS i FROM vs) GROUP BY id)
SELECT {R("(SELECT avg(d) FROM pr)", "mean_difference")}, {R("quantile_cont(m, 0.025e0)", "lower")}, {R("quantile_cont(m, 0.975e0)", "upper")},
 {R("avg(CAST(m < 0 AS DOUBLE))", "probability_improvement")}, {R("avg(CAST(m > 0 AS DOUBLE))", "probability_positive")}, count(*) AS draws FROM m""", ("forecasts",))
def _(spark, d):
    b = rb.cluster_bootstrap(paired(spark, d), 20_000, 42, cluster="election_year")
    return b.select(r6("mean_difference"), r6("lower"), r6("upper"), r6("probability_improvement"), r6("probability_positive"), "draws")


@query("M14_loeo_select", f"""
WITH {SQL_REC}, y AS (SELECT DISTINCT election_year AS h FROM rec), t AS (SELECT h, prior_strength, avg(vote_share_mae) + 0.25e0 * avg(winner_brier) AS o FROM rec, y WHERE election_year <> h GROUP BY ALL),
 b AS (SELECT h, prior_strength, o FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY o, prior_strength) AS rn FROM t) WHERE rn = 1)
SELECT h AS test_election, prior_strength AS selected_prior_strength, {R("any_value(o)", "train_objective")}, {R("avg(vote_share_mae)", "test_vote_share_mae")}, {R("avg(winner_brier)", "test_winner_brier")}, count(*) AS test_observations
FROM b JOIN rec r ON r.election_year = h AND r.prior_strength = b.prior_strength GROUP BY h, b.prior_strength""".replace("prior_strength AS selected", "b.prior_strength AS selected"), ("forecasts",))
def _(spark, d):
    g = rb.loeo_select(record_metrics(spark, d), {"vote_share_mae": 1.0, "winner_brier": 0.25}, ["vote_share_mae", "winner_brier"])
    return g.select("test_election", "selected_prior_strength", r6("train_objective"), r6("test_vote_share_mae"), r6("test_winner_brier"), "test_observations")


@query("T03_best_strength", f"""
WITH {SQL_REC}, t AS (SELECT uf, prior_strength, avg(vote_share_mae) AS o FROM rec GROUP BY ALL)
SELECT uf, prior_strength FROM (SELECT *, row_number() OVER (PARTITION BY uf ORDER BY o, prior_strength) AS rn FROM t) WHERE rn = 1""", ("forecasts",))
def _(spark, d):
    g = record_metrics(spark, d).groupBy("uf", "prior_strength").agg(F.avg("vote_share_mae").alias("o"))
    return g.groupBy("uf").agg(F.min_by("prior_strength", F.struct("o", "prior_strength")).alias("prior_strength"))


@query("M15_loeo_influence", f"""
WITH {SQL_REC}, y AS (SELECT DISTINCT election_year AS h FROM rec)
SELECT h AS omitted_election, model, {R("avg(vote_share_mae)", "vote_share_mae")}, {R("avg(coverage)", "coverage")}, {R("avg(winner_brier)", "winner_brier")}, count(*) AS observations FROM rec, y WHERE election_year <> h GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    return rb.loeo_influence(record_metrics(spark, d)).select("omitted_election", "model", r6("vote_share_mae"), r6("coverage"), r6("winner_brier"), "observations")


# ---- lineage ------------------------------------------------------------------


@query("W09_version_numbers", """
WITH f AS (SELECT event_type, user_id, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT event_type, user_id, 'v' || lpad(CAST(row_number() OVER (PARTITION BY event_type ORDER BY first_id) AS VARCHAR), 6, '0') AS version FROM f""")
def _(spark, d):
    return ln.number_versions(v.table(spark, d, "events"), "event_type", "user_id", "event_id", F.floor(F.col("event_id") / 4096)).select("event_type", "user_id", "version")


@query("S09_write_reports", f"""
SELECT 'snapshot' AS report, CAST(election_year AS VARCHAR) || '/' || days_before_election || '/' || level AS unit, count(*) AS observations, {R("avg(pow(win_probability - outcome, 2))", "value")} {SCORED} GROUP BY election_year, days_before_election, level
UNION ALL SELECT 'state', CAST(election_year AS VARCHAR) || '/' || uf, count(*), {R("avg(pow(win_probability - outcome, 2))", "value")} {SCORED} AND level = 'state' GROUP BY election_year, uf
UNION ALL SELECT 'calibration_by_uf', CAST(election_year AS VARCHAR) || '/' || uf, count(*), {R("avg(pow(win_probability - outcome, 2))", "value")} {SCORED} AND level = 'state' GROUP BY election_year, uf
UNION ALL SELECT 'calibration_by_election', CAST(election_year AS VARCHAR) || '/' || level, count(*), {R("avg(pow(win_probability - outcome, 2))", "value")} {SCORED} GROUP BY election_year, level
UNION ALL SELECT 'bins', CAST(len(list_filter(range(1, 10), lambda i: win_probability >= i * (1e0 / 10))) AS VARCHAR), count(*), {R("avg(outcome)", "value")} {SCORED} GROUP BY 2
UNION ALL SELECT 'forecasts', 'all', count(*), {R("avg(win_probability)", "value")} FROM forecasts
UNION ALL SELECT 'scoreable', 'all', count(*), {R("avg(win_probability)", "value")} {SCORED}""", ("forecasts",))
def _(spark, d):
    from tallyframe.sources.sinks import write_reports
    root, f = scratch_dir(spark, "reports"), cut_lineage(v.forecasts(spark, d))
    scored = sc.scored(f)
    states = scored.where(F.col("level") == "state")
    write_reports({
        "forecasts": f, "scoreable": scored, "snapshot": sc.snapshot_metrics(f), "state": sc.state_metrics(f),
        "calibration_by_election": sc.calibration_by_group(scored, ["election_year", "level"]),
        "calibration_by_uf": sc.calibration_by_group(states, ["election_year", "uf"]), "bins": sc.reliability_bins(scored),
    }, root)
    year = F.col("election_year").cast("string")
    units = {
        "snapshot": (F.concat_ws("/", year, F.col("days_before_election").cast("string"), "level"), "brier"), "state": (F.concat_ws("/", year, "uf"), "winner_brier"),
        "calibration_by_uf": (F.concat_ws("/", year, "uf"), "brier"), "calibration_by_election": (F.concat_ws("/", year, "level"), "brier"),
        "bins": (F.col("bin").cast("string"), "observed_frequency"),
    }
    parts = [
        spark.read.parquet(f"{root}/{name}").withColumnRenamed("count", "observations").select(F.lit(name).alias("report"), unit.alias("unit"), "observations", r6(value, "value"))
        for name, (unit, value) in units.items()
    ]
    parts += [
        spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("observations"), r6(F.avg("win_probability"), "value")).select(F.lit(name).alias("report"), F.lit("all").alias("unit"), "observations", "value")
        for name in ("forecasts", "scoreable")
    ]
    return reduce(DataFrame.unionByName, parts)


@query("S10_file_manifest")
def _(spark, d):
    return ln.file_manifest(spark, d)


@query("S10_manifest_of_results", """
WITH l AS (SELECT "year", concat_ws('|', uf, candidate_name, CAST(votes AS VARCHAR)) AS line FROM results),
 f AS (SELECT "year", string_agg(line, chr(10) ORDER BY line) || chr(10) AS body FROM l GROUP BY ALL)
SELECT CAST("year" AS INTEGER) AS election_year, strlen(body) AS bytes, sha256(body) AS sha256 FROM f""", ("results",))
def _(spark, d):
    root = scratch_dir(spark, "manifest")
    line = F.concat_ws("|", "uf", "candidate_name", F.col("votes").cast("string"))
    lines = v.results(spark, d).select("year", line.alias("line")).repartition("year").sortWithinPartitions("year", "line")
    lines.write.partitionBy("year").text(root)  # one file per year
    files = ln.file_manifest(spark, root).where(F.col("path").contains("/part-"))
    return files.select(F.regexp_extract("path", r"year=(\d+)/", 1).cast("int").alias("election_year"), "bytes", "sha256")


@query("S11_append_records", """SELECT CAST(event_id AS VARCHAR) AS run_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS sha256 FROM events""")
def _(spark, d):
    path = scratch_dir(spark, "records")
    e = v.table(spark, d, "events").withColumn("run_id", F.col("event_id").cast("string"))
    ln.append_records(e.where(F.col("event_type") == "click"), path, ["user_id", "event_type"])
    ln.append_records(e.where(F.col("event_type") != "click"), path, ["user_id", "event_type"])
    return ln.read_records(spark, path).select("run_id", "sha256")


@query("S11_find_record", """SELECT CAST(event_id AS VARCHAR) AS run_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS sha256 FROM events
 WHERE event_id = (SELECT max(event_id) FROM events WHERE event_type = 'click')""")
def _(spark, d):
    path = scratch_dir(spark, "records")
    e = v.table(spark, d, "events").withColumn("run_id", F.col("event_id").cast("string"))
    ln.append_records(e, path, ["user_id", "event_type"])
    last = e.where(F.col("event_type") == "click").agg(F.max("event_id").cast("string").alias("i")).first()["i"]
    return ln.find_record(spark, path, last).select("run_id", "sha256")


@query("G01_register_versions", """
SELECT 'results' AS dataset_name, 'v000001' AS version, count(*) AS row_count, CAST(NULL AS VARCHAR) AS parent_version, 1 AS contents FROM results
UNION ALL SELECT 'results', 'v000002', count(*), 'v000001', 1 FROM results WHERE "year" > 1996""", ("results",))
def _(spark, d):
    reg = ln.Registry(spark, scratch_dir(spark, "registry"))
    r = v.results(spark, d)
    reg.register("results", r, "2001-01-01", metadata={"kind": "check"})
    reg.register("results", r.orderBy(F.desc("votes")))
    reg.register("results", r.where(F.col("year") > 1996), parent_version="v000001")
    return reg.list_versions("results").groupBy("dataset_name", "version", "row_count", "parent_version").agg(F.count_distinct("sha256").cast("int").alias("contents"))


@query("G02_run_lineage", """
SELECT 'E-' || "year" AS election_id, CAST("year" AS INTEGER) AS election_year, 'v' || lpad(CAST(row_number() OVER (ORDER BY "year") AS VARCHAR), 6, '0') AS results_version,
 count(*) AS row_count, true AS same_content, CASE WHEN "year" < 1998 THEN 'OPEN' ELSE 'BLOCKED' END AS publication_status
FROM results GROUP BY "year" ORDER BY "year" LIMIT 3""", ("results",))
def _(spark, d):
    reg = ln.Registry(spark, scratch_dir(spark, "registry"))
    r = cut_lineage(v.results(spark, d))
    years = [x["year"] for x in r.select("year").distinct().orderBy("year").limit(3).collect()]
    for year in years:
        part = r.where(F.col("year") == year)
        ver = reg.register("results", part, f"{year}-12-31")
        reg.record_run(f"E-{year}", year, f"{year}-12-31", "1", {"results": ver["version"]}, part, "historical", "OPEN" if year < 1998 else "BLOCKED")
    known = reg.list_versions("results").select(F.col("version").alias("results_version"), "row_count", "sha256")
    runs = reg.list_runs(5).withColumn("results_version", F.col("input_versions")["results"]).join(known, "results_version")
    return runs.select("election_id", "election_year", "results_version", "row_count", (F.col("output_sha256") == F.col("sha256")).alias("same_content"), "publication_status")
