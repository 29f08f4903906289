"""Checks of the regression models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import regression as rg
from tallyframe.plans import views as v
from tallyframe.plans.registry import query, r6


def turnout_training(spark, d):
    """Turnout and order features per (month, state)."""
    g = v.lines_by_place(spark, d).groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.col("n_name").alias("uf")).agg(
        (1 - F.avg("l_discount") * 4).alias("turnout"), (1 - F.avg("l_tax") * 5).alias("historical_turnout"),
        (F.avg("l_linenumber") / 100 - 0.04).alias("abstention_trend"), (F.avg("l_quantity") / 500 - 0.05).alias("registration_growth"),
        (F.avg("o_totalprice") / 1e5 - 2.5).alias("mobility_index"), (F.avg("c_acctbal") / 5000).alias("weather_severity"),
        F.avg((F.col("l_returnflag") == "A").cast("double")).alias("competitiveness"))
    return g


@query("E08_turnout_model")
def _(spark, d):
    fit = rg.fit_turnout(turnout_training(spark, d))
    return fit.frame(spark).select("term", r6("estimate"), r6("standard_error"))


@query("E08_turnout_gradient", f"""
SELECT unnest({['intercept', *rg.TURNOUT_FEATURES]}) AS term, 0e0 AS gradient
UNION ALL SELECT DISTINCT 'uf=' || n_name, 0e0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    t = turnout_training(spark, d)
    return rg.turnout_gradient(rg.fit_turnout(t), t).select("term", r6("gradient"))


@query("E08_predict_turnout")
def _(spark, d):
    t = turnout_training(spark, d)
    latest = t.groupBy("uf").agg(*[F.max_by(c, "month").alias(c) for c in rg.TURNOUT_FEATURES])
    return rg.predict_turnout(rg.fit_turnout(t), latest).select("uf", r6("turnout_mean"), r6("latent_mean"), r6("latent_sd"))


def transfer_training(spark, d):
    """Transfers per (part brand, month): flags are the ways votes went."""
    part = v.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    li = v.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    def q(f):
        return F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)).cast("bigint")
    return li.groupBy("p_brand", F.date_trunc("month", "l_shipdate").alias("month")).agg(
        (F.avg("p_size") / 25 - 1).alias("distance_advantage_a"), (F.avg("l_tax") * 1000 - 40).alias("rejection_advantage_a"),
        F.signum(F.avg("l_linenumber") - 4).alias("same_bloc_advantage_a"), F.signum(F.avg("l_discount") - 0.05).alias("incumbency_advantage_a"),
        (F.avg("l_tax") * 1000).alias("source_rejection"), (F.avg("p_retailprice") / 1000).alias("finalist_distance_sum"),
        q("A").alias("to_a"), q("N").alias("to_b"), q("R").alias("abstain"))


@query("E09_transfer_model")
def _(spark, d):
    fit = rg.fit_transfer(transfer_training(spark, d))
    out = fit.conditional.frame(spark).withColumn("model", F.lit("conditional")).unionByName(fit.abstention.frame(spark).withColumn("model", F.lit("abstention")))
    return out.select("model", "term", r6("estimate"), r6("standard_error"))


@query("E09_transfer_gradient", f"""
SELECT model, term, 0e0 AS gradient FROM (SELECT unnest(['conditional', 'abstention']) AS model), (SELECT unnest({['intercept', *rg.TRANSFER_FEATURES]}) AS term)""")
def _(spark, d):
    t = transfer_training(spark, d)
    return rg.transfer_gradient(rg.fit_transfer(t), t).select("model", "term", r6("gradient"))


@query("E09_predict_transfer")
def _(spark, d):
    from tallyframe.operators.candidates import pair_features
    fit = rg.fit_transfer(transfer_training(spark, d))
    pairs = rg.predict_transfer(fit, pair_features(v.fund(spark, d), ["race"]))
    return pairs.select("race", "source_id", "a_id", "b_id", r6("p_a"), r6("p_abstain"))


STRUCTURAL_SQL = """SELECT year(l_shipdate) || '-' || s_nationkey AS election_id, p_brand AS candidate_id, CASE WHEN min(l_linenumber) > 1 THEN min(l_quantity) END AS media_sentiment_guarded
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


def structural(spark, d):
    """Races (year, supplier state) with brands as candidates; the brand with most votes won."""
    from pyspark.sql import Window
    part = v.table(spark, d, "part").select("p_partkey", "p_brand")
    sup = v.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    g = v.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.concat_ws("-", F.year("l_shipdate").cast("string"), F.col("s_nationkey").cast("string")).alias("election_id"), F.col("p_brand").alias("candidate_id")).agg(
        F.sum("l_extendedprice").alias("votes"), F.sum("l_quantity").alias("poll_mean"), F.avg("l_tax").alias("poll_trend_14d"), F.avg("l_discount").alias("rejection"),
        (F.count("*") % 2).alias("incumbency"), F.avg("l_linenumber").alias("government_approval"), F.max("l_tax").alias("inflation_12m"), F.min("l_tax").alias("unemployment"),
        F.max("l_discount").alias("gdp_yoy"), F.count("*").cast("double").alias("search_share_guarded"), F.when(F.min("l_linenumber") > 1, F.min("l_quantity")).alias("media_sentiment_guarded"),
        F.avg("l_quantity").alias("digital_signal_reliability"))
    w = Window.partitionBy("election_id").orderBy(F.desc("votes"), "candidate_id")
    return g.withColumn("won", (F.row_number().over(w) == 1).cast("int"))


@query("E10_winner_model")
def _(spark, d):
    s = structural(spark, d)
    return rg.score_winner(rg.fit_winner(s), s, ["election_id"]).select("election_id", "candidate_id", "won", r6("ml_probability"))


@query("E10_winner_gradient", f"""
WITH t AS ({STRUCTURAL_SQL}) SELECT term, 0e0 AS gradient FROM (SELECT unnest({['intercept', *rg.WINNER_FEATURES]}) AS term) f
 WHERE term <> 'media_sentiment_guarded' OR EXISTS (SELECT 1 FROM t WHERE media_sentiment_guarded IS NOT NULL)""")
def _(spark, d):
    s = structural(spark, d)
    return rg.winner_gradient(rg.fit_winner(s), s).select("term", r6("gradient"))


@query("E11_evaluate_oof")
def _(spark, d):
    return rg.evaluate_oof(structural(spark, d), "election_id").select(
        r6("model_brier"), r6("baseline_brier"), r6("model_log_loss"), r6("accuracy"), "observations", "races")
