"""Behaviour on small frames: leakage, simplex, order, gates, drift, models."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import numeric as nm, text as tx
from tallyframe.operators import (
    baselines as bl, candidates as cd, draws as dr, gates, lineage as ln, polls as po, priors as pr, quality as qu,
    quantiles as qt, regression as rg, results as rs, robustness as rb, scoring as sc, snapshots as sn,
)
from tallyframe.sources import readers as rd

POLL = "poll_id string, field_date date, candidate_id string, candidate_name string, share double"


def one(df):
    return df.first().asDict()


# ---- text and numbers -----------------------------------------------------------


@pytest.mark.parametrize("raw, want", [
    ("45,5%", 0.455), ("0.5%", 0.5), ("–", None), ("", None), ("N/A", None), (" 12 ", 0.12), ("-3", -3.0), ("abc", None), ("1", 1.0),
])
def test_parse_percent(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "x string").select(tx.parse_percent("x").alias("y")))["y"] == want


@pytest.mark.parametrize("raw, want", [
    ("1.234.567", 1234567.0), ("12,5", 12.5), ("1.5", 1.5), ("1.234,5", None), ("R$ 10", 10.0), ("", None), ("x", None),
])
def test_parse_locale_number(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "x string").select(tx.parse_locale_number("x").alias("y")))["y"] == want


@pytest.mark.parametrize("raw, want", [
    ("2018-09-11", date(2018, 9, 11)), ("11/09/2018", date(2018, 9, 11)), ("3 a 5 de Março de 2014", date(2014, 3, 5)),
    ("3–5 October", date(2022, 10, 5)), ("28 September 2018", date(2018, 9, 28)), ("soon", None), ("31 de fevereiro", None),
])
def test_parse_period_end(spark, raw, want):
    got = one(spark.createDataFrame([(raw,)], "x string").select(tx.parse_period_end("x", F.lit(2022)).alias("y")))
    assert got["y"] == want


@pytest.mark.parametrize("raw, want", [
    ("Luiz Inácio Lula da Silva", "lula"), ("Jair Bolsonaro (PL)", "bolsonaro"), ("João Amoêdo", "amoedo"),
    ("Ciro Ferreira Gomes", "ciro"), ("Cabo Daciolo", "cabo_daciolo"),
])
def test_canonical_candidate(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "x string").select(cd.canonical_candidate("x").alias("y")))["y"] == want


def test_slug_and_fold(spark):
    row = one(spark.createDataFrame([("  José   da SILVA-Ramos ﬁm",)], "x string").select(tx.slug("x").alias("s"), tx.fold("x").alias("f")))
    assert row == {"s": "jose_da_silva_ramos_fim", "f": "jose da silva-ramos fim"}


def test_child_seed_matches_its_definition(spark):
    import hashlib
    want = int.from_bytes(hashlib.sha256(b"42:polls").digest()[:4], "big")
    assert one(spark.range(1).select(nm.child_seed(42, "polls").alias("s")))["s"] == want


# ---- snapshots and folds ----------------------------------------------------------


def snapshot_polls(spark, extra=()):
    day = date(2022, 10, 2)
    rows = []
    for pid, back, slate in (("old", 60, "AB"), ("new", 20, "ABC"), ("new2", 25, "ABC")):
        rows += [(pid, day - timedelta(days=back), c, c, 10.0) for c in slate]
    return spark.createDataFrame(rows + list(extra), POLL)


def test_snapshot_uses_only_the_latest_slate_and_no_future_poll(spark):
    day = date(2022, 10, 2)
    polls = snapshot_polls(spark, [("future", day - timedelta(days=2), c, c, 90.0) for c in "ABC"])
    got = sn.build_snapshots(polls, [(2022, day, None, None)], (15, 30, 1))
    by = {(r["days_before_election"], r["poll_id"]) for r in got.select("days_before_election", "poll_id").distinct().collect()}
    assert by == {(15, "new"), (15, "new2"), (30, "old"), (1, "new"), (1, "new2"), (1, "future")}


def test_adding_future_rows_leaves_snapshots_equal(spark):
    day = date(2022, 10, 2)
    cal = [(2022, day, None, date(2022, 9, 20))]
    a = sn.build_snapshots(snapshot_polls(spark), cal, (15, 7))
    b = sn.build_snapshots(snapshot_polls(spark, [("z", day + timedelta(days=1), c, c, 1.0) for c in "AB"]), cal, (15, 7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {r["scorable"] for r in a.where("days_before_election = 15").collect()} == {False}


def test_unsupported_election():
    assert sn.election(2018)[1] == date(2018, 10, 7)
    with pytest.raises(ValueError):
        sn.election(1999)


def test_rolling_origin_needs_enough_days(spark):
    df = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3, 3)], "d date")
    assert sn.rolling_origin(df, "d", 3).count() == 0
    row = one(sn.rolling_origin(df, "d", 2))
    assert (row["n_train"], row["n_test"], row["cutoff"]) == (2, 2, date(2024, 1, 2))


def test_leakage_assertion(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1)), (2, None), (3, date(2024, 2, 1))], "id int, d date")
    with pytest.raises(ValueError):
        qu.assert_not_after(df, "d", "2024-01-15", ["id"])
    qu.assert_not_after(df.where("id = 1"), "d", "2024-01-15", ["id"])
    assert [r["id"] for r in qu.available_as_of(df, "2024-01-15", "d").collect()] == [1]


# ---- baselines ------------------------------------------------------------------------


def dynamic_polls(spark, n=6):
    rows = []
    for p in range(n):
        for c, s in zip("ABC", (45.0 + p, 35.0 - p, 20.0)):
            rows.append(("E", f"p{p}", date(2022, 9, 1) + timedelta(days=2 * p), c, c, s, 1000 + 100 * p, 2.0 + p % 2, date(2022, 9, 15), date(2022, 9, 20), date(2022, 10, 2)))
    return spark.createDataFrame(rows, "k string, poll_id string, field_date date, candidate_id string, candidate_name string, share double, sample_size int, margin_error double, as_of date, near date, far date")


def test_local_level_matches_the_matrix_filter_and_grows_with_the_horizon(spark):
    polls = dynamic_polls(spark)
    near = {r["candidate_id"]: r for r in bl.local_level(polls, ["k"], "as_of", "near").collect()}
    far = {r["candidate_id"]: r for r in bl.local_level(polls, ["k"], "as_of", "far").collect()}
    assert all(far[c]["variance"] > near[c]["variance"] for c in near)
    pdf = polls.toPandas().pivot_table(index=["field_date", "poll_id"], columns="candidate_id", values="share").sort_index()
    x = pdf.to_numpy() / pdf.to_numpy().sum(axis=1, keepdims=True)
    y = np.log(x[:, :-1] / x[:, [-1]])
    m, p, last = y[0].copy(), np.eye(2) * 0.35, pdf.index[0][0]
    for i, (day, _) in enumerate(pdf.index):
        p = p + np.eye(2) * 0.025**2 * (day - last).days
        r = max(0.075, 2.5 * max((2.0 + i % 2) / 100 / 1.96, 0.008)) ** 2
        gain = p @ np.linalg.inv(p + np.eye(2) * r)
        m, p, last = m + gain @ (y[i] - m), (np.eye(2) - gain) @ p, day
    assert [near["A"]["mean"], near["B"]["mean"]] == pytest.approx(list(m), abs=1e-12)
    assert near["A"]["variance"] == pytest.approx(p[0, 0] + 0.025**2 * (date(2022, 9, 20) - last).days + 1e-8, abs=1e-12)


def test_baseline_centres_are_compositions(spark):
    b = bl.baseline_centers(bl.polling_baseline(dynamic_polls(spark), ["k"], "as_of"), ["k"])
    totals = {r["method"]: r["s"] for r in b.groupBy("method").agg(F.sum("share").alias("s")).collect()}
    assert set(totals) == set(nm.METHODS) and all(abs(v - 1) < 1e-12 for v in totals.values())


def test_incomplete_polls_are_listed_and_left_out(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "poll_id string, candidate_id string").withColumn("k", F.lit(1))
    assert [r["poll_id"] for r in po.incomplete_polls(df, ["k"]).collect()] == ["b"]
    assert {r["poll_id"] for r in po.complete_polls(df, ["k"]).collect()} == {"a"}
    with pytest.raises(ValueError, match="b"):
        po.require_complete(df, ["k"])
    po.require_complete(df.where("poll_id = 'a'"), ["k"])


def test_vote_counts_read_thousands(spark):
    texts = ["71.000 votos", "999.000", "1.234.000", "71,5", "71.5", "1.2345", "x", None]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.parse_vote_count("t").alias("v")).orderBy("i")
    assert [r["v"] for r in out.collect()] == [71000.0, 999000.0, 1234000.0, 71.5, 71.5, 1.2345, None, None]


def test_latest_refuses_other_limits(spark):
    from tallyframe.operators.lineage import latest

    for limit in (0, 1001):
        with pytest.raises(ValueError):
            latest(spark.range(3), ["id"], limit)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tallyframe.session import scratch_dir

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(SimpleNamespace(sparkContext=context, conf={}))


# ---- results and priors -----------------------------------------------------------------


def test_official_results_normalise(spark, tmp_path):
    path = tmp_path / "official.csv"
    path.write_text(
        "ANO_ELEICAO;NR_TURNO;SG_UF;DS_CARGO;NM_VOTAVEL;SG_PARTIDO;QT_VOTOS\n"
        "2022;1;SP;Presidente;ANA;PA;40\n2022;1;SP;Presidente;ANA;PA;20\n2022;1;SP;Presidente;JOSÉ;PB;40\n"
        "2022;1;SP;Presidente;NULO;#;7\n2022;1;SP;Governador;ANA;PA;99\n", encoding="latin-1",
    )
    got = {r["candidate_name"]: r["vote_share"] for r in rs.normalize_results(rd.read_official_csv(spark, str(path)), 2022).collect()}
    assert got == {"ANA": pytest.approx(0.6), "JOSÉ": pytest.approx(0.4)}


def test_series_json(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('[{"data": "02/01/2024", "valor": "1,5"}, {"data": "03/01/2024", "valor": "-"}]')
    assert [tuple(r) for r in rd.read_series_json(spark, str(path)).orderBy("date").collect()] == [(date(2024, 1, 2), 1.5), (date(2024, 1, 3), None)]


def test_priors_prefer_the_same_candidate_and_sum_to_100(spark):
    prev = spark.createDataFrame([
        (1, "SP", "Ana", "PA", 0.6), (1, "SP", "Bia", "PB", 0.4), (1, "RJ", "Ana", "PA", 0.3), (1, "RJ", "Bia", "PB", 0.7),
    ], "k int, uf string, candidate_name string, party string, vote_share double")
    cand = spark.createDataFrame([(1, "ana", "Ana", "PA"), (1, "caio", "Caio", "PB"), (1, "novo", "Novo", None)],
                                 "k int, candidate_id string, candidate_name string, party string")
    p = pr.build_state_priors(prev, cand, ["k"])
    src = {r["candidate_id"]: r["prior_source"] for r in p.where("uf = 'SP'").collect()}
    assert src == {"ana": "same_candidate", "caio": "same_party", "novo": "neutral"}
    assert all(abs(r["s"] - 100) < 1e-9 for r in p.groupBy("uf").agg(F.sum("prior_share").alias("s")).collect())


def test_unknown_state_is_an_error(spark):
    with pytest.raises(Exception, match="unknown state"):
        rs.add_macroregion(spark.createDataFrame([("XX",)], "uf string")).collect()


# ---- draws --------------------------------------------------------------------------------


def national(spark, n=200):
    return dr.draw_grid(spark.createDataFrame([("E",)], "k string"), ["k"], n, 3, 5).select(
        "k", "draw_id", F.concat(F.lit("c"), F.col("dim").cast("string")).alias("candidate_id"), (F.exp(0.2 * F.col("z")) * 30).alias("share"))


def lean(spark, share):
    rows = [("E", uf, f"c{i}", s, 100 / 3) for uf, ss in share.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "k string, uf string, candidate_id string, prior_share double, national_prior_share double")


def test_state_lean_moves_in_its_direction_and_closes(spark):
    got = dr.project_state_lean(national(spark), lean(spark, {"SP": (60.0, 20.0, 20.0), "RJ": (100 / 3,) * 3}), ["k"])
    mean = {(r["geo"], r["candidate_id"]): r["m"] for r in got.groupBy("geo", "candidate_id").agg(F.avg("share").alias("m")).collect()}
    assert mean[("SP", "c0")] > mean[("RJ", "c0")] + 10
    worst = got.groupBy("draw_id", "geo").agg(F.sum("share").alias("s")).agg(F.max(F.abs(F.col("s") - 100))).first()[0]
    assert worst < 1e-9


def test_incomplete_lean_fails(spark):
    with pytest.raises(Exception, match="incomplete state prior"):
        dr.project_state_lean(national(spark, 5), lean(spark, {"SP": (60.0, 40.0)}), ["k"]).collect()


@pytest.mark.parametrize("parts", [1, 200])
def test_draws_do_not_depend_on_partitioning(spark, parts):
    keys = spark.createDataFrame([(i,) for i in range(20)], "k int")
    a = dr.draw_grid(keys, ["k"], 50, 2, 7)
    b = dr.draw_grid(keys.repartition(parts), ["k"], 50, 2, 7)
    assert a.exceptAll(b).count() == 0
    z = a.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(z["m"]) < 0.1 and abs(z["s"] - 1) < 0.1


def test_many_draws_are_all_there(spark):
    rows = dr.spread_draws(spark.createDataFrame([("a",), ("b",)], "k string"), 10_000)
    got = rows.groupBy("k").agg(F.count_distinct("draw_id").alias("n"), F.max("draw_id").alias("m")).collect()
    assert {(r["n"], r["m"]) for r in got} == {(10_000, 9_999)}


def test_runoff_without_eliminated_candidates(spark):
    votes = spark.createDataFrame([("E", 1, "a", 60.0), ("E", 1, "b", 60.0)], "k string, draw_id long, candidate_id string, votes double")
    pairs = spark.createDataFrame([], "k string, source_id string, a_id string, b_id string, p_a double, p_abstain double")
    assert one(dr.runoff(votes, pairs, ["k"]))["winner_id"] == "a"


# ---- gates, quality, lineage ----------------------------------------------------------------


def test_release_gate(spark):
    rows = [("synthetic", "validated", 4, 0.18, 0.05), ("real", "validated", 4, 0.18, 0.05), ("real", "validated", 4, 0.18, 0.20)]
    got = gates.release_gate(spark.createDataFrame(rows, "dataset_type string, validation_status string, backtest_elections int, brier_score double, calibration_error double"))
    assert [(r["allowed"], len(r["reasons"])) for r in got.collect()] == [(False, 1), (True, 0), (False, 1)]


def test_publication_guard(spark):
    df = spark.createDataFrame([("synthetic", 2026, "independently_validated"), ("operational", 2026, "independently_validated")],
                               "dataset_type string, election_year int, validation_status string")
    assert [r["allowed"] for r in gates.publication_status(df).collect()] == [False, True]


def test_dataset_gate_and_empty(spark):
    schema = "poll_id string, institute string, fieldwork_end date, sample_size int, candidate_id string, share double"
    good = spark.createDataFrame([("1", "i", date(2024, 1, 1), 1000, "a", 40.0), ("1", "i", date(2024, 1, 1), 1000, "b", 60.0)], schema)
    assert one(qu.evaluate_dataset("polls", good))["allowed"]
    assert not one(qu.evaluate_dataset("polls", good.union(good)))["allowed"]
    empty = one(qu.evaluate_dataset("polls", good.limit(0)))
    assert empty["errors"] == ["polls: dataset is empty"]
    assert one(qu.evaluate_dataset("polls", good.drop("share")))["errors"] == ["polls: missing column share"]


def test_fingerprint_ignores_order_but_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, b string")
    digest = one(qu.table_fingerprint(a))["fingerprint"]
    assert digest == one(qu.table_fingerprint(a.orderBy(F.desc("a")).select("b", "a")))["fingerprint"]
    assert digest != one(qu.table_fingerprint(a.union(a)))["fingerprint"]
    assert digest != one(qu.table_fingerprint(a.fillna("n")))["fingerprint"]


def test_concurrent_writers_get_distinct_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    frames = [spark.range(n).withColumnRenamed("id", "a") for n in (1, 2, 3, 2, 1, 4)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda df: ln.Registry(spark, str(tmp_path / "reg")).register("t", df), frames))
    rows = ln.Registry(spark, str(tmp_path / "reg")).list_versions("t").collect()
    assert sorted(r["version"] for r in rows) == [f"v{i:06d}" for i in range(1, 5)]
    assert sorted(r["row_count"] for r in rows) == [1, 2, 3, 4]
    assert all(spark.read.parquet(r["snapshot_path"]).count() == r["row_count"] for r in rows)


@pytest.mark.parametrize("encoding, sep", [("utf-8", ";"), ("utf-8-sig", ","), ("latin-1", ";"), ("latin-1", ",")])
def test_official_files_in_either_encoding(spark, tmp_path, encoding, sep):
    lines = [["Ano da eleição", "SG_UF", "Município", "Votos nominais"], ["2022", "SP", "São Paulo", "7"], ["2022", "CE", "Crateús", "3"]]
    path = tmp_path / "f.csv"
    path.write_bytes("\n".join(sep.join(f'"{x}"' for x in line) for line in lines).encode(encoding))
    df = rd.read_official_csv(spark, str(path))
    assert df.columns == ["ANO_DA_ELEICAO", "SG_UF", "MUNICIPIO", "VOTOS_NOMINAIS"]
    assert [r["MUNICIPIO"] for r in df.orderBy(F.desc("VOTOS_NOMINAIS")).collect()] == ["São Paulo", "Crateús"]
    named = rd.read_official_csv(spark, str(path), {"uf": ["UF", "SG_UF"]})
    assert named.columns == ["uf"] and named.count() == 2
    with pytest.raises(ValueError, match="lacks columns"):
        rd.read_official_csv(spark, str(path), {"uf": ["X"]})


def test_bootstrap_of_many_clusters(spark):
    paired = spark.range(100_000).select(F.col("id").alias("election_year"), (F.sin("id") - 0.2).alias("difference"))
    out = one(rb.cluster_bootstrap(paired, 100, 3, cluster="election_year"))
    values = paired.agg(F.avg("difference").alias("m"), F.stddev_samp("difference").alias("s")).first()
    assert out["mean_difference"] == pytest.approx(values["m"]) and out["draws"] == 100
    assert out["lower"] < values["m"] < out["upper"] and out["upper"] - out["lower"] == pytest.approx(4 * values["s"] / 100_000**0.5, rel=0.4)
    assert out["probability_improvement"] == 1.0


def test_registry_versions_and_runs(spark, tmp_path):
    reg = ln.Registry(spark, str(tmp_path / "reg"))
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    first = reg.register("t", df)
    assert reg.register("t", df.orderBy(F.desc("a")))["version"] == first["version"] == "v000001"
    assert reg.register("t", df.union(spark.createDataFrame([(3, "z")], df.schema)))["version"] == "v000002"
    run = reg.record_run("E", 2022, "2022-01-01", "1", {"t": "v000001"}, df, "historical", "BLOCKED")
    assert one(reg.get_run(run))["input_versions"] == {"t": "v000001"} and reg.list_runs().count() == 1


def test_dedup_keeps_the_first_row_of_a_hot_group(spark):
    df = spark.range(3000).select("id", F.lit("p").alias("poll_id"), F.lit("c").alias("candidate_id"), F.lit(5.0).alias("share"))
    yes, no = qu.deduplicate_polls(df, "id")
    assert [r["id"] for r in yes.collect()] == [0] and no.count() == 2999


def test_chain_with_a_gap_is_broken(spark):
    rows = [(0, "a", qu.GENESIS, "h0"), (2, "c", "h0", "h2")]
    got = qu.verify_chain(spark.createDataFrame(rows, "seq long, body string, previous_hash string, record_hash string"), ["body"])
    assert {r["seq"]: r["link_ok"] for r in got.collect()} == {0: True, 2: False}


# ---- quantiles, drift, scores ------------------------------------------------------------------


def test_quantiles_are_exact_with_many_ties(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 == 0, 1.0).otherwise(F.sin(F.col("id")) * 100).alias("x"))
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in qt.grouped_quantiles(df, ["k"], "x", probs).collect()}
    for k, g in df.toPandas().groupby("k"):
        assert got[k] == pytest.approx(list(np.quantile(g["x"], probs)), abs=1e-12)


def test_outliers_keep_null_groups(spark):
    rows = [("a", None, float(x)) for x in (1, 2, 3, 100)] + [("b", "SP", 5.0)]
    got = qu.flag_outliers(spark.createDataFrame(rows, "candidate_id string, uf string, share double"))
    assert sorted((r["share"], r["is_outlier"]) for r in got.collect()) == [(1.0, False), (2.0, False), (3.0, False), (5.0, False), (100.0, True)]


def test_drift(spark):
    ref = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert one(sc.psi(ref, ref, "x"))["psi"] < 1e-9
    assert one(sc.mean_shift(ref, ref.select((F.col("x") + 50).alias("x")), "x"))["mean_shift"] > 0
    flat = ref.select(F.lit(1.0).alias("x"))
    assert one(sc.psi(flat, flat, "x"))["psi"] == 0.0
    assert one(sc.psi(flat, flat.select(F.lit(2.0).alias("x")), "x"))["psi"] == float("inf")


def test_scores_on_known_values(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5, 0.4, 0.6), (0.0, 0.0, 0.5, 0.6, 0.7), (1.0, 1.0, 0.5, 0.5, 0.5)], "outcome double, win_probability double, a double, lo double, hi double")
    row = one(df.agg(sc.brier("outcome", "win_probability").alias("b"), sc.coverage("a", "lo", "hi").alias("c")))
    assert row == {"b": 0.0, "c": pytest.approx(2 / 3)} and one(sc.ece(df))["ece"] == 0.0
    with pytest.raises(Exception, match="lower interval"):
        df.agg(sc.coverage("a", "hi", "lo")).collect()


def test_slope_of_a_single_probability_is_the_pseudo_inverse(spark):
    df = spark.createDataFrame([(1, 0.7), (0, 0.7), (1, 0.7)], "outcome int, win_probability double")
    got = one(sc.calibration_slope(df))
    p = np.array([0.7] * 3)
    x = np.log(p / (1 - p))
    d = np.column_stack([np.ones(3), x])
    w = p * (1 - p)
    t = x + (np.array([1, 0, 1]) - p) / w
    want = np.linalg.pinv(d.T @ (w[:, None] * d)) @ d.T @ (w * t)
    assert [got["intercept"], got["slope"]] == pytest.approx(list(want), abs=1e-9)


def test_bootstrap_and_holdout_choice(spark):
    rows = [(y, m, v) for y, a, b in ((2014, 0.06, 0.09), (2018, 0.05, 0.08), (2022, 0.07, 0.10)) for m, v in (("historical", a), ("neutral", b))]
    df = spark.createDataFrame(rows, "election_year int, model string, vote_share_mae double")
    b = one(rb.cluster_bootstrap(rb.paired_difference(df, "election_year", "historical", "neutral", "vote_share_mae"), 2000, 7, cluster="election_year"))
    assert b["mean_difference"] < 0 and b["upper"] < 0 and b["probability_improvement"] == 1.0
    sens = [(y, s, v) for y, a, c in ((2014, 0.08, 0.06), (2018, 0.09, 0.07), (2022, 0.03, 0.20)) for s, v in ((1.0, a), (2.5, c))]
    got = rb.loeo_select(spark.createDataFrame(sens, "election_year int, prior_strength double, vote_share_mae double"))
    chosen = {r["test_election"]: (r["selected_prior_strength"], r["test_vote_share_mae"]) for r in got.collect()}
    assert chosen[2022] == (2.5, pytest.approx(0.20))


# ---- models ---------------------------------------------------------------------------------------


def test_transfer_prefers_the_closer_finalist(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(250):
        a = rng.uniform(-1.5, 1.5)
        to_a = int(rng.binomial(450, 1 / (1 + np.exp(-2.2 * a))))
        rows.append((float(a), 0.0, 0.0, 0.0, 40.0, 1.0, to_a, 450 - to_a, 50))
    fit = rg.fit_transfer(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in rg.TRANSFER_FEATURES) + ", to_a long, to_b long, abstain long"))
    fund = spark.createDataFrame([("E", "S", -0.8, "x", 40.0, 0), ("E", "A", -0.7, "x", 35.0, 0), ("E", "B", 0.8, "y", 35.0, 0)],
                                 "k string, candidate_id string, ideology_score double, bloc string, rejection double, incumbency int")
    p = rg.predict_transfer(fit, cd.pair_features(fund, ["k"])).where("source_id = 'S' AND a_id = 'A'").first()
    assert p["p_a"] > 0.7 and 0.05 < p["p_abstain"] < 0.15


def test_turnout_matches_the_dense_ridge(spark):
    rows = []
    for i in range(30):
        rows.append(("SP" if i % 2 else "CE", 0.76 + (i % 3) * 0.01, 0.002 * (i % 5), 0.01, 0.1 * (i % 4), 0.2, 0.7, 0.77 + (i % 4) * 0.005))
    cols = [*rg.TURNOUT_FEATURES]
    df = spark.createDataFrame(rows, "uf string, " + ", ".join(f"{c} double" for c in cols) + ", turnout double")
    fit = rg.fit_turnout(df)
    pdf = df.toPandas()
    x = [np.ones(30)] + [(pdf[c] - pdf[c].mean()) / max(pdf[c].std(ddof=0), 1e-6) for c in cols] + [(pdf["uf"] == u).astype(float) for u in ("CE", "SP")]
    x = np.column_stack(x)
    y = np.log(pdf["turnout"] / (1 - pdf["turnout"])).to_numpy()
    prior = np.eye(9) / 1.25**2
    prior[0, 0] = 1 / 25
    beta = np.linalg.pinv(x.T @ x + prior) @ x.T @ y
    assert list(fit.beta) == pytest.approx(list(beta), abs=1e-8)
    assert fit.residual_sd == pytest.approx(max(np.sqrt(np.mean((y - x @ beta) ** 2)), 0.03))
    pred = rg.predict_turnout(fit, df.withColumn("registered_voters", F.lit(1.0)).withColumn("k", F.lit("E")).dropDuplicates(["uf"]))
    draws = rg.turnout_draws(pred, ["k"], 500, 42, fit.residual_sd)
    assert draws.count() == 1000 and draws.where(~F.col("turnout").between(0.35, 0.95)).count() == 0
