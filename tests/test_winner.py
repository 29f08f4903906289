"""The batched winner model and balanced folds beside plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import regression as rg, snapshots as sn

FEATURES = ("a", "b", "flat", "void", "late")


def races(seed=4, n=40):
    rng = random.Random(seed)
    rows = []
    for race in range(n):
        best = rng.randrange(4)
        for c in range(4):
            a = rng.gauss(2.0 if c == best else 0.0, 1.0)
            rows.append((f"r{race}", f"c{c}", int(c == best), a * 10 + 20, None if rng.random() < 0.2 else a, float("nan") if rng.random() < 0.1 else rng.gauss(0, 5),
                         3.0, None, rng.random() if race == 0 else None))
    return rows


SCHEMA = "race string, candidate_id string, won int, poll_mean double, a double, b double, flat double, void double, late double"


def plain_fit(rows, c=0.65):
    """Median imputation, standardising, balanced weights, Newton on the penalised sum of losses."""
    x = np.array([[np.nan if v is None else v for v in r[4:]] for r in rows], dtype=float)
    y = np.array([r[2] for r in rows], dtype=float)
    used = [i for i in range(x.shape[1]) if not np.isnan(x[:, i]).all()]
    medians = np.array([np.nanmedian(x[:, i]) for i in used])
    x = np.where(np.isnan(x[:, used]), medians, x[:, used])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    x = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.diag([0.0] + [1 / c] * len(used))
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ b)
    return used, medians, mean, sd, b


def test_winner_equals_plain_newton(spark):
    rows = races()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fit = rg.fit_winner(df, FEATURES)
    used, medians, mean, sd, b = plain_fit(rows)
    assert fit.features == tuple(FEATURES[i] for i in used) and fit.empty == ("void",)
    np.testing.assert_allclose(fit.medians, medians)
    np.testing.assert_allclose(fit.beta, b, atol=1e-8)
    gradient = {r["term"]: r["gradient"] for r in rg.winner_gradient(fit, df).collect()}
    assert set(gradient) == {"intercept", *fit.features} and max(map(abs, gradient.values())) < 1e-10
    scored = rg.score_winner(fit, df, ["race"])
    assert scored.groupBy("race").agg(F.sum("ml_probability").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_folds_are_trained_together(spark):
    """All folds come from the same jobs and equal a fit of each fold by itself, with a feature that only some folds have."""
    rows = races(7, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    scored = rg.out_of_fold(df, "race", 3, FEATURES).collect()
    fold = {r["race"]: r["fold"] for r in scored}
    assert set(fold.values()) == {0, 1, 2}
    raw = {}
    for m in range(3):
        used, medians, mean, sd, b = plain_fit([r for r in rows if fold[r[0]] != m])
        assert (4 in used) == (fold["r0"] != m)
        for r in rows:
            if fold[r[0]] == m:
                x = np.array([np.nan if v is None else v for v in r[4:]], dtype=float)[used]
                x = (np.where(np.isnan(x), medians, x) - mean) / sd
                raw[r[0], r[1]] = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    total = defaultdict(float)
    for (race, _), p in raw.items():
        total[race] += p
    for r in scored:
        assert r["probability"] == pytest.approx(raw[r["race"], r["candidate_id"]] / total[r["race"]], abs=1e-8)
    out = rg.evaluate_oof(df, "race", 3, FEATURES).first()
    assert out["observations"] == len(rows) and out["races"] == 30 and 0 < out["model_brier"] < 0.25


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(*r[:2], 0, *r[3:]) for r in races(1, 3)], SCHEMA)
    with pytest.raises(ValueError, match="both classes"):
        rg.fit_winner(df, FEATURES)


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for key, n in sorted(sizes.items(), key=lambda x: (-x[1], hashlib.md5(x[0].encode()).hexdigest(), x[0])):
        out[key] = loads.index(min(loads))
        loads[out[key]] += n
    return out, loads


@pytest.mark.parametrize("k", [1, 2, 5, 7])
def test_group_folds_equal_greedy_packing(spark, k):
    rng = random.Random(k)
    sizes = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 3, 8, 21]) for i in range(200)} | {"huge": 150}
    rows = [(g,) for g, n in sizes.items() for _ in range(n)]
    got = sn.group_kfold(spark.createDataFrame(rows, "g string").repartition(4), "g", k)
    assert got.count() == len(rows)
    folds = {r["g"]: r["fold"] for r in got.distinct().collect()}
    want, loads = greedy(sizes, k)
    assert folds == want
    assert max(loads) - min(loads) <= max(sizes.values())


def test_group_folds_with_null_and_too_few_groups(spark):
    df = spark.createDataFrame([(None,), (None,), ("",), ("a",)], "g string")
    got = {(r["g"], r["fold"]) for r in sn.group_kfold(df, "g", 2).collect()}
    assert len(got) == 3 and {g for g, _ in got} == {None, "", "a"}
    with pytest.raises(ValueError, match="4 folds"):
        sn.group_kfold(df, "g", 4)


def test_packing_serves_long_runs():
    """Groups of one size are dealt without walking them one by one."""
    (_, starts, orders), (_, after, _) = sn._packing([(7, 10**12 + 3), (2, 5)], 5)
    assert starts[-1] == 0 and orders[-1] == [0, 1, 2, 3, 4]
    assert after == [0, 0, 6, 6, 6]  # folds 3 and 4 are a group of 7 behind: three rounds of two before all take turns
