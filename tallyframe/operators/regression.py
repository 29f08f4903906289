"""Turnout, transfer and winner models: Spark sums sufficient statistics, the driver solves p x p."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip, logit, num, sigmoid
from tallyframe.operators import scoring as sc
from tallyframe.operators.draws import normals, spread_draws
from tallyframe.operators.polls import require_columns
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.snapshots import group_kfold
from tallyframe.session import cut_lineage

# Feature names of the three models, an input contract.
TURNOUT_FEATURES = (
    "historical_turnout", "abstention_trend", "registration_growth",
    "mobility_index", "weather_severity", "competitiveness",
)
TRANSFER_FEATURES = (
    "distance_advantage_a", "rejection_advantage_a", "same_bloc_advantage_a",
    "incumbency_advantage_a", "source_rejection", "finalist_distance_sum",
)
WINNER_FEATURES = (
    "poll_mean", "poll_trend_14d", "rejection", "incumbency", "government_approval", "inflation_12m",
    "unemployment", "gdp_yoy", "search_share_guarded", "media_sentiment_guarded", "digital_signal_reliability",
)


# Fixed value: number of states; a system has one term for each.
STATES = 27


class LinearFit(NamedTuple):
    """Coefficients and their covariance; ``names`` lists intercept, features and state levels."""

    names: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    means: dict[str, float]
    scales: dict[str, float]
    residual_sd: float
    rows: int

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(b), float(self.covariance[i, i]) ** 0.5) for i, (n, b) in enumerate(zip(self.names, self.beta))]
        return spark.createDataFrame(rows, "term string, estimate double, standard_error double")


def _moments(df: DataFrame, features: Sequence[str], floor: float) -> tuple[dict, dict]:
    x = {f: num(f) for f in features}
    row = df.agg(*[F.avg(c).alias(f"m_{f}") for f, c in x.items()], *[F.stddev_pop(c).alias(f"s_{f}") for f, c in x.items()]).first()
    means = {f: float(row[f"m_{f}"] or 0.0) for f in features}
    return means, {f: max(float(row[f"s_{f}"] or 0.0), floor) for f in features}


def _standard(features: Sequence[str], means: dict, scales: dict) -> list[Column]:
    """Intercept and standardised features; a missing value takes the mean."""
    return [F.lit(1.0)] + [
        (F.coalesce(num(f), F.lit(means[f])) - F.lit(means[f])) / F.lit(scales[f]) for f in features
    ]


def _dot(beta: Sequence[float], x: Sequence[Column]) -> Column:
    out = F.lit(float(beta[0])) * x[0]
    for b, c in zip(beta[1:], x[1:]):
        out = out + F.lit(float(b)) * c
    return out


def fit_turnout(df: DataFrame, prior_sd: float = 1.25) -> LinearFit:
    """Bayesian ridge of logit turnout on six features and state effects.

    One pass sums products per state (at most 27 rows come back); the normal
    equations of the 34 terms are put together from them.
    """
    require_columns(df, (*TURNOUT_FEATURES, "uf", "turnout"), "turnout training data")
    means, scales = _moments(df, TURNOUT_FEATURES, 1e-6)
    q = len(TURNOUT_FEATURES) + 1
    rows = df.where(num("turnout").isNotNull()).select(
        F.col("uf").cast("string").alias("uf"), logit(num("turnout")).alias("y"),
        *[c.alias(f"x{i}") for i, c in enumerate(_standard(TURNOUT_FEATURES, means, scales))],
    )
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(q) for j in range(i, q)]
    targets = [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(q)]
    parts = rows.groupBy("uf").agg(*products, *targets, F.sum(F.col("y") * F.col("y")).alias("yy")).orderBy("uf").limit(STATES + 1).collect()
    if len(parts) > STATES:
        raise ValueError(f"turnout training data has more than {STATES} states")
    ufs = [r["uf"] for r in parts]
    p = q + len(ufs)
    xtx, xty, yy = np.zeros((p, p)), np.zeros(p), 0.0
    for k, r in enumerate(parts):
        block = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)])
        t = np.array([r[f"t{i}"] for i in range(q)])
        xtx[:q, :q] += block
        xty[:q] += t
        xtx[q + k, :q] = xtx[:q, q + k] = block[0]
        xtx[q + k, q + k] = block[0, 0]
        xty[q + k] = t[0]
        yy += r["yy"]
    prior = np.eye(p) / prior_sd**2
    prior[0, 0] = 1 / 25.0
    covariance = np.linalg.pinv(xtx + prior)
    beta = covariance @ xty
    n = xtx[0, 0]
    sse = max(yy - 2 * beta @ xty + beta @ xtx @ beta, 0.0)
    names = ("intercept", *TURNOUT_FEATURES, *[f"uf={u}" for u in ufs])
    return LinearFit(names, beta, covariance, means, scales, max(float(np.sqrt(sse / n)), 0.03), int(n))


def turnout_gradient(fit: LinearFit, df: DataFrame, prior_sd: float = 1.25) -> DataFrame:
    """Gradient of the penalised squares at the fit, per term and row of the data: zero at the solution."""
    q = len(TURNOUT_FEATURES) + 1
    x = _standard(TURNOUT_FEATURES, fit.means, fit.scales)
    x += [(F.col("uf").cast("string") == n[3:]).cast("double") for n in fit.names[q:]]
    beta, names = (F.array(*[F.lit(v) for v in values]) for values in ([float(b) for b in fit.beta], fit.names))
    rows = df.where(num("turnout").isNotNull()).select(F.array(*x).alias("_x"), logit(num("turnout")).alias("_y"))
    rest = F.aggregate(F.zip_with("_x", beta, lambda a, b: a * b), F.col("_y"), lambda s, v: s - v)
    rows = rows.withColumn("_r", rest).select("_r", F.posexplode("_x").alias("i", "_v")).select("i", (F.col("_v") * F.col("_r")).alias("g"))
    pull = F.element_at(beta, F.col("i") + 1) * F.when(F.col("i") == 0, 1 / 25.0).otherwise(1.0 / prior_sd**2)
    return rows.groupBy("i").agg(F.sum("g").alias("g")).select(F.element_at(names, F.col("i") + 1).alias("term"), ((F.col("g") - pull) / fit.rows).alias("gradient"))


def transfer_gradient(fit: TransferFit, df: DataFrame, prior_sd: float = 1.0) -> DataFrame:
    """Gradient of both penalised likelihoods at the fit, per term and row of the data: zero at the solution."""
    x = _standard(TRANSFER_FEATURES, fit.conditional.means, fit.conditional.scales)
    a, b, z = (F.col(c).cast("double") for c in ("to_a", "to_b", "abstain"))
    parts = []
    for name, one, took, of in (("conditional", fit.conditional, a, F.greatest(a + b, F.lit(1.0))), ("abstention", fit.abstention, z, F.greatest(a + b + z, F.lit(1.0)))):
        rest = took - of * sigmoid(_dot(one.beta, x))
        sums = df.agg(*[F.sum(c * rest).alias(f"g{i}") for i, c in enumerate(x)])
        pull = [float(v) * (1 / 25.0 if i == 0 else 1.0 / prior_sd**2) for i, v in enumerate(one.beta)]
        terms = F.array(*[F.struct(F.lit(t).alias("term"), ((F.col(f"g{i}") - pull[i]) / one.rows).alias("gradient")) for i, t in enumerate(one.names)])
        parts.append(sums.select(F.lit(name).alias("model"), F.explode(terms).alias("t")).select("model", "t.term", "t.gradient"))
    return parts[0].unionByName(parts[1])


def _root(fit: LinearFit) -> np.ndarray:
    values, vectors = np.linalg.eigh((fit.covariance + fit.covariance.T) / 2)
    return vectors * np.sqrt(np.clip(values, 0.0, None))


def predict_turnout(fit: LinearFit, df: DataFrame) -> DataFrame:
    """Mean turnout per state, its latent mean, the latent standard deviation and the draw root."""
    q = len(TURNOUT_FEATURES) + 1
    x = _standard(TURNOUT_FEATURES, fit.means, fit.scales)
    uf = F.col("uf").cast("string")
    x += [(uf == n[3:]).cast("double") for n in fit.names[q:]]
    root = _root(fit)
    out = df.withColumn("_x", F.array(*x))
    mean = F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(b)) for b in fit.beta]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in root[:, j]]) for j in range(root.shape[1])])
    loading = F.transform(columns, lambda c: F.aggregate(F.zip_with("_x", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    out = out.withColumn("latent_mean", mean).withColumn("latent_root", loading)
    spread = F.sqrt(F.aggregate("latent_root", F.lit(fit.residual_sd**2), lambda s, v: s + v * v))
    return out.withColumn("latent_sd", spread).withColumn(
        "turnout_mean", clip(sigmoid("latent_mean"), 0.35, 0.95)
    ).drop("_x")


def turnout_draws(predicted: DataFrame, keys: Sequence[str], n: int, seed: int, residual_sd: float) -> DataFrame:
    """Turnout per draw and state; coefficients are shared by all states of a draw."""
    keys = list(keys)
    rows = spread_draws(predicted.select(*keys, F.col("uf").alias("geo"), "latent_mean", "latent_root", "registered_voters"), n)
    z = normals(seed, F.size("latent_root"), *[F.col(k) for k in keys], F.col("draw_id"))
    shared = F.aggregate(F.zip_with("latent_root", z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = normals(seed + 1, F.lit(2), *[F.col(k) for k in keys], F.col("geo"), F.col("draw_id"))[0]
    return rows.select(
        *keys, "draw_id", "geo", clip(sigmoid(F.col("latent_mean") + shared + F.lit(residual_sd) * own), 0.35, 0.95).alias("turnout"),
        "registered_voters",
    )


def fallback_turnout_draws(inputs: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Turnout around its historical value where no trained model exists."""
    keys = list(keys)
    rows = spread_draws(inputs.select(*keys, F.col("uf").alias("geo"), "historical_turnout", "registered_voters"), n)
    z = normals(seed, F.lit(2), *[F.col(k) for k in keys], F.col("geo"), F.col("draw_id"))[0]
    return rows.select(*keys, "draw_id", "geo", clip(F.col("historical_turnout") + 0.025 * z, 0.35, 0.95).alias("turnout"), "registered_voters")


class TransferFit(NamedTuple):
    conditional: LinearFit
    abstention: LinearFit
    iterations: int


def fit_transfer(df: DataFrame, prior_sd: float = 1.0, iterations: int = 80, tolerance: float = 1e-8) -> TransferFit:
    """Two binomial logits (to finalist a; abstain) by Newton steps with a normal prior.

    An iteration is one aggregation of 2 x (7 + 28) sums over the cached table;
    both models share it. The driver solves two 7 x 7 systems.
    """
    require_columns(df, (*TRANSFER_FEATURES, "to_a", "to_b", "abstain"), "transfer training data")
    means, scales = _moments(df, TRANSFER_FEATURES, 1.0)
    q = len(TRANSFER_FEATURES) + 1
    a, b, z = (F.col(c).cast("double") for c in ("to_a", "to_b", "abstain"))
    rows = df.select(
        *[c.alias(f"x{i}") for i, c in enumerate(_standard(TRANSFER_FEATURES, means, scales))],
        a.alias("s0"), F.greatest(a + b, F.lit(1.0)).alias("n0"), z.alias("s1"), F.greatest(a + b + z, F.lit(1.0)).alias("n1"),
    ).persist()
    x = [F.col(f"x{i}") for i in range(q)]
    prior = np.eye(q) / prior_sd**2
    prior[0, 0] = 1 / 25.0

    def sums(betas):
        columns = []
        for m, beta in enumerate(betas):
            p = sigmoid(_dot(beta, x))
            w = F.greatest(F.col(f"n{m}") * p * (1 - p), F.lit(1e-6))
            r = F.col(f"s{m}") - F.col(f"n{m}") * p
            columns += [F.sum(x[i] * r).alias(f"g{m}_{i}") for i in range(q)]
            columns += [F.sum(w * x[i] * x[j]).alias(f"h{m}_{i}_{j}") for i in range(q) for j in range(i, q)]
        row = rows.agg(*columns, F.count("*").alias("n")).first()
        grads = [np.array([row[f"g{m}_{i}"] for i in range(q)]) for m in (0, 1)]
        hess = [np.array([[row[f"h{m}_{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)]) for m in (0, 1)]
        return grads, hess, row["n"]

    betas, done, used = [np.zeros(q), np.zeros(q)], [False, False], 0
    try:
        for used in range(1, iterations + 1):
            grads, hess, n = sums(betas)
            for m in (0, 1):
                if done[m]:
                    continue
                step = np.linalg.solve(hess[m] + prior, grads[m] - prior @ betas[m])
                betas[m] = betas[m] + step
                done[m] = bool(np.max(np.abs(step)) < tolerance)
            if all(done):
                break
        _, hess, n = sums(betas)
    finally:
        rows.unpersist()
    if not all(done):
        raise RuntimeError(f"the transfer model did not converge in {iterations} steps")
    names = ("intercept", *TRANSFER_FEATURES)
    fits = [LinearFit(names, betas[m], np.linalg.pinv(hess[m] + prior), means, scales, 0.0, n) for m in (0, 1)]
    return TransferFit(fits[0], fits[1], used)


def predict_transfer(fit: TransferFit, pairs: DataFrame) -> DataFrame:
    """Transfer and abstention probability of every pair at the mean coefficients."""
    x = _standard(TRANSFER_FEATURES, fit.conditional.means, fit.conditional.scales)
    return pairs.withColumn("p_a", sigmoid(_dot(fit.conditional.beta, x))).withColumn(
        "p_abstain", clip(sigmoid(_dot(fit.abstention.beta, x)), 0.0, 0.65)
    )


def normalize_by_group(df: DataFrame, keys: Sequence[str], p: str, out: str | None = None) -> DataFrame:
    """Probabilities of one race scaled to sum to one (equal if none is positive); a race is slate-sized."""
    w = Window.partitionBy(*keys)
    total = F.sum(p).over(w)
    return df.withColumn(out or p, F.when(total > 0, F.col(p) / total).otherwise(1.0 / F.count("*").over(w)))


def winner_accuracy(df: DataFrame, keys: Sequence[str], p: str, won: str = "won", tie: str = "candidate_id") -> DataFrame:
    """Share of races whose most probable candidate (smaller id on a tie) won."""
    best = df.groupBy(*keys).agg(F.min_by(won, F.struct((-F.col(p)).alias("n"), tie)).alias("_won"))
    return best.agg(F.avg(F.col("_won").cast("double")).alias("accuracy"), F.count("*").alias("races"))


class WinnerFit(NamedTuple):
    """Logistic model of winning: intercept and coefficients of the standardised features that have values.

    ``empty`` names features without a value in the training rows; they are left out.
    """

    features: tuple[str, ...]
    empty: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    beta: tuple[float, ...]
    rows: int
    positive: int

    def logit(self) -> Column:
        x = [F.lit(1.0)] + [
            (F.coalesce(_finite(f), F.lit(m)) - F.lit(c)) / F.lit(s)
            for f, m, c, s in zip(self.features, self.medians, self.means, self.scales)
        ]
        return _dot(self.beta, x)

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit()))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(("intercept", *self.features), self.beta)), "term string, estimate double")


NEWTON = 100
TOLERANCE = 1e-10


def _finite(f: str | Column) -> Column:
    x = num(f)
    return F.when(~F.isnan(x), x)


def _logistic_sums(rows: DataFrame, fits: dict[int, WinnerFit], betas: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Weighted loss, gradient and Hessian of every model over its training rows, in one pass.

    ``rows``: fold, target, then the features by place. A task adds up its own rows; the sums of all tasks combine
    in Spark, so the driver gets a row per model and number.
    """
    held = {m: (f, betas[m]) for m, f in fits.items()}
    names = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y, *values = (np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns)
            place = dict(zip(names, values))
            for m, (fit, beta) in held.items():
                own = fold != m
                x = [np.ones(int(own.sum()))]
                for f, median, mean, scale in zip(fit.features, fit.medians, fit.means, fit.scales):
                    v = place[f][own]
                    x.append((np.where(np.isnan(v), median, v) - mean) / scale)
                x, t = np.stack(x, axis=1), y[own]
                w = np.where(t > 0, fit.rows / (2.0 * fit.positive), fit.rows / (2.0 * (fit.rows - fit.positive)))
                eta = x @ beta
                p = 0.5 * (1.0 + np.tanh(0.5 * eta))
                loss = w @ (np.logaddexp(0.0, eta) - t * eta)
                part = np.concatenate([[loss], x.T @ (w * (p - t)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])
                sums[m] = sums.get(m, 0.0) + part
        for m, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), m)), pa.array(np.arange(len(part))), pa.array(part)], names=["model", "at", "value"])

    added = rows.mapInArrow(run, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value"))
    whole = {m: np.zeros(1 + len(b) + len(b) ** 2) for m, b in betas.items()}
    for r in added.collect():  # models x (terms + 1) squared numbers
        whole[r["model"]][r["at"]] = r["value"]
    out = {}
    for m, v in whole.items():
        q = len(betas[m])
        out[m] = float(v[0]), v[1: q + 1], v[q + 1:].reshape(q, q)
    return out


def fit_winners(df: DataFrame, fold: Column, models: Sequence[int], features: Sequence[str] = WINNER_FEATURES, target: str = "won", c: float = 0.65) -> dict[int, WinnerFit]:
    """Balanced, penalised logistic models, each trained on all rows outside its fold, all in the same jobs.

    Features are imputed by the exact median of the model's rows and standardised; those without any value are left
    out. The penalty is half the squared length of the coefficients (without the intercept) beside ``c`` times the sum of
    the losses. Newton steps go on until they vanish; a model that does not converge is an error.
    """
    require_columns(df, (*features, target), "structural training data")
    rows = cut_lineage(df.select(fold.cast("long").alias("_fold"), F.col(target).cast("double").alias("_y"), *[_finite(f).alias(f) for f in features]))
    fits: dict[int, WinnerFit] = {}
    inside = {m: F.col("_fold") != m for m in models}
    own = F.explode(F.filter(F.array(*[F.lit(int(m)) for m in models]), lambda m: m != F.col("_fold"))).alias("_model")
    cells = rows.select("*", own).select("_model", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("x")) for i, f in enumerate(features)])).alias("c"))
    found = grouped_quantiles(cells.select("_model", "c.f", "c.x"), ["_model", "f"], "x", [0.5]).collect()  # models x features
    median = {(r["_model"], r["f"]): r["q0"] for r in found}
    sums = []
    for m, t in inside.items():
        sums += [F.count_if(t).alias(f"n_{m}"), F.count_if(t & (F.col("_y") > 0)).alias(f"p_{m}")]
        for i, f in enumerate(features):
            if (m, i) in median:
                x = F.when(t, F.coalesce(f, F.lit(median[m, i])))
                sums += [F.avg(x).alias(f"m_{m}_{i}"), F.stddev_pop(x).alias(f"s_{m}_{i}")]
    row = rows.agg(*sums).first()
    for m in models:
        n, positive = row[f"n_{m}"], row[f"p_{m}"]
        if not positive or positive == n:
            raise ValueError("the winner model needs both classes")
        used = [i for i in range(len(features)) if (m, i) in median]
        fits[m] = WinnerFit(
            tuple(features[i] for i in used), tuple(f for i, f in enumerate(features) if i not in used),
            tuple(median[m, i] for i in used), tuple(row[f"m_{m}_{i}"] for i in used), tuple(row[f"s_{m}_{i}"] or 1.0 for i in used),
            (0.0,) * (len(used) + 1), n, positive,
        )
    betas = {m: np.zeros(len(f.beta)) for m, f in fits.items()}
    penalty = {m: np.diag([0.0] + [1.0 / c] * (len(b) - 1)) for m, b in betas.items()}
    trial, scale, known, done = dict(betas), {m: 1.0 for m in betas}, {}, {}
    steps: dict[int, np.ndarray] = {}
    for _ in range(NEWTON):
        sums_now = _logistic_sums(rows, {m: fits[m] for m in trial}, trial)
        following = {}
        for m, (loss, grad, hess) in sums_now.items():
            b = trial[m]
            value = loss + 0.5 * b @ penalty[m] @ b
            if m in known and value > known[m] + 1e-9 * (1 + abs(known[m])):  # the step went too far: halve it
                scale[m] /= 2
                following[m] = betas[m] + scale[m] * steps[m]
                continue
            betas[m], known[m], scale[m] = b, value, 1.0
            steps[m] = -np.linalg.solve(hess + penalty[m], grad + penalty[m] @ b)
            if np.max(np.abs(steps[m])) < TOLERANCE:
                done[m] = True
            else:
                following[m] = b + steps[m]
        trial = following
        if not trial:
            break
    if trial:
        raise RuntimeError(f"the winner model did not converge in {NEWTON} steps")
    return {m: f._replace(beta=tuple(float(x) for x in betas[m])) for m, f in fits.items()}


def fit_winner(df: DataFrame, features: Sequence[str] = WINNER_FEATURES, target: str = "won", c: float = 0.65) -> WinnerFit:
    """One model on all rows; see :func:`fit_winners`."""
    return fit_winners(df, F.lit(0), [-1], features, target, c)[-1]


def winner_gradient(fit: WinnerFit, df: DataFrame, target: str = "won", c: float = 0.65) -> DataFrame:
    """Gradient of the penalised loss per term, relative to the number of rows; zero at the solution."""
    y = F.col(target).cast("double")
    w = F.when(y > 0, fit.rows / (2.0 * fit.positive)).otherwise(fit.rows / (2.0 * (fit.rows - fit.positive)))
    r = w * (fit.probability() - y)
    x = [F.lit(1.0)] + [(F.coalesce(_finite(f), F.lit(m)) - m0) / s for f, m, m0, s in zip(fit.features, fit.medians, fit.means, fit.scales)]
    parts = [
        F.struct(F.lit(name).alias("term"), ((F.sum(r * col) + (b / c if i else 0.0)) / fit.rows).alias("gradient"))
        for i, (name, col, b) in enumerate(zip(("intercept", *fit.features), x, fit.beta))
    ]
    return df.agg(F.array(*parts).alias("g")).select(F.explode("g").alias("g")).select("g.term", "g.gradient")


def score_winner(model: WinnerFit, df: DataFrame, keys: Sequence[str], out: str = "ml_probability") -> DataFrame:
    """Win probability of every candidate, normalised within its race."""
    return normalize_by_group(df.withColumn(out, model.probability()), keys, out)


def out_of_fold(df: DataFrame, key: str, k: int = 5, features: Sequence[str] = WINNER_FEATURES) -> DataFrame:
    """``df`` with its fold and the probability of the model that did not see the fold, normalised within its race."""
    folded = cut_lineage(group_kfold(df, key, k))
    fits = fit_winners(folded, F.col("fold"), list(range(k)), features)
    p = F.lit(None).cast("double")
    for m, fit in fits.items():
        p = F.when(F.col("fold") == m, fit.probability()).otherwise(p)
    return normalize_by_group(folded.withColumn("probability", p), [key], "probability")


def evaluate_oof(df: DataFrame, key: str, k: int = 5, features: Sequence[str] = WINNER_FEATURES) -> DataFrame:
    """Out-of-fold scores of the winner model beside the normalised poll baseline; races stay whole."""
    parts = out_of_fold(df, key, k, features).select(key, "candidate_id", "won", "poll_mean", "probability")
    scored = cut_lineage(normalize_by_group(parts, [key], "poll_mean", "poll_baseline"))
    y = F.col("won").cast("double")
    scores = scored.agg(
        sc.brier(y, "probability").alias("model_brier"), sc.brier(y, "poll_baseline").alias("baseline_brier"),
        sc.log_loss(y, "probability", 1e-6).alias("model_log_loss"), F.count("*").alias("observations"),
    )
    accuracy = winner_accuracy(scored, [key], "probability")
    return scores.withColumn("accuracy", accuracy.select("accuracy").scalar()).withColumn("races", accuracy.select("races").scalar())
