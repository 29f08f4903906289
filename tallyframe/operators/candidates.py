"""Candidate fundamentals: signal guard, runoff pair features, scenarios, identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip, let, num, sigmoid
from tallyframe.functions.text import normalize_name

# Canonical candidates and the names they are published under.
ALIASES = {
    "lula": ("lula", "luiz inacio lula da silva"),
    "bolsonaro": ("jair bolsonaro", "jair messias bolsonaro", "bolsonaro"),
    "dilma": ("dilma rousseff", "dilma vana rousseff"),
    "aecio": ("aecio neves", "aecio neves da cunha"),
    "haddad": ("fernando haddad", "haddad"),
    "ciro": ("ciro gomes", "ciro ferreira gomes", "ciro"),
    "marina": ("marina silva", "maria osmarina marina silva vaz de lima", "marina"),
    "alckmin": ("geraldo alckmin", "geraldo jose rodrigues alckmin filho", "alckmin"),
    "tebet": ("simone tebet", "simone nassar tebet", "tebet"),
    "amoedo": ("joao amoedo", "joao dionisio filgueira barreto amoedo", "amoedo"),
}


def canonical_candidate(name, aliases: dict[str, Sequence[str]] | None = None) -> Column:
    """Canonical id of a published name.

    An exact alias wins; else the longest alias all of whose tokens occur in the
    name (greatest canonical id on a tie); else the name itself as an id. The
    fixed alias list is a literal, so this is a projection without a join.
    """
    table = [
        (alias, canonical) for canonical, names in (aliases or ALIASES).items() for alias in names
    ]
    exact = F.create_map(*[F.lit(x) for pair in dict(table).items() for x in pair])
    entries = F.array(*[
        F.struct(
            F.lit(len(a.split())).alias("n"),
            F.lit(c).alias("canonical"),
            F.array(*[F.lit(t) for t in a.split()]).alias("tokens"),
        )
        for a, c in table
    ])

    def longest(tokens: Column) -> Column:
        hits = F.filter(entries, lambda e: F.size(F.array_except(e["tokens"], tokens)) == 0)
        return F.array_max(F.transform(hits, lambda e: F.struct(e["n"], e["canonical"])))["canonical"]

    return let(
        normalize_name(name),
        lambda norm: F.coalesce(
            F.try_element_at(exact, norm), let(F.split(norm, " "), longest), F.translate(norm, " ", "_")
        ),
    )


def guard_signals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shrink digital signals by their reliability and anomaly; the key is one slate."""

    def column(name: str, default: float, missing: float) -> Column:
        return num(name, missing) if name in df.columns else F.lit(default)

    neutral = 100.0 / F.count("*").over(Window.partitionBy(*keys))
    out = df
    for signal in ("search", "sentiment"):
        reliability = clip(column(f"{signal}_reliability", 0.5, 0.0), 0.0, 1.0)
        anomaly = clip(column(f"{signal}_anomaly_score", 0.0, 3.0), 0.0)
        out = out.withColumn(f"{signal}_weight", reliability * F.exp(-anomaly)).withColumn(
            f"_{signal}_flag", anomaly > 1.5
        )
    return (
        out.withColumn("_n", neutral)
        .withColumn(
            "search_share_guarded",
            F.col("_n") + F.col("search_weight") * (F.coalesce(num("search_share"), F.col("_n")) - F.col("_n")),
        )
        .withColumn("media_sentiment_guarded", F.col("sentiment_weight") * num("media_sentiment", 0.0, -1.0, 1.0))
        .withColumn("digital_signal_reliability", (F.col("search_weight") + F.col("sentiment_weight")) / 2)
        .withColumn("signal_flagged", F.col("_search_flag") | F.col("_sentiment_flag"))
        .drop("_n", "_search_flag", "_sentiment_flag")
    )


def guard_summary(guarded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean weights, flagged candidates and low-weight warnings of every slate."""
    flagged = F.collect_list(F.when(F.col("signal_flagged"), F.col("candidate_id")))
    g = guarded.groupBy(*keys).agg(
        F.avg("search_weight").alias("mean_search_weight"),
        F.avg("sentiment_weight").alias("mean_sentiment_weight"),
        F.array_sort(flagged).alias("flagged_candidates"),
    )
    return g.withColumn("weak_search_signal", F.col("mean_search_weight") < 0.35).withColumn(
        "weak_sentiment_signal", F.col("mean_sentiment_weight") < 0.35
    )


def pair_features(fund: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features of (eliminated, finalist a, finalist b) for all triples of one slate.

    The output holds one row per ordered triple by definition; a slate is the
    ballot of one race, so its size does not grow with the data.
    """
    entry = F.struct(
        "candidate_id",
        F.coalesce(num("ideology_score"), F.lit(0.0)).alias("ideology"),
        F.coalesce(num("rejection"), F.lit(50.0)).alias("rejection"),
        F.coalesce(F.col("bloc"), F.lit("")).alias("bloc"),
        F.coalesce(num("incumbency"), F.lit(0.0)).alias("incumbency"),
    )
    slate = fund.groupBy(*keys).agg(F.collect_list(entry).alias("slate"))
    triples = (
        slate.select(*keys, "slate", F.explode("slate").alias("s"))
        .select(*keys, "slate", "s", F.explode("slate").alias("a"))
        .where(F.col("s.candidate_id") != F.col("a.candidate_id"))
        .select(*keys, "s", "a", F.explode("slate").alias("b"))
        .where(
            (F.col("b.candidate_id") != F.col("a.candidate_id"))
            & (F.col("b.candidate_id") != F.col("s.candidate_id"))
        )
    )
    da = F.abs(F.col("s.ideology") - F.col("a.ideology"))
    db = F.abs(F.col("s.ideology") - F.col("b.ideology"))
    same = [(F.col("s.bloc") == F.col(f"{x}.bloc")).cast("double") for x in "ab"]
    return triples.select(
        *keys,
        F.col("s.candidate_id").alias("source_id"),
        F.col("a.candidate_id").alias("a_id"),
        F.col("b.candidate_id").alias("b_id"),
        (db - da).alias("distance_advantage_a"),
        (F.col("b.rejection") - F.col("a.rejection")).alias("rejection_advantage_a"),
        (same[0] - same[1]).alias("same_bloc_advantage_a"),
        (F.col("a.incumbency") - F.col("b.incumbency")).alias("incumbency_advantage_a"),
        F.col("s.rejection").alias("source_rejection"),
        (da + db).alias("finalist_distance_sum"),
        F.least(da, db).alias("nearest_distance"),
    )


def fallback_transfer(pairs: DataFrame) -> DataFrame:
    """Mean transfer and abstention probability where no trained model exists."""
    score = 1.8 * F.col("distance_advantage_a") + 0.025 * F.col("rejection_advantage_a")
    abstain = 0.06 + 0.0015 * F.col("source_rejection") + 0.04 * F.col("nearest_distance")
    return pairs.withColumn("p_a", sigmoid(score)).withColumn("p_abstain", clip(abstain, 0.03, 0.35))


# The five standard scenarios (name, turnout multiplier, poll shift in points).
STANDARD_SCENARIOS = (
    ("baseline", 1.0, 0.0),
    ("lower_turnout", 0.97, 0.0),
    ("higher_turnout", 1.03, 0.0),
    ("poll_error_minus_2", 1.0, -2.0),
    ("poll_error_plus_2", 1.0, 2.0),
)


def apply_scenarios(df: DataFrame, candidate_id: str, scenarios=STANDARD_SCENARIOS) -> DataFrame:
    """Every row under every scenario: the candidate's share shifted, turnout scaled."""
    if any(t <= 0 for _, t, _ in scenarios):
        raise ValueError("turnout multiplier must be positive")
    table = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(t)).alias("turnout"), F.lit(float(s)).alias("shift"))
        for n, t, s in scenarios
    ])
    out = df.withColumn("_s", F.explode(table)).withColumn("scenario", F.col("_s.name"))
    if "share" in df.columns:
        shifted = clip(F.col("share") + F.col("_s.shift"), 0.0, 100.0)
        out = out.withColumn(
            "share",
            F.when((F.col("candidate_id") == candidate_id) & (F.col("_s.shift") != 0), shifted).otherwise(
                F.col("share")
            ),
        )
    if "expected_turnout" in df.columns:
        out = out.withColumn("expected_turnout", clip(F.col("expected_turnout") * F.col("_s.turnout"), 0.0, 1.0))
    return out.drop("_s")


def build_feature_frame(summary: DataFrame, guarded: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Poll summary with its fundamentals, and the candidates that break the one-to-one rule.

    The second frame must be empty: it lists candidates with missing values or
    with more than one row on either side.
    """
    on = [*keys, "candidate_id", "candidate_name"]
    merged = summary.join(guarded, on, "left")
    anything_null = F.lit(False)
    for c in merged.columns:
        anything_null = anything_null | F.col(c).isNull()
    missing = merged.where(anything_null).select(*keys, "candidate_id", F.lit("incomplete").alias("problem"))
    repeated = [
        side.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > 1)
        .select(*keys, "candidate_id", F.lit("repeated").alias("problem"))
        for side in (summary, guarded)
    ]
    problems = missing.unionByName(repeated[0]).unionByName(repeated[1]).distinct()
    return merged, problems


# Turnout features and what a missing one means.
TURNOUT_DEFAULTS = {
    "historical_turnout": 0.79,
    "abstention_trend": 0.0,
    "registration_growth": 0.0,
    "mobility_index": 0.0,
    "weather_severity": 0.0,
    "competitiveness": 0.5,
}


def turnout_inputs(states: DataFrame, priors: DataFrame | None, turnout: DataFrame | None) -> DataFrame:
    """Turnout features and electorate of every state, with defaults where nothing is known.

    The first row per state is the least one by content (``drop_duplicates`` has
    no defined order in a distributed table).
    """
    out = states.select(F.col("uf").cast("string").alias("uf"))
    features = list(TURNOUT_DEFAULTS)
    if turnout is not None:
        present = [c for c in features if c in turnout.columns]
        first = turnout.groupBy(F.col("uf").cast("string").alias("uf")).agg(
            F.min(F.struct(*present)).alias("t")
        ).select("uf", *[F.col(f"t.{c}").alias(c) for c in present])
        out = out.join(first, "uf", "left")
    for name, default in TURNOUT_DEFAULTS.items():
        out = out.withColumn(name, num(name, default) if name in out.columns else F.lit(default))
    if priors is not None:
        electorate = priors.groupBy("uf").agg(F.max("registered_voters").cast("double").alias("registered_voters"))
        out = out.join(electorate, "uf", "left")
    else:
        out = out.withColumn("registered_voters", F.lit(None).cast("double"))
    return out.withColumn("registered_voters", F.coalesce("registered_voters", F.lit(1_000_000.0)))
