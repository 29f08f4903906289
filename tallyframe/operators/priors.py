"""State priors from the previous election."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.candidates import canonical_candidate
from tallyframe.operators.results import national_map, valid_states


def _party(c: Column) -> Column:
    return F.trim(F.upper(F.coalesce(c, F.lit("UNKNOWN"))))


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def build_state_priors(
    previous: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str],
    strength: float | Column = 2.5,
    fallback: float | Column = 0.75,
    states_only: bool = True,
) -> DataFrame:
    """Share and national share of every current candidate in every state, from the last results.

    The first level that knows the candidate decides: same candidate in the state,
    same party in the state, candidate nationally, party nationally, neutral. The
    four lookups are small aggregates; every key (election, horizon, variant) is
    handled in the same joins.
    """
    keys = list(keys)
    prev = previous.withColumn("uf", F.trim(F.upper("uf")))
    if states_only:
        prev = valid_states(prev)
    prev = (
        prev.withColumn("canonical", canonical_candidate("candidate_name"))
        .withColumn("party", _party(F.col("party")))
        .withColumn("vote_share", F.coalesce(F.col("vote_share").cast("double"), F.lit(0.0)))
    )
    party = F.col("party") if "party" in candidates.columns else F.lit(None).cast("string")
    current = candidates.withColumn("canonical", canonical_candidate("candidate_name")).withColumn("party", _party(party))
    count = current.groupBy(*keys).agg(F.count("*").alias("_k"))
    current = current.join(count, keys)

    def in_state(by: str, out: str) -> DataFrame:
        return prev.groupBy(*keys, "uf", by).agg(F.sum("vote_share").alias(out))

    def in_country(by: str, out: str) -> DataFrame:
        return national_map(prev, by, keys).withColumnRenamed("national_share", out)

    known_party = F.when(F.col("party") != "UNKNOWN", F.col("party"))
    grid = (
        prev.select(*keys, "uf").distinct()
        .join(current.withColumn("_p", known_party), keys)
        .join(in_state("canonical", "s_c"), [*keys, "uf", "canonical"], "left")
        .join(in_state("party", "s_p").withColumnRenamed("party", "_p"), [*keys, "uf", "_p"], "left")
        .join(in_country("canonical", "n_c"), [*keys, "canonical"], "left")
        .join(in_country("party", "n_p").withColumnRenamed("party", "_p"), [*keys, "_p"], "left")
    )
    neutral = 1.0 / F.greatest(F.col("_k"), F.lit(1))
    full, weak = _as_column(strength), _as_column(fallback)

    def pick(same_candidate, same_party, candidate_national, party_national, otherwise) -> Column:
        return (
            F.when(F.col("s_c").isNotNull(), same_candidate)
            .when(F.col("s_p").isNotNull(), same_party)
            .when(F.col("n_c").isNotNull(), candidate_national)
            .when(F.col("n_p").isNotNull(), party_national)
            .otherwise(otherwise)
        )

    def total(c: str) -> Column:
        t = F.sum(c).over(Window.partitionBy(*keys, "uf"))
        return F.when(t > 0, t).otherwise(F.lit(1.0))

    return (
        grid.withColumn("_s", pick(F.col("s_c"), F.col("s_p"), F.col("n_c"), F.col("n_p"), neutral))
        .withColumn("_n", pick(F.coalesce("n_c", neutral), F.coalesce("n_p", neutral), F.col("n_c"), F.col("n_p"), neutral))
        .withColumn("prior_strength", pick(full, full * 0.8, weak, weak, weak * 0.5))
        .withColumn("prior_source", pick(*[F.lit(x) for x in (
            "same_candidate", "same_party", "candidate_national", "party_national", "neutral")]))
        .withColumn("prior_share", F.col("_s") / total("_s") * 100.0)
        .withColumn("national_prior_share", F.col("_n") / total("_n") * 100.0)
        .withColumn("prior_concentration", F.greatest(F.lit(6.0), F.col("prior_strength") * 20.0))
        .select(*keys, "uf", "candidate_id", "candidate_name", "prior_share", "national_prior_share",
                "prior_strength", "prior_concentration", "prior_source")
    )


def neutral_priors(
    states: DataFrame, candidates: DataFrame, keys: Sequence[str], strength: float = 2.5, source: str = "neutral", national: bool = True
) -> DataFrame:
    """Equal shares for all candidates of a key in all its states (both sides are short lists)."""
    keys = list(keys)
    k = candidates.groupBy(*keys).agg(F.count("*").alias("_k"))
    share = 100.0 / F.greatest(F.col("_k"), F.lit(1))
    grid = states.where(~F.col("uf").isin("BR", "ZZ") & F.col("uf").isNotNull()).select(*keys, "uf").distinct()
    return grid.join(candidates.join(k, keys), keys).select(
        *keys, "uf", F.col("candidate_id").cast("string").alias("candidate_id"), "candidate_name",
        share.alias("prior_share"),
        (share if national else F.lit(None).cast("double")).alias("national_prior_share"),
        F.lit(float(strength)).alias("prior_strength"),
        F.lit(max(6.0, strength * 20.0)).alias("prior_concentration"),
        F.lit(source).alias("prior_source"),
    )
