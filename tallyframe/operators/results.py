"""Election results, turnout and state weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip
from tallyframe.operators.candidates import canonical_candidate

# The 27 states and their macro-regions.
MACROREGIONS = {
    "N": ("AC", "AM", "AP", "PA", "RO", "RR", "TO"),
    "NE": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "CO": ("DF", "GO", "MS", "MT"),
    "SE": ("ES", "MG", "RJ", "SP"),
    "S": ("PR", "RS", "SC"),
}
STATES = tuple(sorted(uf for ufs in MACROREGIONS.values() for uf in ufs))
# Names of ballots that are no valid vote.
NO_VOTE = ("BRANCO", "NULO", "#NULO#", "NULO TÉCNICO")
# Alternative official column names, in order of preference.
OFFICE = ("DS_CARGO", "DS_CARGO_PERGUNTA")
STATE = ("SG_UF", "UF")
ROUND = ("NR_TURNO", "NUM_TURNO")
CANDIDATE = ("NM_VOTAVEL", "NM_CANDIDATO", "DS_CARGO_PERGUNTA")
PARTY = ("SG_PARTIDO", "NR_PARTIDO", "NM_PARTIDO")
VOTES = ("QT_VOTOS", "QT_VOTOS_NOMINAIS", "QT_VOTOS_NOMINAIS_VALIDOS")
ELIGIBLE = ("QT_APTOS", "QT_ELEITORES", "QT_ELEITOR_APTO")
PRESENT = ("QT_COMPARECIMENTO", "QT_COMPARECIMENTO_TOT", "QT_ELEITORES_COMPARECIMENTO")


def first_existing(df: DataFrame, names: Sequence[str], required: bool = True) -> str | None:
    found = next((n for n in names if n in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the expected columns {list(names)} exists")
    return found


def _number(name: str, kind: str) -> Column:
    return F.col(name).cast("string").try_cast("double").cast(kind)


def filter_office(df: DataFrame, office: str = "PRESIDENT", year: int | None = None) -> DataFrame:
    """Rows of one office (by name part) and year."""
    column = first_existing(df, OFFICE, required=False)
    out = df if column is None else df.where(F.upper(column).contains(office))
    if year is not None and "ANO_ELEICAO" in df.columns:
        out = out.where(_number("ANO_ELEICAO", "int") == year)
    return out


def valid_votes(df: DataFrame, column: str = "candidate_name") -> DataFrame:
    """Rows that are no blank or null ballot."""
    return df.where(~F.upper(column).isin(*NO_VOTE))


def is_state(uf) -> Column:
    return F.trim(F.upper(uf)).isin(*STATES)


def valid_states(df: DataFrame, column: str = "uf") -> DataFrame:
    """Rows of one of the 27 states; national and foreign rows drop out."""
    return df.where(is_state(column))


def with_vote_share(df: DataFrame, keys: Sequence[str] = ("year", "round", "uf")) -> DataFrame:
    """Share of the votes of a contest. The window holds one row per candidate, not raw counts."""
    total = F.sum("votes").over(Window.partitionBy(*keys))
    return df.withColumn("vote_share", F.try_divide(F.col("votes"), F.when(total > 0, total)))


def normalize_results(df: DataFrame, year: int | None = None) -> DataFrame:
    """Official counts to votes and share per (year, round, uf, candidate, party)."""
    party = first_existing(df, PARTY, required=False)
    rows = filter_office(df, year=year).select(
        (F.lit(year).cast("int") if year is not None else _number("ANO_ELEICAO", "int")).alias("year"),
        _number(first_existing(df, ROUND), "int").alias("round"),
        F.trim(F.upper(first_existing(df, STATE))).alias("uf"),
        F.trim(first_existing(df, CANDIDATE)).alias("candidate_name"),
        (F.trim(F.upper(party)) if party else F.lit("UNKNOWN")).alias("party"),
        F.coalesce(_number(first_existing(df, VOTES), "bigint"), F.lit(0)).alias("votes"),
    )
    summed = valid_votes(rows).groupBy("year", "round", "uf", "candidate_name", "party").agg(
        F.sum("votes").alias("votes")
    )
    return with_vote_share(summed)


def merge_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of several files: equal rows once, then summed again."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    keys = ["year", "round", "uf", "candidate_name", "party"]
    return with_vote_share(rows.select(*keys, "votes").distinct().groupBy(*keys).agg(F.sum("votes").alias("votes")))


def ordered_results(df: DataFrame) -> DataFrame:
    return df.orderBy("year", "round", "uf", F.desc("votes"), "candidate_name", "party")


def normalize_turnout(df: DataFrame, year: int | None = None) -> DataFrame:
    """Eligible and present voters per (year, round, uf) with their rate."""
    turn = first_existing(df, ROUND, required=False)
    rows = df.select(
        (F.lit(year).cast("int") if year is not None else _number("ANO_ELEICAO", "int")).alias("year"),
        (_number(turn, "int") if turn else F.lit(1)).alias("round"),
        F.trim(F.upper(first_existing(df, STATE))).alias("uf"),
        F.coalesce(_number(first_existing(df, ELIGIBLE), "double"), F.lit(0.0)).alias("eligible"),
        F.coalesce(_number(first_existing(df, PRESENT), "double"), F.lit(0.0)).alias("present"),
    ).where(F.col("year").isNotNull() & F.col("round").isNotNull())
    out = rows.groupBy("year", "round", "uf").agg(F.sum("eligible").alias("eligible"), F.sum("present").alias("present"))
    return out.withColumn("turnout_rate", F.try_divide("present", F.when(F.col("eligible") > 0, F.col("eligible"))))


def checked(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; the job fails with ``message`` elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def state_weights(
    df: DataFrame, keys: Sequence[str], electorate: str = "eligible_voters", turnout: str = "expected_turnout"
) -> DataFrame:
    """Expected votes and national weight of every state. A key holds at most one row per state."""
    size = checked(F.col(electorate) >= 0, F.col(electorate).cast("double"), "electorate cannot be negative")
    rate = checked(F.col(turnout).between(0, 1), F.col(turnout), "expected turnout must be between 0 and 1")
    out = df.withColumn("expected_votes", size * rate)
    total = F.sum("expected_votes").over(Window.partitionBy(*keys))
    return out.withColumn(
        "national_weight",
        F.col("expected_votes") / checked(total > 0, total, "expected national votes must be positive"),
    )


def weighted_share(shares: DataFrame, weights: DataFrame, keys: Sequence[str], by: Sequence[str], share: str = "share") -> DataFrame:
    """Weighted share per ``by`` over the states present on both sides."""
    joined = shares.join(weights.select(*keys, "uf", "national_weight"), [*keys, "uf"])
    return joined.groupBy(*by).agg(
        (F.sum(F.col(share) * F.col("national_weight")) / F.sum("national_weight")).alias(share)
    )


def macroregion(uf) -> Column:
    """Macro-region of a state; an unknown state fails the job."""
    uf = F.col(uf) if isinstance(uf, str) else uf
    out = None
    for region, ufs in MACROREGIONS.items():
        out = F.when(uf.isin(*ufs), region) if out is None else out.when(uf.isin(*ufs), region)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(uf, F.lit("null")))).cast("string"))


def add_macroregion(df: DataFrame, column: str = "uf") -> DataFrame:
    return df.withColumn("macroregion", macroregion(column))


def shrink_to_region(
    df: DataFrame, value: str, weight: str, strength: float = 5.0, region: str = "macroregion", keys: Sequence[str] = ()
) -> DataFrame:
    """State value pulled to the weighted mean of its region (one row per state in a window)."""
    if strength < 0:
        raise ValueError("strength must be non-negative")
    w = Window.partitionBy(*keys, region)
    weight_c = clip(F.col(weight).cast("double"), 0.0)
    mean = F.sum(F.col(value) * weight_c).over(w) / F.greatest(F.sum(weight_c).over(w), F.lit(1e-12))
    return df.withColumn("region_mean", mean).withColumn(
        "shrunk", F.try_divide(weight_c * F.col(value) + strength * F.col("region_mean"), weight_c + strength)
    )


def national_map(df: DataFrame, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """National composition by ``key``: from votes if there are any, else from mean shares."""
    votes = F.coalesce(F.col("votes").cast("double"), F.lit(0.0)) if "votes" in df.columns else F.lit(0.0)
    share = F.col("vote_share") if "vote_share" in df.columns else F.lit(None).cast("double")
    g = df.where(F.col(key).isNotNull()).groupBy(*groups, key).agg(F.sum(votes).alias("_v"), F.avg(share).alias("_s"))
    w = Window.partitionBy(*groups)
    value = F.greatest(
        F.when(F.sum("_v").over(w) > 0, F.col("_v")).otherwise(F.coalesce("_s", F.lit(0.0))), F.lit(0.0)
    )
    g = g.withColumn("_x", value).withColumn("_t", F.sum("_x").over(w))
    return g.where(F.col("_t") > 0).select(*groups, key, (F.col("_x") / F.col("_t")).alias("national_share"))


def actual_shares(
    results: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str] = ("year",),
    round_number: int = 1,
    absent: str = "null",
    states_only: bool = False,
    canonical: str | None = None,
) -> DataFrame:
    """Actual share of the wanted candidates per state and for the country, in one pass.

    ``absent='zero'`` adds the wanted candidates without votes as zero rows.
    """
    if absent not in ("null", "zero"):
        raise ValueError("absent must be 'null' or 'zero'")
    name = F.col(canonical) if canonical else canonical_candidate("candidate_name")
    wanted = candidates.select(*keys, name.alias("canonical")).distinct()
    rows = results.where(F.col("round") == round_number).select(
        *keys, F.trim(F.upper("uf")).alias("uf"), name.alias("canonical"), "votes"
    )
    if states_only:
        rows = valid_states(rows)
    rows = rows.join(wanted, [*keys, "canonical"], "left_semi")
    k = [F.col(c) for c in keys]
    summed = rows.groupingSets(
        [[*k, F.col("canonical"), F.col("uf")], [*k, F.col("canonical")]], *k, F.col("canonical"), F.col("uf")
    ).agg(F.sum("votes").alias("votes"), F.grouping("uf").alias("_all"))
    summed = summed.withColumn("uf", F.when(F.col("_all") == 1, "BR").otherwise(F.col("uf"))).drop("_all")
    if absent == "zero":
        geos = summed.select(*keys, "uf").distinct()
        slots = geos.join(wanted, list(keys))
        summed = slots.join(summed, [*keys, "uf", "canonical"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    total = F.sum("votes").over(Window.partitionBy(*keys, "uf"))
    return summed.withColumn("actual_share", F.try_divide(F.col("votes"), F.when(total > 0, total)))


def aggregate_metrics(records: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric and the number of records per key, best first."""
    return records.groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count("*").alias("observations")
    )


def error_by_horizon(metrics: DataFrame, value: str = "vote_share_mae") -> DataFrame:
    return metrics.groupBy("model", "days_before_election").agg(F.avg(value).alias(value))


def previous_year(df: DataFrame) -> DataFrame:
    """Every year with data and the year with data before it. The list of years is short by nature."""
    years = df.select("year").distinct()
    known = years.agg(F.collect_set("year")).scalar()
    return years.withColumn("_known", known).select(
        "year", F.array_max(F.filter("_known", lambda y: y < F.col("year"))).alias("previous_year")
    )


def coverage_difference(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Values that are expected but missing, and observed but not expected."""
    columns = expected.columns
    missing = expected.exceptAll(observed.select(*columns)).withColumn("problem", F.lit("missing"))
    extra = observed.select(*columns).exceptAll(expected).withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)
