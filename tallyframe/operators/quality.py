"""Temporal filters, validation rules, deduplication, outliers, fingerprints and hash chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import as_date
from tallyframe.operators.quantiles import grouped_quantiles
from tallyframe.operators.skew import spread_join

# Columns every dataset must have.
REQUIRED_COLUMNS = {
    "polls": ("candidate_id", "fieldwork_end", "institute", "poll_id", "sample_size", "share"),
    "turnout": ("eligible_voters", "uf", "votes_cast", "year"),
    "fundamentals": ("reference_date", "release_date"),
}

# Allowed ranges of the input contracts (column, low, low is open, high).
RANGES = {
    "polls": (
        ("share", 0.0, False, 100.0), ("undecided_share", 0.0, False, 100.0),
        ("sample_size", 0.0, True, None), ("margin_error", 0.0, True, 20.0),
    ),
    "fundamentals": (
        ("rejection", 0.0, False, 100.0), ("incumbency", 0.0, False, 1.0),
        ("government_approval", 0.0, False, 100.0), ("unemployment", 0.0, False, 100.0),
        ("search_share", 0.0, False, 100.0), ("media_sentiment", -1.0, False, 1.0),
        ("search_reliability", 0.0, False, 1.0), ("sentiment_reliability", 0.0, False, 1.0),
        ("search_anomaly_score", 0.0, False, None), ("sentiment_anomaly_score", 0.0, False, None),
        ("ideology_score", -1.0, False, 1.0), ("late_decider_score", -2.0, False, 2.0),
    ),
    "state_priors": (
        ("registered_voters", 0.0, True, None), ("prior_share", 0.0, False, 100.0),
        ("prior_strength", 0.0, True, 50.0),
    ),
    "turnout": (
        ("registered_voters", 0.0, True, None), ("historical_turnout", 0.3, False, 0.99),
        ("abstention_trend", -0.2, False, 0.2), ("registration_growth", -0.2, False, 0.2),
        ("mobility_index", -3.0, False, 3.0), ("weather_severity", 0.0, False, 3.0),
        ("competitiveness", 0.0, False, 1.0),
    ),
}


def available_as_of(df: DataFrame, cutoff, column: str = "release_date") -> DataFrame:
    """Rows released on or before the cutoff; undated rows are not available."""
    if column not in df.columns:
        raise ValueError(f"missing release column: {column}")
    return df.where(F.col(column) <= F.lit(cutoff).cast("date"))


def leakage_rows(df: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows that are undated or later than the cutoff; must be empty."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(cutoff).cast("date")))


def assert_not_after(df: DataFrame, column: str, cutoff, order: Sequence[str]) -> None:
    first = leakage_rows(df, column, cutoff).select(*order).orderBy(*order).limit(10)  # for the error text only
    bad = [r.asDict() for r in first.collect()]
    if bad:
        raise ValueError(f"temporal leakage in {column}: {bad}")


def missing_columns(df: DataFrame, name: str) -> list[str]:
    if name not in REQUIRED_COLUMNS:
        raise ValueError(f"unknown dataset: {name}")
    return [f"{name}: missing column {c}" for c in REQUIRED_COLUMNS[name] if c not in df.columns]


def check_columns(df: DataFrame, name: str) -> DataFrame:
    """One row per missing column with the number of rows it concerns."""
    missing = missing_columns(df, name)
    texts = F.array(*[F.lit(m) for m in missing]) if missing else F.array().cast("array<string>")
    return df.agg(F.count("*").alias("rows")).select(F.explode(texts).alias("error"), "rows")


def check_probability(df: DataFrame, column: str) -> DataFrame:
    """Counts of unreadable and out-of-range probabilities, in one pass."""
    p = F.col(column).cast("string").try_cast("double")
    bad = p.isNull() | F.isnan(p)
    return df.agg(
        F.count_if(bad).alias("not_numeric"),
        F.count_if(~bad & ((p < 0) | (p > 1))).alias("out_of_range"),
    ).withColumn("valid", (F.col("not_numeric") == 0) & (F.col("out_of_range") == 0))


def check_polls(df: DataFrame) -> DataFrame:
    """One row per poll rule with its number of violations."""
    n = F.col("sample_size").cast("string").try_cast("double")
    share = F.col("share").cast("string").try_cast("double")
    # One shuffle: copies collapse on the map side while the row rules are counted.
    per_key = df.groupBy("poll_id", "candidate_id").agg(
        F.count("*").alias("copies"),
        F.count_if(n.isNull() | (n <= 0)).alias("bad_n"),
        F.count_if(share.isNull() | (share < 0) | (share > 100)).alias("bad_share"),
    )
    totals = per_key.agg(
        F.coalesce(F.sum("bad_n"), F.lit(0)).alias("sample_size must contain positive numbers"),
        F.coalesce(F.sum("bad_share"), F.lit(0)).alias("share must be numeric and between 0 and 100"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias(
            "duplicate poll_id/candidate_id observations detected"
        ),
    )
    return totals.unpivot([], totals.columns, "rule", "violations")


def evaluate_dataset(name: str, df: DataFrame) -> DataFrame:
    """One row: whether the dataset may be used, and the errors that forbid it."""
    missing = missing_columns(df, name)
    errors = [F.array(*[F.lit(m) for m in missing]) if missing else F.array().cast("array<string>")]
    if name == "polls" and not missing:
        rules = check_polls(df).agg(
            F.array_sort(F.collect_list(F.when(F.col("violations") > 0, F.col("rule")))).alias("r")
        )
        errors.append(rules.scalar())
    empty = F.when(F.col("rows") == 0, F.array(F.lit(f"{name}: dataset is empty"))).otherwise(
        F.array().cast("array<string>")
    )
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("dataset"), F.concat(*errors, empty).alias("errors")
    ).withColumn("allowed", F.size("errors") == 0)


def check_refs(polls: DataFrame, fundamentals: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Polled candidates that have no fundamentals or no prior."""
    ids = polls.select("candidate_id").distinct()
    out = ids.join(fundamentals.select("candidate_id"), "candidate_id", "left_anti").withColumn(
        "missing_in", F.lit("fundamentals")
    )
    if priors is not None:
        out = out.unionByName(
            ids.join(priors.select("candidate_id"), "candidate_id", "left_anti").withColumn(
                "missing_in", F.lit("state_priors")
            )
        )
    return out


def check_ranges(df: DataFrame, rules) -> DataFrame:
    """Violations per range rule, all rules in one scan. Null counts as allowed (optional field)."""
    rules = RANGES[rules] if isinstance(rules, str) else rules
    counts = []
    for column, low, open_low, high in rules:
        x = F.col(column).cast("double")
        bad = (x <= low) if open_low else (x < low)
        if high is not None:
            bad = bad | (x > high)
        counts.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(column))
    return df.agg(*counts).unpivot([], [r[0] for r in rules], "field", "violations")


# Columns that make two poll rows say the same thing.
SEMANTIC = (
    "institute", "fieldwork_start", "fieldwork_end", "field_date", "sample_size", "uf",
    "mode", "collection_mode", "target_population", "candidate_id", "share",
)


def deduplicate_polls(df: DataFrame, row_id: str, semantic: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows: the first row (least ``row_id``) of every key and meaning stays.

    ``row_id`` is a unique order column. A row equal in all columns is also equal
    in its key, so two key sets decide. Each is a minimum per key, so copies
    collapse before the shuffle, and rows are then matched on the unique id,
    never on the possibly hot key.
    """
    columns = [c for c in (semantic or SEMANTIC) if c in df.columns]
    keep = None
    for keys in (["poll_id", "candidate_id"], columns):
        first = df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).select(row_id)
        keep = first if keep is None else keep.join(first, row_id, "left_semi")
    return df.join(keep, row_id, "left_semi"), df.join(keep, row_id, "left_anti")


def flag_outliers(
    df: DataFrame,
    value: str = "share",
    groups: Sequence[str] = ("candidate_id", "uf"),
    threshold: float = 3.5,
) -> DataFrame:
    """Robust z-score of every row within its group; null group keys form groups too."""
    keys = [g for g in groups if g in df.columns]
    center = grouped_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q0").alias("_m"))
    centered = spread_join(df, center, keys, df.columns, "left", null_safe=True).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spread = grouped_quantiles(centered, keys, "_d", [0.5]).select(*keys, F.col("q0").alias("_mad"))
    z = F.when(F.coalesce(F.col("_mad"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        0.67448975 * (F.col(value) - F.col("_m")) / F.col("_mad")
    )
    return (
        spread_join(centered, spread, keys, df.columns, "left", null_safe=True)
        .withColumn("robust_z", z)
        .withColumn("is_outlier", F.coalesce(F.abs("robust_z") > threshold, F.lit(False)))
        .drop("_m", "_d", "_mad")
    )


def _cell(c: str) -> Column:
    """Text of a value that differs from the text of null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))


def table_fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Digest of a table that ignores row and column order but counts copies.

    Row hashes are added, not sorted: the fold is commutative, combines on the
    map side and needs no global order. ``keys`` gives one digest per group.
    """
    columns = sorted(c for c in df.columns if c not in keys)
    row = F.sha2(F.concat_ws("\x1f", *[_cell(c) for c in columns]), 256)
    slices = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(3)]
    folded = df.select(*keys, *[s.alias(f"_s{i}") for i, s in enumerate(slices)]).groupBy(*keys).agg(
        F.count("*").alias("row_count"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(3)]
    )
    parts = [F.lit("|".join(columns)), F.col("row_count").cast("string")]
    parts += [F.coalesce(F.col(f"_s{i}").cast("string"), F.lit("0")) for i in range(3)]
    return folded.select(*keys, "row_count", F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"))


GENESIS = "0" * 64


def verify_chain(df: DataFrame, payload: Sequence[str], chain: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Link and content check of hash-chained records.

    ``seq`` counts the records of a chain from ``0``. The previous record is found
    by an equi join on ``seq``, so one long chain spreads over all tasks; a gap
    shows as a broken link.
    """
    previous = df.select(
        *chain, (F.col(seq) + 1).alias(seq), F.col("record_hash").alias("_prev")
    )
    expected = F.when(F.col(seq) == 0, F.lit(GENESIS)).otherwise(F.col("_prev"))
    body = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in payload], F.col("previous_hash")), 256)
    return (
        df.join(previous, [*chain, seq], "left")
        .withColumn("link_ok", F.coalesce(F.col("previous_hash") == expected, F.lit(False)))
        .withColumn("content_ok", F.coalesce(F.col("record_hash") == body, F.lit(False)))
        .drop("_prev")
    )
