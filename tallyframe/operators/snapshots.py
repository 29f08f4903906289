"""Leakage-safe snapshots, rolling-origin folds and grouped folds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import col_of
from tallyframe.operators.skew import partitions_for, spread_join
from tallyframe.session import cut_lineage

# The default horizons in days before the election.
OFFSETS = (180, 120, 90, 60, 30, 15, 7, 3, 1)
MAX_AGE = 90

# First round, second round and start of scoring of each election.
ELECTIONS = (
    (2010, date(2010, 10, 3), date(2010, 10, 31), None),
    (2014, date(2014, 10, 5), date(2014, 10, 26), date(2014, 8, 16)),
    (2018, date(2018, 10, 7), date(2018, 10, 28), date(2018, 9, 11)),
    (2022, date(2022, 10, 2), date(2022, 10, 30), date(2022, 8, 16)),
)


def election(year: int) -> tuple:
    for row in ELECTIONS:
        if row[0] == year:
            return row
    raise ValueError(f"unsupported election: {year}")


def election_calendar(spark: SparkSession, rows: Sequence[tuple] = ELECTIONS) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "year int, first_round_date date, second_round_date date, scoring_start_date date"
    )


def in_age_window(field_date, cutoff, max_age: int = MAX_AGE) -> Column:
    """Both ends belong to the window."""
    field_date, cutoff = col_of(field_date), col_of(cutoff)
    return (field_date <= cutoff) & (field_date >= F.date_sub(cutoff, max_age))


def horizons(elections: Sequence[tuple], offsets: Sequence[int] = OFFSETS) -> Column:
    """The calendar as one literal array: (election, days, cutoff, election day, scorable)."""
    items = []
    for row in elections:
        year, day, start = row[0], row[1], row[3]
        for days in dict.fromkeys(int(o) for o in offsets):
            cutoff = day - timedelta(days=days)
            scorable = start is None or cutoff >= start
            items.append(
                f"named_struct('election_year', {int(year)}, 'days', {days}, 'cutoff', DATE'{cutoff}', "
                f"'election_date', DATE'{day}', 'scorable', {str(scorable).lower()})"
            )
    return F.expr(f"array({', '.join(items)})")


def calendar_days(spark: SparkSession, elections: Sequence[tuple], offsets: Sequence[int] = OFFSETS, max_age: int = MAX_AGE) -> DataFrame:
    """One row per horizon and day of its age window: elections x offsets x 91 rows, whatever the data."""
    h = spark.range(1).select(F.explode(horizons(elections, offsets)).alias("h")).select("h.*")
    return h.withColumn("field_date", F.explode(F.sequence(F.date_sub("cutoff", max_age), F.col("cutoff"))))


def match_horizons(
    polls: DataFrame, elections: Sequence[tuple], offsets: Sequence[int] = OFFSETS, max_age: int = MAX_AGE, election_column: str | None = None
) -> DataFrame:
    """Every poll row once per horizon whose window holds it, as struct ``horizon``.

    The range join becomes an equality on the day, against a calendar whose size
    the study fixes; that is why it may be broadcast.
    """
    days = calendar_days(polls.sparkSession, elections, offsets, max_age)
    fields = [c for c in days.columns if c != "field_date"]
    days = days.select(F.col("field_date").alias("_day"), F.col("election_year").alias("_election"), F.struct(*fields).alias("horizon"))
    on = F.to_date("field_date") == F.col("_day")
    if election_column is not None:
        on = on & (F.col(election_column) == F.col("_election"))
    return polls.join(F.broadcast(days), on).drop("_day", "_election")


def next_election(field_date, elections: Sequence[tuple]) -> Column:
    """Year of the first election on or after a date."""
    items = F.array(*[F.struct(F.lit(r[1]).alias("d"), F.lit(int(r[0])).alias("y")) for r in elections])
    return F.array_min(F.filter(items, lambda e: e["d"] >= col_of(field_date)))["y"]


def build_snapshots(
    polls: DataFrame,
    elections: Sequence[tuple],
    offsets: Sequence[int] = OFFSETS,
    max_age: int = MAX_AGE,
    election_column: str | None = None,
) -> DataFrame:
    """All snapshots of all elections in one job; the horizon is a column.

    The latest poll of a horizon is the greatest poll_id of its latest day, a maximum that combines on the map side; only
    rows of those polls (one per calendar entry) are grouped for their slate, so it is safe to broadcast. The polls (a
    stored table: it is read several times, and its splits are counted) are dealt by poll and gather their candidates once,
    before they meet their horizons by a hash join with the days of the calendar. So a task's share does not grow with
    the table, and no copy of a row is sorted or grouped.
    """
    key = ["_year", "_days"]
    parts = partitions_for(polls)
    polls = polls.withColumn("field_date", F.to_date("field_date"))
    day = ["field_date"] if election_column is None else ["field_date", election_column]

    def matched(df: DataFrame) -> DataFrame:
        rows = match_horizons(df, elections, offsets, max_age, election_column).withColumnRenamed("horizon", "_h")
        return rows.withColumn("_year", F.col("_h.election_year")).withColumn("_days", F.col("_h.days"))

    last = matched(polls.groupBy(*day).agg(F.max("poll_id").alias("poll_id"))).groupBy(*key).agg(F.max(F.struct("field_date", "poll_id")).alias("_last"))
    last = last.select(*[F.col(k).alias(f"_l{k}") for k in key], F.col("_last.poll_id").alias("_poll"))
    same_poll = F.col("poll_id").eqNullSafe(F.col("_poll"))
    same = (F.col("_year") == F.col("_l_year")) & (F.col("_days") == F.col("_l_days")) & same_poll
    own = polls.select(*day, "poll_id", "candidate_id").join(F.broadcast(last.select("_poll").distinct()), same_poll, "left_semi").repartition("poll_id")
    slates = matched(own).join(F.broadcast(last), same, "left_semi").select(*key, "poll_id", "candidate_id").distinct()
    latest = (
        slates.groupBy(*key, "poll_id").agg(F.array_sort(F.collect_list(F.col("candidate_id").cast("string"))).alias("_signature"))
        .where(F.size("_signature") >= 2)
        .select(*key, "_signature", F.substring(F.sha1(F.array_join("_signature", "|")), 1, 12).alias("_hash"))
    )
    name = F.col("candidate_id").cast("string")
    seen = F.collect_set(F.struct(*day, name.alias("_name"))).over(Window.partitionBy("poll_id"))
    dealt = polls.where(F.col("poll_id").isNotNull()).repartition(parts, "poll_id").withColumn("_seen", F.sort_array(seen))
    # A poll of one day has one slate; one of several days has, per horizon, the candidates of the days in its window.
    ends = [F.struct(*[F.element_at("_seen", i)[c] for c in day]) for i in (1, -1)]
    one = ends[0].eqNullSafe(ends[1]) & F.element_at("_seen", 1)["_name"].isNotNull()  # a null name is the first of its day

    def held(x: Column) -> Column:
        inside = in_age_window(x["field_date"], F.col("_h.cutoff"), max_age) & x["_name"].isNotNull()
        return inside if election_column is None else inside & (x[election_column] == F.col("_h.election_year"))

    part = F.sort_array(F.array_distinct(F.transform(F.filter("_seen", held), lambda x: x["_name"])))
    signed = matched(dealt).withColumn("_signature", F.when(one, F.col("_seen._name")).otherwise(part))
    return (
        signed.join(F.broadcast(latest), [*key, "_signature"])
        .withColumn("candidate_slate_hash", F.col("_hash"))
        .withColumn("election_year", F.col("_year"))
        .withColumn("days_before_election", F.col("_days"))
        .withColumn("snapshot_date", F.col("_h.cutoff"))
        .withColumn("election_date", F.col("_h.election_date"))
        .withColumn("scorable", F.col("_h.scorable"))
        .drop("_h", "_hash", "_signature", "_seen", *key)
    )


def rolling_origin(df: DataFrame, date_column: str, min_train: int = 3, measures: Sequence[str] = ()) -> DataFrame:
    """Fold table: training cutoff, test day, and sizes (and sums of ``measures``) of both parts.

    Rows are counted per day first; the running totals then go over one row per
    calendar day. No row is copied into the folds that contain it.
    """
    daily = df.groupBy(F.to_date(date_column).alias("test_day")).agg(
        F.count("*").alias("n_test"), *[F.sum(m).alias(f"test_{m}") for m in measures]
    )
    w = Window.orderBy("test_day")  # one row per calendar day
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        daily.withColumn("fold", F.row_number().over(w) - 1)
        .withColumn("cutoff", F.lag("test_day").over(w))
        .withColumn("n_train", F.sum("n_test").over(before))
        .select("fold", "cutoff", "test_day", "n_train", "n_test",
                *[F.sum(f"test_{m}").over(before).alias(f"train_{m}") for m in measures],
                *[f"test_{m}" for m in measures])
        .where(F.col("fold") >= min_train)
    )


def assign_folds(df: DataFrame, date_column: str, min_train: int = 3) -> DataFrame:
    """Every row once, with the fold that tests it and the first fold that trains on it.

    A row trains all folds from ``train_from`` on, so a fold's training rows are
    ``train_from <= fold`` and its test rows ``test_fold = fold``.
    """
    days = df.select(F.to_date(date_column).alias("_day")).distinct()
    ranks = days.withColumn("_rank", F.row_number().over(Window.orderBy("_day")) - 1)  # one row per day
    out = df.withColumn("_day", F.to_date(date_column)).join(F.broadcast(ranks), "_day")
    return out.withColumn("test_fold", F.when(F.col("_rank") >= min_train, F.col("_rank"))).withColumn(
        "train_from", F.greatest(F.col("_rank") + 1, F.lit(min_train))
    ).drop("_day", "_rank")


def _packing(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """Greedy packing of groups, largest first, each into the lightest fold (the first of equals).

    ``sizes``: (size, number of groups) in descending order. Groups of one size fill the folds in bands: with ``c``
    folds active, places ``starts[c - 1]`` and on take ``orders[c - 1]`` in turns. One entry per size.
    """
    loads, out = [0] * k, []
    for size, n in sizes:
        least = min(loads)
        band = [(x - least) // size for x in loads]
        place = sorted(range(k), key=lambda j: ((loads[j] - least) % size, j))
        ahead = sorted(range(k), key=lambda j: band[j])
        starts, orders = [], []
        for c in range(1, k + 1):
            active = set(ahead[:c])
            starts.append(sum(max(0, band[ahead[c - 1]] - band[j]) for j in active))
            orders.append([j for j in place if j in active])
        out.append((size, starts, orders))
        c = sum(x <= n for x in starts)
        rounds, rest = divmod(n - starts[c - 1], c)
        for i, j in enumerate(orders[c - 1]):
            loads[j] += size * (band[ahead[c - 1]] - band[j] + rounds + (i < rest))
    return out


def group_kfold(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Add ``fold``: groups stay whole and folds differ by one group's size at most.

    Groups go, largest first, to the lightest fold; those of one size are taken in order of md5 and key. Only the
    number of groups per size comes to the driver (at most the square root of twice the rows). A group's place
    among those of its size is its place within an md5 prefix plus the groups of smaller prefixes.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    groups = cut_lineage(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_md5", F.md5(
        F.coalesce(F.col("_key").cast("string"), F.lit(""))))).withColumn("_prefix", F.substring("_md5", 1, 3))
    counts = [(r["_size"], r["n"]) for r in groups.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_size")).collect()]
    if sum(n for _, n in counts) < k:
        raise ValueError(f"{k} folds need at least {k} groups")
    packing = df.sparkSession.createDataFrame(_packing(counts, k), "_size long, _starts array<long>, _orders array<array<int>>")
    prefixes = groups.groupBy("_size", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_size").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)  # 4096 prefixes
    prefixes = prefixes.select("_size", "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_size", "_prefix").orderBy("_md5", F.col("_key").asc_nulls_first())
    placed = groups.withColumn("_in", F.row_number().over(within) - 1).join(prefixes, ["_size", "_prefix"])
    placed = spread_join(placed.withColumn("_place", F.col("_before") + F.col("_in")), packing, ["_size"], ["_md5"])
    active = F.size(F.filter("_starts", lambda x: x <= F.col("_place")))
    turn = F.pmod(F.col("_place") - F.element_at("_starts", active), active).cast("int")
    folds = placed.select(F.coalesce(F.col("_key").cast("string"), F.lit("")).alias("_name"), F.col("_key").isNull().alias("_null"),
                          F.element_at(F.element_at("_orders", active), turn + 1).alias("fold"))
    named = df.withColumn("_name", name).withColumn("_null", F.col(key).isNull())
    return spread_join(named, folds, ["_name", "_null"], df.columns).drop("_name", "_null")
