"""Steps whose cost per task or per row must not grow with the tables; tables are built here."""

import hashlib
import math
import re
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyframe.operators import draws as dr, lineage, priors, snapshots as sn
from tallyframe.plans import jobs, q_draws, q_jobs, q_priors, views as v


@pytest.fixture()
def tables(spark, tmp_path):
    """Star-schema tables of 40 orders; order 3 comes twice, some keys are null."""
    orders = spark.range(40).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit("1997-05-05").cast("date").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    lost = orders.where("o_orderkey = 4").withColumn("o_orderkey", F.lit(None).cast("long"))
    flag = F.element_at(F.array(*[F.lit(x) for x in "ANR"]), (F.col("id") % 3 + 1).cast("int"))
    lines = spark.range(400).select(
        F.when(F.col("id") > 0, F.col("id") % 40).alias("l_orderkey"), flag.alias("l_returnflag"), F.lit(0.05).alias("l_tax"), F.lit(3).alias("l_linenumber"),
        (F.col("id") % 7 + 1).cast("double").alias("l_quantity"), (F.col("id") % 10 / 100).alias("l_discount"))
    made = {
        "orders": orders.unionByName(orders.where("o_orderkey = 3")).unionByName(lost), "lineitem": lines,
        "customer": spark.range(5).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit("AUTO").alias("c_mktsegment")),
        "nation": spark.createDataFrame([(0, "PERU", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "AMERICA")], "r_regionkey int, r_name string"),
    }
    for name, df in made.items():
        df.repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_poll_view_takes_more_partitions_as_more_splits_are_read(spark, tables):
    def used(part_bytes):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
        try:
            plan = v.polls(spark, tables)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        return {key: max(map(int, re.findall(rf"hashpartitioning\({key}#\d+L, (\d+)\)", plan))) for key in ("l_orderkey", "o_custkey")}

    few, many = used("128m"), used("200")
    assert all(many[k] > 2 * few[k] for k in few)


def test_an_order_that_comes_twice_gives_one_row_per_candidate(spark, tables):
    rows = v.polls(spark, tables).collect()
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_orderkey is not null")
    sums = lines.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"), (F.avg("l_discount") * 100).alias("d")).collect()
    want = {(r["l_orderkey"], r["l_returnflag"]): (r["q"], r["d"]) for r in sums}
    assert {(r["poll_id"], r["candidate_id"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        q, disc = want[r["poll_id"], r["candidate_id"]]
        total = sum(x for (k, _), (x, _) in want.items() if k == r["poll_id"])
        assert r["share"] == pytest.approx(100 * q / total) and r["undecided_share"] == pytest.approx(disc)


def test_national_effect_is_drawn_before_a_draw_unfolds_to_places(spark, tables):
    plan = v.draws(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    unfold = plan.index("Generate explode(scalar-subquery")
    assert "sha2" in plan[:unfold] and "sha2" in plan[unfold:]


@pytest.mark.parametrize("name", ["D09_candidate_summary", "D11_turnout_diagnostics"])
def test_votes_are_counted_once_for_both_rounds(spark, tables, monkeypatch, name):
    written = []
    monkeypatch.setattr(q_draws.dr, "runoff", lambda votes, pairs, keys, run=q_draws.dr.runoff: written.append(votes) or run(votes, pairs, keys))
    __spark_entry__.queries()[name](spark, tables)
    assert "Join" not in written[0]._jdf.queryExecution().optimizedPlan().toString()


def test_prediction_stores_the_votes_before_names_are_normalised(spark, tables, monkeypatch):
    class Enough(Exception):
        pass

    def stop(previous, *args, **kwargs):
        raise Enough(previous._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(priors, "build_state_priors", stop)
    with pytest.raises(Enough) as plan:
        __spark_entry__.queries()["D17_predict"](spark, tables)
    assert "Aggregate" not in str(plan.value)


def test_prediction_reads_all_polls_up_to_its_date(spark, tables, monkeypatch):
    class Enough(Exception):
        pass

    def stop(polls, *args, **kwargs):
        raise Enough({r["poll_id"] for r in polls.select("poll_id").collect()})

    monkeypatch.setattr(q_jobs, "complete_polls", stop)
    with pytest.raises(Enough) as seen:
        __spark_entry__.queries()["D17_predict"](spark, tables)
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_orderkey is not null").select("l_orderkey").distinct()
    assert seen.value.args[0] == {r["l_orderkey"] for r in lines.collect()}


def test_slates_are_found_in_dealt_shares_of_the_polls(spark, tmp_path):
    """The polls are dealt once per reading, by poll; no later step deals their rows or groups them over whole splits."""
    day = F.lit("2000-12-20").cast("date")
    polls = spark.range(63).select(
        F.when(F.col("id") < 60, F.col("id") % 20).alias("poll_id"), F.element_at(F.array(*[F.lit(x) for x in "ANR"]), (F.col("id") / 20).cast("int") % 3 + 1).alias("candidate_id"),
        day.alias("field_date"), F.col("id").alias("row"))
    polls.unionByName(polls.where("row = 4")).where("row <> 25").write.parquet(f"{tmp_path}/polls")
    snaps = sn.build_snapshots(spark.read.parquet(f"{tmp_path}/polls"), [(2001, date(2001, 1, 1), None, None)], (3, 1))
    plan = snaps._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#", plan).count("poll_id") == 2
    assert "poll_id" not in "".join(re.findall(r"hashpartitioning\(_\w+#\d+, [^)]*\)", plan))
    rows = snaps.select("poll_id", "days_before_election", "row").collect()
    whole = [i for i in range(20) if i != 5]  # poll 5 lacks a candidate; three rows have no poll
    assert {r["poll_id"] for r in rows} == set(whole) and len(rows) == 2 * (3 * len(whole) + 1)


def test_studies_store_their_candidates_before_names_are_normalised(spark, tables):
    polls = spark.read.parquet(f"{tables}/orders.parquet").select(
        F.col("o_orderkey").alias("poll_id"), F.lit("1997-12-20").cast("date").alias("field_date"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("candidate_id"))
    polls = polls.withColumn("candidate_name", F.concat(F.lit("Candidate "), "candidate_id"))
    made = jobs.study_inputs(polls, v.results(spark, tables), [(1998, date(1998, 1, 1), None, None)], (3, 1), states_only=False)
    assert made.candidates.count() == 4 and made.dates.count() == 2
    for df in (made.candidates, made.dates):
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_dealt_once_for_all_variants_and_share_the_normals_of_their_draw(spark):
    keys, n = jobs.KEYS, 6
    key = spark.createDataFrame([(1999, 7), (1999, 15)], "election_year int, days_before_election int")
    names = [("A", [0.3, 0.0]), ("B", [0.1, 0.2])]
    ids = F.explode(F.array(*[F.lit(x) for x in "ABC"]))
    draws = key.withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).withColumn(
        "geo", F.explode(F.array(F.lit("SP"), F.lit("BR")))).withColumn("candidate_id", ids)
    draws = draws.withColumn("share", F.lit(20.0) + F.pmod(F.xxhash64("geo", "candidate_id", "draw_id"), F.lit(50)))
    roots = key.crossJoin(spark.createDataFrame(names, "candidate_id string, root array<double>"))
    counts = key.select("*", F.lit("SP").alias("uf"), F.lit(2).alias("polls"))
    priors = key.select("*", F.lit("SP").alias("uf"), F.lit(1 / 3).alias("prior_share"), F.lit(1 / 3).alias("national_prior_share"), F.lit(2.0).alias("prior_strength")).withColumn(
        "candidate_id", ids).withColumn("model", F.explode(F.array(F.lit("full"), F.lit("neutral"))))
    slate = draws.select(*keys, "candidate_id").distinct()
    out = jobs.predictive_draws(draws, roots, counts, priors, slate, 5, "model")
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(dealt) == 1 and "draw_id" in dealt[0] and "model" not in dealt[0]
    names = priors.select(*keys, "model").distinct()
    blended = dr.blend_state_prior(draws.join(names, keys), priors, counts.join(names, keys), [*keys, "model"], slate.join(names, keys))
    z = dr.normals(5, F.lit(2), *[F.col(k) for k in [*keys, "model"]], F.col("draw_id"))
    rows = blended.join(roots, [*keys, "candidate_id"], "left").withColumn("z", z).collect()
    want = {}
    for r in rows:
        e = math.exp(sum(a * b for a, b in zip(r["root"] or [], r["z"])))
        want.setdefault((r["days_before_election"], r["model"], r["draw_id"], r["geo"]), {})[r["candidate_id"]] = r["share"] * e
    got = out.collect()
    assert len(got) == len(rows) == 2 * 2 * n * 2 * 3
    for r in got:
        w = want[r["days_before_election"], r["model"], r["draw_id"], r["geo"]]
        assert r["share"] == pytest.approx(100 * w[r["candidate_id"]] / sum(w.values()), rel=1e-12)


def test_calibration_does_not_sort_polls_by_year_and_candidate(spark, tables):
    made = q_priors.calibration_input(spark, tables)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    shares = defaultdict(list)
    for r in v.polls(spark, tables).collect():
        shares[r["field_date"].year, r["candidate_id"]].append(r["share"])
    rows = made.collect()
    assert len(rows) == sum(map(len, shares.values()))
    for r in rows:
        x = shares[r["election_id"], r["candidate_id"]]
        assert r["result_share"] == pytest.approx(sum(x) / len(x))


def test_snapshots_do_not_sort_the_copies_of_a_poll(spark, tmp_path):
    """A poll of several days has, per horizon, the slate of the days in its window; no row is sorted per horizon."""
    election, offsets = date(2001, 1, 1), (120, 60, 30, 1)
    first = date(2000, 6, 1)
    rows = [(i % 23 if i % 17 else None, "ABC"[i % 3] if i % 19 else None, first + timedelta(days=9 * (i % 23) + 40 * (i % 4 == 0)), i) for i in range(150)]
    rows += [(22, c, date(2000, 12, 31), 200 + i) for i, c in enumerate("AB")] + [(21, "A", None, 300)]
    spark.createDataFrame(rows, "poll_id long, candidate_id string, field_date date, row int").write.parquet(f"{tmp_path}/polls")
    snaps = sn.build_snapshots(spark.read.parquet(f"{tmp_path}/polls"), [(2001, election, None, None)], offsets)
    want = set()
    for days in offsets:
        cutoff, slates, last = election - timedelta(days=days), defaultdict(set), defaultdict(lambda: date.min)
        held = [r for r in rows if r[2] is not None and cutoff - timedelta(days=90) <= r[2] <= cutoff]
        for poll, name, day, _ in held:
            slates[poll] |= {name} - {None}
            last[poll] = max(last[poll], day)
        latest = slates[max(last, key=lambda p: (last[p], -1 if p is None else p))]
        want |= {(days, i) for poll, _, _, i in held if poll is not None and slates[poll] == latest and len(latest) > 1}
    got = [(r["days_before_election"], r["row"]) for r in snaps.collect()]
    assert want and len({d for d, _ in want}) > 1 and sorted(got) == sorted(want)
    plan = snaps._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"windowspecdefinition\((\w+)#", plan)) == {"poll_id"}


def test_files_too_large_for_a_row_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "ROW_BYTES", 1000, raising=False)
    monkeypatch.setattr(lineage, "CHUNK_BYTES", 64, raising=False)
    noise = bytes(i * i * 31 % 251 for i in range(3000))
    bodies = {"plain": noise, "ended": noise + b"\n", "mark": b"\xef\xbb\xbf" + noise, "mark_ended": b"\xef\xbb\xbf" + noise + b"\n", "ends": b"\n" * 2000,
              "line": b"x" * 5000, "a %20[b].bin": b"\r\n\xff\x00" * 700, "small": b"hello", "least": b"y" * 1000}
    (tmp_path / "deep").mkdir()
    for i, (name, body) in enumerate(bodies.items()):
        (tmp_path / ("deep" if i % 2 else "") / name).write_bytes(body)
    confs = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "700"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, x in confs.items():
            spark.conf.set(k, x)
        rows = lineage.file_manifest(spark, str(tmp_path)).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert len(rows) == len(bodies)
    assert {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in rows} == {
        name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
