"""Checks of readers, results, quality rules, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import polls as po, quality as qu, results as rs
from tallyframe.plans import views as v
from tallyframe.plans.q_scalars import R
from tallyframe.plans.registry import query, r6
from tallyframe.session import cut_lineage, scratch_dir
from tallyframe.sources import readers as rd

# ---- readers ---------------------------------------------------------------


@query("S01_official_csv", """
SELECT ANO_ELEICAO AS "year", SG_UF AS uf, NM_VOTAVEL AS candidate_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(QT_VOTOS) AS BIGINT) AS votes
FROM raw_results GROUP BY ALL""", ("raw_results",))
def _(spark, d):
    path = scratch_dir(spark, "official")
    raw = v.raw_results(spark, d).withColumnRenamed("DS_CARGO", "Ds Cargo ç")
    raw.write.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    df = rd.read_official_csv(spark, path, {
        "year": ("ANO_ELEICAO",), "uf": ("SG_UF", "UF"), "candidate_name": ("NM_VOTAVEL", "NM_CANDIDATO"), "votes": ("QT_VOTOS",),
        "office": ("DS_CARGO_C",)})
    return df.groupBy(F.col("year").cast("int").alias("year"), "uf", "candidate_name").agg(
        F.count("*").alias("n"), F.sum(F.col("votes").cast("bigint")).alias("votes"))


@query("S04_series_json", f"""
SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
 {R("CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END", "val")} FROM orders""")
def _(spark, d):
    path = scratch_dir(spark, "series")
    v.table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.lit("31/31/x")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("data"),
        F.when(F.col("o_orderpriority") == "5-LOW", "-").otherwise(
            F.translate(F.format_string("%.2f", "o_totalprice"), ".", ",")).alias("valor"),
    ).write.json(path)
    return rd.read_series_json(spark, path, multi_line=False).select(F.col("date").cast("string").alias("day"), r6("value", "val"))


def wide_polls(spark, d):
    def q(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(f"q_{flag.lower()}")
    return v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(q("A"), q("N"), q("R"))


MAPPING = {"q_a": ("Ana Alves", "PA"), "q_n": ("Nuno Neves", "PN"), "q_r": ("Rui Reis", "PR")}
SQL_MAP = "(VALUES ('A', 'Ana Alves', 'PA'), ('N', 'Nuno Neves', 'PN'), ('R', 'Rui Reis', 'PR')) AS m(flag, candidate_name, party)"


@query("S05_melt_polls", f"""
SELECT l_orderkey, candidate_name, party, {R("sum(l_quantity) / 100", "share")} FROM lineitem JOIN {SQL_MAP} ON l_returnflag = flag GROUP BY ALL""")
def _(spark, d):
    return rd.melt_polls(wide_polls(spark, d), MAPPING, ["l_orderkey"]).select("l_orderkey", "candidate_name", "party", r6("share"))


@query("S06_melt_results", f"""
WITH g AS (SELECT l_suppkey, l_linenumber, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
 k AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem),
 f AS (SELECT k.l_suppkey, k.l_linenumber, candidate_name, party, q AS votes FROM k CROSS JOIN {SQL_MAP} LEFT JOIN g ON g.l_suppkey = k.l_suppkey AND g.l_linenumber = k.l_linenumber AND g.l_returnflag = flag)
SELECT l_suppkey, l_linenumber, candidate_name, party, votes, {R("votes / sum(votes) OVER (PARTITION BY l_suppkey, l_linenumber)", "vote_share")} FROM f""")
def _(spark, d):
    def q(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).cast("bigint").alias(f"q_{flag.lower()}")
    wide = v.table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(q("A"), q("N"), q("R"))
    return rd.melt_results(wide, MAPPING, ["l_suppkey", "l_linenumber"]).select(
        "l_suppkey", "l_linenumber", "candidate_name", "party", "votes", r6("vote_share"))


@query("S07_read_processed", 'SELECT "year", uf, candidate_id, votes FROM results WHERE "year" IN (1996, 1999)', ("results",))
def _(spark, d):
    root = scratch_dir(spark, "processed")
    rd.write_processed(v.results(spark, d), root, "results")
    return rd.read_processed(spark, root, "results", [1996, 1999]).select("year", "uf", "candidate_id", "votes")


@query("S08_previous_year", """
SELECT y AS "year", lag(y) OVER (ORDER BY y) AS previous_year FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem)""")
def _(spark, d):
    return rs.previous_year(v.table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year")))


def poll_cells(spark, d):
    """Orders staged as cells of wide poll tables: one table per (status, year)."""
    lines = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("int").alias(f) for f in "ANR"])
    o = v.table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    pct = [F.coalesce(F.concat(F.col(f).cast("string"), F.lit(",5 %")), F.lit("–")) for f in "ANR"]
    cells = [
        ("Polling firm", F.when(F.col("o_orderpriority") == "5-LOW", "Results").otherwise(F.col("o_orderpriority"))),
        ("Date(s) administered", F.date_format("o_orderdate", "dd/MM/yyyy")),
        ("Sample size", F.format_string("%d.000", "o_custkey")),
        ("Votos | José A", pct[0]), ("Votos | N", pct[1]), ("Votos | R", pct[2]),
        ("Lead", F.lit("5")),
        ("Obs", F.when(F.col("o_custkey") % 10 == 0, "1").otherwise("sem nota")),
    ]
    return o.select(
        F.concat(F.lit("https://example.org/"), "o_orderstatus").alias("url"), F.year("o_orderdate").alias("table_id"), F.col("o_orderkey").alias("row_id"),
        F.posexplode(F.array(*[F.struct(F.lit(h).alias("column_name"), t.alias("text")) for h, t in cells])).alias("column_index", "c"),
    ).select("url", "table_id", "row_id", "column_index", "c.column_name", "c.text")


@query("S12_tidy_wide_tables", f"""
WITH g AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT DISTINCT 'https://example.org/' || o_orderstatus AS url, CAST(year(o_orderdate) AS INTEGER) AS source_table, strftime(o_orderdate, '%Y-%m-%d') AS poll_date,
 o_orderpriority AS pollster, CAST(o_custkey * 1000 AS INTEGER) AS sample_size, CASE l_returnflag WHEN 'A' THEN 'José A' ELSE l_returnflag END AS candidate_name,
 {R("(q + 0.5e0) / 100e0", "share")} FROM g JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'""")
def _(spark, d):
    return rd.tidy_wide_tables(poll_cells(spark, d), 1999).select(
        "url", "source_table", F.col("poll_date").cast("string").alias("poll_date"), "pollster", "sample_size", "candidate_name", r6("share"))


def result_cells(spark, d):
    """Votes per nation staged as cells of state tables, one per year and region-free layout."""
    names = F.array(*[F.lit(n.title()) for n in rd.STATE_NAMES])
    g = v.lines_by_place(spark, d).groupBy("year", "n_nationkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("bigint").alias(f) for f in "ANR"])
    big = [F.concat(F.translate(F.format_number(F.col(f) * 1000, 0), ",", "."), F.lit(" votos")) for f in "ANR"]
    cells = [("Estado", F.element_at(names, F.col("n_nationkey") + 1)), ("Alfa %", F.lit("40,1")), ("Alfa votos", big[0]),
             ("Nina votos", big[1]), ("Rosa total", F.col("R").cast("string")), ("Rosa votos", big[2]), ("Outros", F.lit("900"))]
    return g.select(
        F.col("year").alias("table_id"), F.col("n_nationkey").alias("row_id"),
        F.posexplode(F.array(*[F.struct(F.lit(h).alias("column_name"), t.alias("text")) for h, t in cells])).alias("column_index", "c"),
    ).select("table_id", "row_id", "column_index", "c.column_name", "c.text")


_STATES_SQL = "[" + ", ".join(f"'{uf}'" for uf in rd.STATE_NAMES.values()) + "]"


@query("S13_pick_vote_columns", f"""
WITH g AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS table_id, {_STATES_SQL}[n_nationkey + 1] AS uf, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) * 1000 AS votes
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT table_id, uf, CASE f WHEN 'A' THEN 'Alfa Um' WHEN 'N' THEN 'Nina Dois' ELSE 'Rosa Três' END AS candidate_name, votes,
 {R("votes / sum(votes) OVER (PARTITION BY table_id, uf)", "vote_share")} FROM g""")
def _(spark, d):
    names = {"Álfa": ("Alfa Um", "PA"), "Nina": ("Nina Dois", "PN"), "Rosa": ("Rosa Três", "PR"), "Zeca": ("Zeca", "PZ")}
    return rd.pick_vote_columns(result_cells(spark, d), names).select("table_id", "uf", "candidate_name", "votes", r6("vote_share"))


# ---- results ---------------------------------------------------------------

SQL_A01 = """a01 AS (SELECT "year", "round", uf, candidate_name, party, votes, votes / sum(votes) OVER (PARTITION BY "year", "round", uf) AS vote_share FROM
 (SELECT ANO_ELEICAO AS "year", NR_TURNO AS "round", upper(SG_UF) AS uf, NM_VOTAVEL AS candidate_name, upper(SG_PARTIDO) AS party, CAST(sum(QT_VOTOS) AS BIGINT) AS votes
  FROM raw_results WHERE contains(upper(DS_CARGO), 'PRESIDENT') AND NM_VOTAVEL <> 'NULO' GROUP BY ALL))"""


@query("A01_normalize_results", f"""WITH {SQL_A01} SELECT "year", "round", uf, candidate_name, party, votes, {R("vote_share", "vote_share")} FROM a01""", ("raw_results",))
def _(spark, d):
    return rs.normalize_results(v.raw_results(spark, d)).select("year", "round", "uf", "candidate_name", "party", "votes", r6("vote_share"))


@query("A02_merge_results", f"""
WITH {SQL_A01}, u AS (SELECT "year", "round", uf, candidate_name, party, votes FROM a01 UNION SELECT "year", "round", uf, candidate_name, party, votes + 1 FROM a01 WHERE "year" = 1998),
 g AS (SELECT "year", "round", uf, candidate_name, party, CAST(sum(votes) AS BIGINT) AS votes FROM u GROUP BY ALL)
SELECT *EXCLUDE (votes), votes, {R('votes / sum(votes) OVER (PARTITION BY "year", "round", uf)', "vote_share")} FROM g""", ("raw_results",))
def _(spark, d):
    a = rs.normalize_results(v.raw_results(spark, d))
    b = a.where(F.col("year") == 1998).withColumn("votes", F.col("votes") + 1)
    return rs.merge_results([a, a, b]).select("year", "round", "uf", "candidate_name", "party", "votes", r6("vote_share"))


@query("A03_normalize_turnout", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", 1 AS "round", n_name AS uf, {R("sum(l_quantity)", "eligible")}, {R("sum(CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity * (1 - l_tax) END)", "present")},
 {R("sum(CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity * (1 - l_tax) END) / sum(l_quantity)", "turnout_rate")}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, d):
    raw = v.lines_by_place(spark, d).select(
        F.col("year").alias("ANO_ELEICAO"), F.lower("n_name").alias("UF"), F.lit("1").alias("NUM_TURNO"), F.col("l_quantity").alias("QT_ELEITORES"),
        F.when(F.col("l_tax") == 0, "sem dado").otherwise((F.col("l_quantity") * (1 - F.col("l_tax"))).cast("string")).alias("QT_COMPARECIMENTO"))
    return rs.normalize_turnout(raw).select("year", "round", "uf", r6("eligible"), r6("present"), r6("turnout_rate"))


SQL_WEIGHTS = """w AS (SELECT "year", uf, present AS expected_votes, present / sum(present) OVER (PARTITION BY "year") AS national_weight FROM turnout)"""


def weights(spark, d):
    t = v.turnout(spark, d).select("year", "uf", F.col("eligible").alias("eligible_voters"), (F.col("present") / F.col("eligible")).alias("expected_turnout"))
    return rs.state_weights(t, ["year"])


@query("A04_state_weights", f"""WITH {SQL_WEIGHTS} SELECT "year", uf, {R("expected_votes", "expected_votes")}, {R("national_weight", "national_weight")} FROM w""", ("turnout",))
def _(spark, d):
    return weights(spark, d).select("year", "uf", r6("expected_votes"), r6("national_weight"))


@query("A05_weighted_share", f"""
WITH {SQL_WEIGHTS}, s AS (SELECT "year", uf, candidate_id, votes / sum(votes) OVER (PARTITION BY "year", uf) AS share FROM results WHERE uf <> 'NATION_3')
SELECT "year", candidate_id, {R("sum(share * national_weight) / sum(national_weight)", "share")} FROM s JOIN w USING ("year", uf) GROUP BY ALL""", ("turnout", "results"))
def _(spark, d):
    shares = rs.with_vote_share(v.results(spark, d).where(F.col("uf") != "NATION_3"), ["year", "uf"])
    return rs.weighted_share(shares, weights(spark, d), ["year"], ["year", "candidate_id"], "vote_share").select("year", "candidate_id", r6("vote_share", "share"))


@query("A06_shrink_to_region", f"""
WITH x AS (SELECT "year", uf, region, present / eligible AS v, present / 100 AS w FROM turnout),
 m AS (SELECT *, sum(v * w) OVER (PARTITION BY "year", region) / sum(w) OVER (PARTITION BY "year", region) AS rm FROM x)
SELECT "year", uf, {R("rm", "region_mean")}, {R("(w * v + 5 * rm) / (w + 5)", "shrunk")} FROM m""", ("turnout",))
def _(spark, d):
    t = v.turnout(spark, d).select("year", "uf", "region", (F.col("present") / F.col("eligible")).alias("v"), (F.col("present") / 100).alias("w"))
    return rs.shrink_to_region(t, "v", "w", 5.0, "region", ["year"]).select("year", "uf", r6("region_mean"), r6("shrunk"))


_REGION_SQL = "CASE " + " ".join(f"WHEN uf IN ({', '.join(repr(u) for u in ufs)}) THEN '{r}'" for r, ufs in rs.MACROREGIONS.items()) + " END"
_STATE_LIST = "[" + ", ".join(repr(s) for s in rs.STATES) + "]"


@query("F20_add_macroregion", f"""
SELECT macroregion, count(*) AS customers, {R("sum(c_acctbal)", "balance")} FROM (SELECT *, {_REGION_SQL} AS macroregion FROM (SELECT *, {_STATE_LIST}[c_nationkey + 1] AS uf FROM customer)) GROUP BY macroregion""")
def _(spark, d):
    c = v.table(spark, d, "customer").withColumn("uf", F.element_at(F.array(*[F.lit(s) for s in rs.STATES]), F.col("c_nationkey") + 1))
    return rs.add_macroregion(c).groupBy("macroregion").agg(F.count("*").alias("customers"), r6(F.sum("c_acctbal"), "balance"))


@query("A07_poll_meta", f"""
SELECT poll_id, strftime(max(field_date), '%Y-%m-%d') AS field_date, min(institute) AS institute, min(collection_mode) AS collection_mode, min(scope) AS scope, min(uf) AS uf,
 max(sample_size) AS sample_size, {R("max(margin_error)", "margin_error")}, {R("max(undecided_share)", "undecided_share")} FROM polls GROUP BY poll_id""", ("polls",))
def _(spark, d):
    return po.poll_meta(v.polls(spark, d)).select("poll_id", F.col("field_date").cast("string").alias("field_date"), "institute", "collection_mode",
                                                  "scope", "uf", "sample_size", r6("margin_error"), r6("undecided_share"))


@query("A08_poll_signature", "SELECT poll_id, string_agg(DISTINCT candidate_id, '|' ORDER BY candidate_id) AS signature FROM polls GROUP BY poll_id", ("polls",))
def _(spark, d):
    return po.poll_signature(v.polls(spark, d)).select("poll_id", F.array_join("signature", "|").alias("signature"))


@query("A09_national_map", f"""
WITH s AS (SELECT *, votes / sum(votes) OVER (PARTITION BY "year", uf) AS vote_share FROM results), t AS (SELECT *, CASE WHEN "year" % 2 = 0 THEN votes ELSE 0 END AS v FROM s),
 g AS (SELECT "year", candidate_name, sum(v) AS v, avg(vote_share) AS sh FROM t GROUP BY ALL), x AS (SELECT *, CASE WHEN sum(v) OVER (PARTITION BY "year") > 0 THEN v ELSE sh END AS z FROM g)
SELECT "year", candidate_name, {R('z / sum(z) OVER (PARTITION BY "year")', "national_share")} FROM x""", ("results",))
def _(spark, d):
    s = rs.with_vote_share(v.results(spark, d), ["year", "uf"]).withColumn("votes", F.when(F.col("year") % 2 == 0, F.col("votes")))
    return rs.national_map(s, "candidate_name", ["year"]).select("year", "candidate_name", r6("national_share"))


@query("A10_actual_shares", f"""
WITH w AS (SELECT DISTINCT "year", party FROM results WHERE NOT (party = 'PN' AND "year" = 1997)),
 r AS (SELECT s."year", uf, s.candidate_name, votes FROM sparse_results s WHERE contains(candidate_name, 'ring') OR contains(candidate_name, 'widget')),
 wanted AS (SELECT DISTINCT "year", replace(candidate_name, ' ', '_') AS canonical FROM r),
 g AS (SELECT "year", replace(candidate_name, ' ', '_') AS canonical, uf, CAST(sum(votes) AS BIGINT) AS votes FROM sparse_results GROUP BY GROUPING SETS (("year", canonical, uf), ("year", canonical))),
 k AS (SELECT "year", canonical, coalesce(uf, 'BR') AS uf, votes FROM g JOIN wanted USING ("year", canonical)),
 slots AS (SELECT * FROM (SELECT DISTINCT "year", uf FROM k) JOIN wanted USING ("year")),
 z AS (SELECT "year", uf, canonical, coalesce(votes, 0) AS votes FROM slots LEFT JOIN k USING ("year", uf, canonical))
SELECT "year", uf, canonical, votes, {R('votes / sum(votes) OVER (PARTITION BY "year", uf)', "actual_share")} FROM z""", ("results", "sparse_results"))
def _(spark, d):
    s = v.sparse_results(spark, d).withColumn("round", F.lit(1)).withColumn("canonical", F.translate("candidate_name", " ", "_"))
    wanted = s.where(F.col("candidate_name").contains("ring") | F.col("candidate_name").contains("widget"))
    return rs.actual_shares(s, wanted, ["year"], absent="zero", canonical="canonical").select("year", "uf", "canonical", "votes", r6("actual_share"))


@query("A11_poll_counts", """
SELECT 'uf' AS kind, uf AS name, count(DISTINCT poll_id) AS polls FROM polls WHERE uf <> 'BR' GROUP BY uf
UNION ALL SELECT 'institute', institute, count(DISTINCT poll_id) FROM polls GROUP BY institute""", ("polls",))
def _(spark, d):
    meta = v.polls(spark, d)
    parts = [po.poll_counts(meta, k).select(F.lit(k).alias("kind"), F.col(k).alias("name"), "polls") for k in ("uf", "institute")]
    return parts[0].unionByName(parts[1])


def record_metrics(spark, d):
    f = v.forecasts(spark, d)
    return f.withColumn("vote_share_mae", F.abs(F.col("predicted_share") - F.col("actual_share"))).withColumn(
        "coverage", F.col("actual_share").between(F.col("lower"), F.col("upper")).cast("double")).withColumn(
        "winner_brier", F.pow(F.col("win_probability") - F.col("outcome"), 2))


SQL_REC = """rec AS (SELECT *, abs(predicted_share - actual_share) AS vote_share_mae, CAST(actual_share BETWEEN lower AND upper AS DOUBLE) AS coverage,
 pow(win_probability - outcome, 2) AS winner_brier FROM forecasts)"""


@query("A12_aggregate_metrics", f"""WITH {SQL_REC} SELECT model, level, election_year, {R("avg(vote_share_mae)", "vote_share_mae")}, {R("avg(coverage)", "coverage")},
 {R("avg(winner_brier)", "winner_brier")}, count(*) AS observations FROM rec GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    g = rs.aggregate_metrics(record_metrics(spark, d), ["model", "level", "election_year"], ["vote_share_mae", "coverage", "winner_brier"])
    return g.select("model", "level", "election_year", r6("vote_share_mae"), r6("coverage"), r6("winner_brier"), "observations")


@query("A13_error_by_horizon", f"""WITH {SQL_REC} SELECT model, days_before_election, {R("avg(vote_share_mae)", "vote_share_mae")} FROM rec GROUP BY ALL""", ("forecasts",))
def _(spark, d):
    return rs.error_by_horizon(record_metrics(spark, d)).select("model", "days_before_election", r6("vote_share_mae"))


@query("W01_share_of_group", f"""SELECT "year", uf, candidate_id, {R('votes / sum(votes) OVER (PARTITION BY "year", uf)', "vote_share")} FROM results""", ("results",))
def _(spark, d):
    return rs.with_vote_share(v.results(spark, d), ["year", "uf"]).select("year", "uf", "candidate_id", r6("vote_share"))


@query("T01_ordered_results", f"""WITH {SQL_A01} SELECT "year", "round", uf, candidate_name, party, votes FROM a01 ORDER BY "year", "round", uf, votes DESC""", ("raw_results",))
def _(spark, d):
    return rs.ordered_results(rs.normalize_results(v.raw_results(spark, d))).select("year", "round", "uf", "candidate_name", "party", "votes")


@query("T04_latest_runs", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    from tallyframe.operators.lineage import latest
    return latest(v.table(spark, d, "events"), ["ts", "event_id"], 1000).select("event_id", "user_id", "event_type")


@query("T05_best_model", f"""WITH {SQL_REC} SELECT model, level, {R("avg(vote_share_mae)", "vote_share_mae")} FROM rec GROUP BY ALL ORDER BY avg(vote_share_mae), model, level LIMIT 1""", ("forecasts",))
def _(spark, d):
    g = rs.aggregate_metrics(record_metrics(spark, d), ["model", "level"], ["vote_share_mae"])
    return g.orderBy("vote_share_mae", "model", "level").limit(1).select("model", "level", r6("vote_share_mae"))


# ---- predicates and quality -------------------------------------------------


@query("P01_available_as_of", "SELECT event_id FROM events WHERE event_type <> 'error' AND CAST(ts AS DATE) <= DATE '2024-01-15'")
def _(spark, d):
    e = v.table(spark, d, "events").withColumn("release_date", F.when(F.col("event_type") != "error", F.to_date("ts")))
    return qu.available_as_of(e, "2024-01-15").select("event_id")


@query("P02_leakage_rows", "SELECT event_id FROM events WHERE event_type = 'error' OR CAST(ts AS DATE) > DATE '2024-01-15' ")
def _(spark, d):
    e = v.table(spark, d, "events").withColumn("release_date", F.when(F.col("event_type") != "error", F.to_date("ts")))
    return qu.leakage_rows(e, "release_date", "2024-01-15").select("event_id")


@query("P03_age_window", "SELECT poll_id, candidate_id FROM polls WHERE field_date BETWEEN DATE '1998-01-01' - 90 AND DATE '1998-01-01'", ("polls",))
def _(spark, d):
    from tallyframe.operators.snapshots import in_age_window
    return v.polls(spark, d).where(in_age_window("field_date", F.to_date(F.lit("1998-01-01")))).select("poll_id", "candidate_id")


@query("P04_filter_office", """SELECT SG_UF AS uf, count(*) AS n FROM raw_results WHERE contains(upper(DS_CARGO), 'PRESIDENT') AND ANO_ELEICAO = 1998 GROUP BY ALL""", ("raw_results",))
def _(spark, d):
    return rs.filter_office(v.raw_results(spark, d), year=1998).groupBy(F.col("SG_UF").alias("uf")).agg(F.count("*").alias("n"))


@query("P05_valid_votes", "SELECT NM_VOTAVEL AS candidate, CAST(sum(QT_VOTOS) AS BIGINT) AS votes FROM raw_results WHERE NM_VOTAVEL <> 'NULO' GROUP BY ALL", ("raw_results",))
def _(spark, d):
    return rs.valid_votes(v.raw_results(spark, d), "NM_VOTAVEL").groupBy(F.col("NM_VOTAVEL").alias("candidate")).agg(F.sum("QT_VOTOS").alias("votes"))


@query("P06_valid_states", f"""SELECT c_custkey, {_STATE_LIST}[c_nationkey + 1] AS uf FROM customer WHERE c_nationkey NOT IN (3, 4)""")
def _(spark, d):
    uf = F.element_at(F.array(*[F.lit(s) for s in rs.STATES]), F.col("c_nationkey") + 1)
    c = v.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, "BR").when(F.col("c_nationkey") == 4, "ZZ").otherwise(uf).alias("uf"))
    return rs.valid_states(c)


@query("P07_scored", "SELECT election_year, uf, count(*) AS n FROM forecasts WHERE scorable AND outcome IS NOT NULL AND actual_share IS NOT NULL GROUP BY ALL", ("forecasts",))
def _(spark, d):
    from tallyframe.operators.scoring import scored
    return scored(v.forecasts(spark, d)).groupBy("election_year", "uf").agg(F.count("*").alias("n"))


@query("P08_complete_polls", """
WITH k AS (SELECT institute, count(DISTINCT candidate_id) AS n FROM polls GROUP BY institute)
SELECT poll_id, candidate_id FROM polls JOIN (SELECT poll_id, institute, count(DISTINCT candidate_id) AS m FROM polls GROUP BY ALL) USING (poll_id, institute) JOIN k USING (institute) WHERE m = n""", ("polls",))
def _(spark, d):
    return po.complete_polls(cut_lineage(v.polls(spark, d)), ["institute"]).select("poll_id", "candidate_id")


@query("P08_incomplete_polls", """
WITH k AS (SELECT institute, count(DISTINCT candidate_id) AS n FROM polls GROUP BY institute)
SELECT institute, poll_id FROM (SELECT poll_id, institute, count(DISTINCT candidate_id) AS m FROM polls GROUP BY ALL) JOIN k USING (institute) WHERE m < n""", ("polls",))
def _(spark, d):
    return po.incomplete_polls(cut_lineage(v.polls(spark, d)), ["institute"])


def gate_polls(spark, d):
    p = v.table(spark, d, "lineitem")
    return p.select(
        F.col("l_orderkey").alias("poll_id"), F.col("l_returnflag").alias("candidate_id"), F.concat(F.lit("inst"), (F.col("l_suppkey") % 7).cast("string")).alias("institute"),
        F.to_date("l_shipdate").alias("fieldwork_end"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") * 100 - 100).alias("sample_size"),
        (F.col("l_quantity") * 2.1).alias("share"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("_id"))


@query("Q01_required_columns", "SELECT 'polls: missing column fieldwork_end' AS error, count(*) AS rows FROM polls", ("polls",))
def _(spark, d):
    return qu.check_columns(v.polls(spark, d), "polls")


@query("Q02_check_probability", """SELECT count(*) FILTER (event_type = 'error') AS not_numeric, count(*) FILTER (event_type <> 'error' AND value / 200 > 1) AS out_of_range,
 count(*) FILTER (event_type = 'error') = 0 AND count(*) FILTER (event_type <> 'error' AND value / 200 > 1) = 0 AS valid FROM events""")
def _(spark, d):
    e = v.table(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "error", "bad").otherwise((F.col("value") / 200).cast("string")))
    return qu.check_probability(e, "p")


_Q03 = """SELECT 'sample_size must contain positive numbers' AS rule, count(*) FILTER (l_linenumber IN (1, 3)) AS violations FROM lineitem
UNION ALL SELECT 'share must be numeric and between 0 and 100', count(*) FILTER (l_quantity * 2.1e0 > 100) FROM lineitem
UNION ALL SELECT 'duplicate poll_id/candidate_id observations detected', CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) > 1)"""


@query("Q03_check_polls", _Q03)
def _(spark, d):
    return qu.check_polls(gate_polls(spark, d))


@query("Q05_evaluate_dataset", f"""
SELECT 'polls' AS dataset, string_agg(rule, '; ' ORDER BY rule) AS errors, count(*) = 0 AS allowed FROM ({_Q03}) WHERE violations > 0""")
def _(spark, d):
    return qu.evaluate_dataset("polls", gate_polls(spark, d)).select("dataset", F.array_join("errors", "; ").alias("errors"), "allowed")


@query("Q06_check_refs", """
SELECT DISTINCT p_name AS candidate_id, 'fundamentals' AS missing_in FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45 AND p_brand < 'Brand#15')
UNION ALL SELECT DISTINCT p_name, 'state_priors' FROM part WHERE p_name NOT IN (SELECT candidate_name FROM sparse_results WHERE uf = 'NATION_1' AND "year" = 1997)""", ("sparse_results",))
def _(spark, d):
    p = v.table(spark, d, "part").withColumnRenamed("p_name", "candidate_id")
    priors = v.sparse_results(spark, d).where((F.col("uf") == "NATION_1") & (F.col("year") == 1997)).withColumnRenamed("candidate_name", "candidate_id")
    return qu.check_refs(p, p.where((F.col("p_size") > 45) & (F.col("p_brand") < "Brand#15")), priors)


@query("J11_referential_check", """
SELECT DISTINCT candidate_id, 'fundamentals' AS missing_in FROM (SELECT 'Brand#' || (user_id % 40) AS candidate_id FROM events) WHERE candidate_id NOT IN (SELECT p_brand FROM part)""")
def _(spark, d):
    e = v.table(spark, d, "events").select(F.concat(F.lit("Brand#"), (F.col("user_id") % 40).cast("string")).alias("candidate_id"))
    return qu.check_refs(e, v.table(spark, d, "part").select(F.col("p_brand").alias("candidate_id")))


def _range_sql(rules, table):
    parts = []
    for column, low, open_low, high in rules:
        bad = f"{column} {'<=' if open_low else '<'} {low}" + (f" OR {column} > {high}" if high is not None else "")
        parts.append(f"SELECT '{column}' AS field, count(*) FILTER ({bad}) AS violations FROM {table}")
    return " UNION ALL ".join(parts)


_FUND_RULES = [r for r in qu.RANGES["fundamentals"] if r[0] not in ("government_approval", "unemployment")]


@query("Q07_check_ranges", _range_sql(qu.RANGES["polls"], "polls") + " UNION ALL " + _range_sql(_FUND_RULES, "fund"), ("polls", "fund"))
def _(spark, d):
    return qu.check_ranges(v.polls(spark, d), "polls").unionByName(qu.check_ranges(v.fund(spark, d), _FUND_RULES))


@query("Q04_deduplicate_polls", """
WITH r AS (SELECT l_orderkey AS poll_id, l_returnflag AS candidate_id, 'inst' || (l_suppkey % 7) AS institute, CASE WHEN l_linenumber <> 3 THEN l_linenumber * 100 - 100 END AS sample_size,
  l_quantity AS share, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id FROM lineitem),
 m AS (SELECT *, row_number() OVER (PARTITION BY poll_id, candidate_id ORDER BY id) AS a, row_number() OVER (PARTITION BY institute, sample_size, candidate_id, share ORDER BY id) AS b FROM r)
SELECT poll_id, candidate_id, institute, sample_size, CAST(share AS INTEGER) AS share, CASE WHEN a = 1 AND b = 1 THEN 'accepted' ELSE 'rejected' END AS state FROM m""")
def _(spark, d):
    p = gate_polls(spark, d).drop("fieldwork_end").withColumn("share", (F.col("share") / 2.1).cast("int"))
    yes, no = qu.deduplicate_polls(p, "_id")
    cols = ["poll_id", "candidate_id", "institute", "sample_size", "share"]
    return yes.select(*cols, F.lit("accepted").alias("state")).unionByName(no.select(*cols, F.lit("rejected").alias("state")))


@query("W04_duplicate_marks", """
WITH m AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY event_type, CAST(value AS INTEGER) ORDER BY event_id) AS b FROM events)
SELECT event_id, a > 1 OR b > 1 AS is_duplicate FROM m""")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.col("user_id").alias("poll_id"), F.col("event_type").alias("candidate_id"), F.rint("value").cast("int").alias("share"))
    yes, no = qu.deduplicate_polls(e, "event_id")
    return yes.select("event_id", F.lit(False).alias("is_duplicate")).unionByName(no.select("event_id", F.lit(True).alias("is_duplicate")))


@query("W02_flag_outliers", f"""
WITH m AS (SELECT *, median(share) OVER (PARTITION BY candidate_id, uf) AS med FROM polls), k AS (SELECT *, median(abs(share - med)) OVER (PARTITION BY candidate_id, uf) AS mad FROM m),
 z AS (SELECT *, CASE WHEN coalesce(mad, 0) = 0 THEN 0 ELSE 0.67448975e0 * (share - med) / mad END AS rz FROM k)
SELECT poll_id, candidate_id, {R("rz", "robust_z")}, abs(rz) > 2 AS is_outlier FROM z""", ("polls",))
def _(spark, d):
    return qu.flag_outliers(cut_lineage(v.polls(spark, d)), threshold=2.0).select("poll_id", "candidate_id", r6("robust_z"), "is_outlier")


@query("Q08_table_fingerprint", """
WITH h AS (SELECT event_type, sha256(concat_ws(chr(31), coalesce('v' || event_id, 'n'), coalesce('v' || props, 'n'), coalesce('v' || CASE WHEN user_id % 3 > 0 THEN user_id END, 'n'))) AS x FROM events),
 g AS (SELECT event_type, count(*) AS row_count, sum(('0x' || substr(x, 1, 15))::UBIGINT) AS a, sum(('0x' || substr(x, 16, 15))::UBIGINT) AS b, sum(('0x' || substr(x, 31, 15))::UBIGINT) AS c FROM h GROUP BY event_type)
SELECT event_type, row_count, sha256('event_id|props|user_id:' || row_count || ':' || a || ':' || b || ':' || c) AS fingerprint FROM g""")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_type", "props", "event_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("user_id"))
    return qu.table_fingerprint(e, ["event_type"])


def chain_records(spark, d):
    """Events as a log whose every record names the payload hash of the one before; some are tampered."""
    e = v.table(spark, d, "events")
    body = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    here = e.select("event_id", "event_type", "user_id", body.alias("payload_sha"))
    before = here.select((F.col("event_id") + 1).alias("event_id"), F.col("payload_sha").alias("_p"))
    j = here.join(before, "event_id", "left").withColumn("previous_hash", F.coalesce("_p", F.lit(qu.GENESIS)))
    return j.withColumn("record_hash", F.when(F.col("user_id") % 50 == 7, F.lit("tampered")).otherwise(F.col("payload_sha"))).withColumnRenamed("event_id", "seq")


@query("W08_previous_record", """
WITH h AS (SELECT event_id AS seq, user_id, sha256(event_id || '|' || event_type) AS p FROM events), r AS (SELECT seq, lag(p) OVER (ORDER BY seq) AS prev, CASE WHEN user_id % 50 = 7 THEN 'tampered' ELSE p END AS rec FROM h)
SELECT seq, coalesce(prev, repeat('0', 64)) = coalesce(lag(rec) OVER (ORDER BY seq), repeat('0', 64)) AS link_ok FROM r""")
def _(spark, d):
    return qu.verify_chain(chain_records(spark, d), ["seq", "event_type"]).select("seq", "link_ok")


@query("Q09_verify_chain", """
WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id, event_type, sha256(event_id || '|' || event_type) AS p FROM events),
 r AS (SELECT *, CASE WHEN seq = 0 THEN repeat('0', 64) ELSE lag(p) OVER (PARTITION BY user_id ORDER BY seq) END AS prev FROM h),
 k AS (SELECT *, CASE WHEN event_type = 'error' THEN 'x' ELSE sha256(event_id || '|' || event_type || '|' || prev) END AS rec FROM r)
SELECT user_id, seq, CASE WHEN seq = 0 THEN true ELSE prev = lag(rec) OVER (PARTITION BY user_id ORDER BY seq) END AS link_ok, rec = sha256(event_id || '|' || event_type || '|' || prev) AS content_ok FROM k""")
def _(spark, d):
    from pyspark.sql import Window
    e = v.table(spark, d, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).withColumn("p", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256))
    e = e.withColumn("previous_hash", F.coalesce(F.lag("p").over(w), F.lit(qu.GENESIS)))
    body = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "previous_hash"), 256)
    e = e.withColumn("record_hash", F.when(F.col("event_type") == "error", "x").otherwise(body))
    return qu.verify_chain(e, ["event_id", "event_type"], ["user_id"]).select("user_id", "seq", "link_ok", "content_ok")


# ---- set operations ---------------------------------------------------------


@query("U01_union_geos", """SELECT "year", uf, candidate_id, votes FROM results UNION ALL SELECT "year", 'BR', candidate_id, CAST(sum(votes) AS BIGINT) FROM results GROUP BY "year", candidate_id""", ("results",))
def _(spark, d):
    r = v.results(spark, d).select("year", "uf", "candidate_id", "votes")
    return r.unionByName(r.groupBy("year", "candidate_id").agg(F.sum("votes").alias("votes")).withColumn("uf", F.lit("BR")))


@query("U02_distinct_candidates", "SELECT DISTINCT candidate_id, candidate_name, institute FROM polls", ("polls",))
def _(spark, d):
    return v.polls(spark, d).select("candidate_id", "candidate_name", "institute").distinct()


@query("U03_intersection", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, d):
    o = v.table(spark, d, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("id"))
    return a.intersect(o.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey"))


@query("U04_coverage_difference", """
WITH o AS (SELECT DISTINCT "year", uf FROM sparse_results WHERE uf <> 'NATION_9' OR "year" = 1996), e AS (SELECT y AS "year", n_name AS uf FROM nation, (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) WHERE n_regionkey <> 2)
SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""", ("sparse_results",))
def _(spark, d):
    o = v.sparse_results(spark, d).where((F.col("uf") != "NATION_9") | (F.col("year") == 1996)).select("year", "uf").distinct()
    years = v.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct().agg(F.collect_list("year")).scalar()
    e = v.table(spark, d, "nation").where(F.col("n_regionkey") != 2).select(F.explode(years).alias("year"), F.col("n_name").alias("uf"))
    return rs.coverage_difference(o, e)


@query("J03_weights_join", f"""WITH {SQL_WEIGHTS} SELECT "year", uf, candidate_id, votes, {R("national_weight", "national_weight")} FROM results JOIN w USING ("year", uf)""", ("results", "turnout"))
def _(spark, d):
    return v.results(spark, d).join(weights(spark, d), ["year", "uf"]).select("year", "uf", "candidate_id", "votes", r6("national_weight"))


@query("J13_region_point", f"""
SELECT "year", uf, {R('present / eligible - avg(present / eligible) OVER (PARTITION BY "year", region)', "gap")} FROM turnout""", ("turnout",))
def _(spark, d):
    t = v.turnout(spark, d).withColumn("rate", F.col("present") / F.col("eligible"))
    mean = t.groupBy("year", "region").agg(F.avg("rate").alias("region_rate"))
    return t.join(mean, ["year", "region"]).select("year", "uf", r6(F.col("rate") - F.col("region_rate"), "gap"))
