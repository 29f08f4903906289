"""Checks of scalar expressions, closures and row-wise decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import compose, numeric as nm, text as tx
from tallyframe.operators import candidates as cd, gates, polls as po
from tallyframe.plans import views as v
from tallyframe.plans.registry import query, r6


def R(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0e0 AS {name}"


SQL_FOLD = "trim(regexp_replace(lower(strip_accents(replace({c}, chr(160), ' '))), '\\s+', ' ', 'g'))"
SQL_ALNUM = "regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '{gap}', 'g')"


@query("F01_fold", "SELECT doc_id, md5(f) AS folded_md5, length(f) AS n FROM (SELECT doc_id, "
       + SQL_FOLD.format(c="text") + " AS f FROM documents)")
def _(spark, d):
    f = tx.fold("text")
    return v.table(spark, d, "documents").select("doc_id", F.md5(f).alias("folded_md5"), F.length(f).cast("bigint").alias("n"))


@query("F02_slug", "SELECT doc_id, md5(trim(" + SQL_ALNUM.format(c="text", gap="_") + ", '_')) AS slug_md5 FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(tx.slug("text")).alias("slug_md5"))


@query("F03_normalize_name", "SELECT conv_id, turn, trim(" + SQL_ALNUM.format(c="text", gap=" ")
       + ") AS name FROM conversations")
def _(spark, d):
    return v.table(spark, d, "conversations").select("conv_id", "turn", tx.normalize_name("text").alias("name"))


@query("F04_parse_percent", f"""
WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN '–' WHEN 'click' THEN replace(CAST(value AS VARCHAR), '.', ',') || ' %'
  WHEN 'view' THEN props ELSE '0' || CAST(value AS VARCHAR) || '%' END AS raw FROM events),
 s AS (SELECT event_id, replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), ',', '.') AS c FROM t),
 x AS (SELECT event_id, CASE WHEN c NOT IN ('', 'nan', 'N/A', '–', '—', '-')
  THEN TRY_CAST(nullif(regexp_extract(c, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) END AS p FROM s)
SELECT event_id, {R("CASE WHEN p > 1 THEN p / 100e0 ELSE p END", "share")} FROM x""")
def _(spark, d):
    raw = (
        F.when(F.col("event_type") == "error", F.lit("–"))
        .when(F.col("event_type") == "click", F.concat(F.translate(F.col("value").cast("string"), ".", ","), F.lit(" %")))
        .when(F.col("event_type") == "view", F.col("props"))
        .otherwise(F.concat(F.lit("0"), F.col("value").cast("string"), F.lit("%")))
    )
    return v.table(spark, d, "events").select("event_id", r6(tx.parse_percent(raw), "share"))


@query("F05_parse_locale_number", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(CASE l_linenumber
   WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '.' || CAST(l_suppkey AS VARCHAR) || '.000 votos'
   WHEN 2 THEN 'R$ ' || CAST(l_suppkey AS VARCHAR) || ',' || CAST(l_partkey % 100 AS VARCHAR)
   WHEN 3 THEN CAST(l_partkey AS VARCHAR) || '.' || CAST(l_suppkey AS VARCHAR)
   WHEN 4 THEN '1.' || CAST(l_partkey AS VARCHAR) || ',5' WHEN 5 THEN 'n/d'
   ELSE '-' || CAST(l_partkey AS VARCHAR) || ' ' || l_returnflag END, '[^0-9,.-]', '', 'g') AS k FROM lineitem),
 p AS (SELECT *, CASE WHEN contains(k, ',') AND NOT contains(k, '.') THEN replace(k, ',', '.')
   WHEN length(k) - length(replace(k, '.', '')) > 1 THEN replace(k, '.', '') ELSE k END AS q FROM t)
SELECT l_linenumber, count(*) AS rows_seen, count(TRY_CAST(q AS DOUBLE)) AS parsed, {R("sum(TRY_CAST(q AS DOUBLE))", "total")}
FROM p GROUP BY l_linenumber""")
def _(spark, d):
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    raw = (
        F.when(line == 1, F.concat(part, F.lit("."), supp, F.lit(".000 votos")))
        .when(line == 2, F.concat(F.lit("R$ "), supp, F.lit(","), (F.col("l_partkey") % 100).cast("string")))
        .when(line == 3, F.concat(part, F.lit("."), supp))
        .when(line == 4, F.concat(F.lit("1."), part, F.lit(",5")))
        .when(line == 5, F.lit("n/d"))
        .otherwise(F.concat(F.lit("-"), part, F.lit(" "), "l_returnflag"))
    )
    x = tx.parse_locale_number(raw)
    return v.table(spark, d, "lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("rows_seen"), F.count(x).alias("parsed"), r6(F.sum(x), "total"))


@query("F06_parse_period_end", """
SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN NULL
 WHEN o_orderpriority = '4-NOT SPECIFIED' THEN make_date(1999, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN 28 ELSE day(o_orderdate) END)
 ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS period_end FROM orders""")
def _(spark, d):
    pt = F.element_at(F.array(*[F.lit(m) for m in tx.MONTHS_PT]), F.month("o_orderdate"))
    en = F.initcap(F.element_at(F.array(*[F.lit(m) for m in tx.MONTHS_EN]), F.month("o_orderdate")))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    feb29 = F.when((F.month("o_orderdate") == 2) & (F.dayofmonth("o_orderdate") == 29), "28").otherwise(day)
    p = F.col("o_orderpriority")
    raw = (
        F.when(p == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(p == "3-MEDIUM", F.concat(F.lit("1 a "), day, F.lit(" de "), F.initcap(pt), F.lit(" de "), year))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("1–"), feb29, F.lit(" "), en))
        .otherwise(F.lit("a definir"))
    )
    return v.table(spark, d, "orders").select(
        "o_orderkey", tx.parse_period_end(raw, F.lit(1999)).cast("string").alias("period_end"))


@query("F07_parse_sample_size", """
SELECT o_orderkey, TRY_CAST(regexp_replace(regexp_extract('n = ' || CAST(o_custkey AS VARCHAR) || '.' || substr(o_orderpriority, 1, 1) || '00 / ' || o_orderstatus,
 '[\\d,\\.]+', 0), '[^0-9]', '', 'g') AS INTEGER) AS sample_size FROM orders""")
def _(spark, d):
    raw = F.concat(F.lit("n = "), F.col("o_custkey").cast("string"), F.lit("."), F.substring("o_orderpriority", 1, 1), F.lit("00 / "), "o_orderstatus")
    return v.table(spark, d, "orders").select("o_orderkey", tx.parse_sample_size(raw).alias("sample_size"))


@query("F08_poll_id", """
SELECT o_orderkey, 'hist_' || year(o_orderdate) || '_' || substr(sha1(year(o_orderdate) || '|' || o_orderpriority || '|'
 || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderkey), 1, 12) AS poll_id FROM orders""")
def _(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", tx.poll_id(
        F.year("o_orderdate"), "o_orderpriority", F.to_date("o_orderdate"), "o_orderkey").alias("poll_id"))


@query("F09_slate_hash", """
SELECT poll_id, substr(sha1(string_agg(candidate_id, '|' ORDER BY candidate_id)), 1, 12) AS slate
FROM (SELECT DISTINCT l_orderkey AS poll_id, l_returnflag AS candidate_id FROM lineitem) GROUP BY poll_id""")
def _(spark, d):
    return v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("poll_id")).agg(
        tx.slate_hash(F.collect_set("l_returnflag")).alias("slate"))


@query("F10_child_seed", """
SELECT o_orderkey, CAST(('0x' || substr(sha256('42:order-' || o_orderkey), 1, 8))::UBIGINT AS BIGINT) AS seed FROM orders""")
def _(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", nm.child_seed(
        42, F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("seed"))


@query("F11_payload_hash", """
SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS payload FROM events""")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", tx.payload_hash("user_id", "event_type", "event_id").alias("payload"))


@query("F12_as_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", nm.as_date("ts").cast("string").alias("day"))


@query("F13_num", f"""SELECT event_id, {R("greatest(least(coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 50e0), 99e0), 1e0)", "x")} FROM events""")
def _(spark, d):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return v.table(spark, d, "events").select("event_id", r6(nm.num(raw, 50.0, 1.0, 99.0), "x"))


@query("F14_margin", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 {R("CASE WHEN l_tax > 0 THEN l_tax * 100 ELSE 98e0 / sqrt(100 + l_partkey) END", "moe")} FROM lineitem""")
def _(spark, d):
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(
        nm.margin(F.when(F.col("l_tax") > 0, F.col("l_tax") * 100), 100 + F.col("l_partkey")), "moe"))


def raw_polls(spark, d):
    return v.table(spark, d, "lineitem").join(v.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("poll_date"),
        F.col("o_orderpriority").alias("pollster"), F.concat(F.lit("José "), "l_returnflag").alias("candidate_name"),
        F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("n/a").alias("share"),
        (F.col("l_linenumber") * 50).alias("sample_size"), (F.col("l_tax") * 100).alias("margin_error"),
        (F.col("l_quantity") * 3).alias("undecided_share"), F.col("o_orderkey").alias("source_table"), "l_linenumber")


@query("F15_model_poll_schema", f"""
WITH r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS institute, 'jose_' || lower(l_returnflag) AS candidate_id,
  l_discount * 100 AS share, greatest(l_linenumber * 50, 100) AS n, l_tax * 100 AS moe, least(l_quantity * 3, 99) AS und, o_orderkey AS k, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_discount > 0),
 m AS (SELECT 'hist_' || y || '_' || substr(sha1(y || '|' || institute || '|' || day || '|' || k), 1, 12) AS poll_id, *,
  CASE WHEN moe > 0 THEN moe ELSE 98e0 / sqrt(n) END AS margin FROM r),
 f AS (SELECT *, row_number() OVER (PARTITION BY poll_id, candidate_id ORDER BY l_linenumber, share, n, margin, und) AS rn FROM m)
SELECT poll_id, candidate_id, day AS field_date, institute, {R("share", "share")}, CAST(n AS INTEGER) AS sample_size, {R("margin", "margin_error")},
 {R("und", "undecided_share")}, 'unknown' AS collection_mode, 'BR' AS uf FROM f WHERE rn = 1""")
def _(spark, d):
    return po.to_model_poll_schema(raw_polls(spark, d), ["l_linenumber"]).select(
        "poll_id", "candidate_id", F.col("field_date").cast("string").alias("field_date"), "institute", r6("share"),
        "sample_size", r6("margin_error"), r6("undecided_share"), "collection_mode", "uf")


@query("F16_close_composition", f"""
SELECT poll_id, candidate_id, {R("greatest(share, 5) / sum(greatest(share, 5)) OVER (PARTITION BY poll_id)", "share")} FROM polls""", ("polls",))
def _(spark, d):
    return compose.close_composition(v.polls(spark, d), ["poll_id"], "share", 5.0).select("poll_id", "candidate_id", r6("share"))


@query("F17_to_alr", f"""
SELECT poll_id, candidate_id, {R('''ln(share / last_value(share) OVER (PARTITION BY poll_id ORDER BY candidate_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))''', "alr")} FROM polls""", ("polls",))
def _(spark, d):
    return compose.to_alr(v.polls(spark, d), ["poll_id"], "share").select("poll_id", "candidate_id", r6("alr"))


@query("F18_from_alr", f"""SELECT poll_id, candidate_id, {R("share", "share")} FROM polls""", ("polls",))
def _(spark, d):
    alr = compose.to_alr(v.polls(spark, d), ["poll_id"], "share").drop("share")
    return compose.from_alr(alr, ["poll_id"], scale=100.0).select("poll_id", "candidate_id", r6("share"))


@query("F19_logit_sigmoid", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(l_discount * 10, 1 - 1e-5), 1e-5) AS p, l_quantity * 2 - 50 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R("ln(p / (1e0 - p))", "logit")}, {R("1e0 / (1e0 + exp(-greatest(least(q, 30e0), -30e0)))", "sigmoid")} FROM x""")
def _(spark, d):
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r6(nm.logit(F.col("l_discount") * 10), "logit"), r6(nm.sigmoid(F.col("l_quantity") * 2 - 50), "sigmoid"))


@query("F21_recency_weight", f"""
SELECT poll_id, candidate_id, {R("exp(-ln(2e0) * greatest(DATE '1998-01-01' - field_date, 0) / 24e0)", "w")} FROM polls""", ("polls",))
def _(spark, d):
    return v.polls(spark, d).select("poll_id", "candidate_id", r6(
        nm.recency_weight("field_date", F.to_date(F.lit("1998-01-01"))), "w"))


@query("F22_poll_weight", f"""
WITH m AS (SELECT poll_id, max(field_date) AS day, max(sample_size) AS n FROM polls WHERE field_date <= DATE '1998-01-01' GROUP BY poll_id),
 w AS (SELECT *, exp(-ln(2e0) * (DATE '1998-01-01' - day) / 24e0) AS r, sqrt(greatest(n, 100) / 1000e0) AS s FROM m)
SELECT poll_id, {R("CASE WHEN day = (SELECT max(day) FROM m) THEN 1 ELSE 0 END", "latest_poll")}, {R("r", "recency_weighted")},
 {R("r * s", "sample_recency_weighted")}, {R("1", "simple_mean")} FROM w""", ("polls",))
def _(spark, d):
    as_of = F.to_date(F.lit("1998-01-01"))
    meta = po.poll_meta(v.polls(spark, d).where(F.col("field_date") <= as_of))
    latest = meta.agg(F.max("field_date")).scalar()
    return meta.select("poll_id", *[
        r6(nm.poll_weight(m, "field_date", as_of, "sample_size", latest), m) for m in nm.METHODS])


@query("F24_guard_signals", f"""
WITH g AS (SELECT *, 100e0 / count(*) OVER (PARTITION BY race) AS neutral,
  least(greatest(coalesce(search_reliability, 0), 0), 1) * exp(-greatest(coalesce(search_anomaly_score, 3e0), 0)) AS sw,
  least(greatest(coalesce(sentiment_reliability, 0), 0), 1) * exp(-greatest(coalesce(sentiment_anomaly_score, 3e0), 0)) AS tw,
  coalesce(search_anomaly_score, 3e0) > 1.5e0 OR coalesce(sentiment_anomaly_score, 3e0) > 1.5e0 AS flag FROM fund)
SELECT race, candidate_id, {R("neutral + sw * (search_share - neutral)", "search_share_guarded")},
 {R("tw * least(greatest(media_sentiment, -1), 1)", "media_sentiment_guarded")}, {R("(sw + tw) / 2", "digital_signal_reliability")}, flag AS signal_flagged FROM g""", ("fund",))
def _(spark, d):
    return cd.guard_signals(v.fund(spark, d), ["race"]).select(
        "race", "candidate_id", r6("search_share_guarded"), r6("media_sentiment_guarded"),
        r6("digital_signal_reliability"), "signal_flagged")


@query("F25_guard_summary", f"""
WITH g AS (SELECT *, least(coalesce(search_reliability, 0), 1) * exp(-coalesce(search_anomaly_score, 3e0)) AS sw,
  coalesce(sentiment_reliability, 0) * exp(-coalesce(sentiment_anomaly_score, 3e0)) AS tw,
  coalesce(search_anomaly_score, 3e0) > 1.5e0 OR coalesce(sentiment_anomaly_score, 3e0) > 1.5e0 AS flag FROM fund)
SELECT race, {R("avg(sw)", "mean_search_weight")}, {R("avg(tw)", "mean_sentiment_weight")},
 coalesce(string_agg(candidate_id, ',' ORDER BY candidate_id) FILTER (flag), '') AS flagged, avg(sw) < 0.35 AS weak_search_signal, avg(tw) < 0.35 AS weak_sentiment_signal
FROM g GROUP BY race""", ("fund",))
def _(spark, d):
    g = cd.guard_summary(cd.guard_signals(v.fund(spark, d), ["race"]), ["race"])
    return g.select("race", r6("mean_search_weight"), r6("mean_sentiment_weight"),
                    F.array_join("flagged_candidates", ",").alias("flagged"), "weak_search_signal", "weak_sentiment_signal")


SQL_PAIRS = """pairs AS (SELECT s.race, s.candidate_id AS source_id, a.candidate_id AS a_id, b.candidate_id AS b_id,
  abs(s.ideology_score - a.ideology_score) AS da, abs(s.ideology_score - b.ideology_score) AS db,
  b.rejection - a.rejection AS rej, CAST(s.bloc = a.bloc AS INTEGER) - CAST(s.bloc = b.bloc AS INTEGER) AS bloc,
  a.incumbency - b.incumbency AS inc, s.rejection AS srej
  FROM fund s JOIN fund a ON s.race = a.race AND s.candidate_id <> a.candidate_id
  JOIN fund b ON s.race = b.race AND b.candidate_id NOT IN (s.candidate_id, a.candidate_id))"""


@query("F26_pair_features", f"""WITH {SQL_PAIRS}
SELECT race, source_id, a_id, b_id, {R("db - da", "distance_advantage_a")}, {R("rej", "rejection_advantage_a")}, {R("bloc", "same_bloc_advantage_a")},
 {R("inc", "incumbency_advantage_a")}, {R("srej", "source_rejection")}, {R("da + db", "finalist_distance_sum")} FROM pairs""", ("fund",))
def _(spark, d):
    return cd.pair_features(v.fund(spark, d), ["race"]).select(
        "race", "source_id", "a_id", "b_id", r6("distance_advantage_a"), r6("rejection_advantage_a"),
        r6("same_bloc_advantage_a"), r6("incumbency_advantage_a"), r6("source_rejection"), r6("finalist_distance_sum"))


@query("F27_fallback_transfer", f"""WITH {SQL_PAIRS}
SELECT race, source_id, a_id, b_id, {R("1e0 / (1e0 + exp(-(1.8e0 * (db - da) + 0.025e0 * rej)))", "p_a")},
 {R("least(greatest(0.06e0 + 0.0015e0 * srej + 0.04e0 * least(da, db), 0.03e0), 0.35e0)", "p_abstain")} FROM pairs""", ("fund",))
def _(spark, d):
    return cd.fallback_transfer(cd.pair_features(v.fund(spark, d), ["race"])).select(
        "race", "source_id", "a_id", "b_id", r6("p_a"), r6("p_abstain"))


@query("F28_scenarios", f"""
WITH s(scenario, t, p) AS (VALUES ('baseline', 1e0, 0e0), ('lower_turnout', 0.97e0, 0e0), ('higher_turnout', 1.03e0, 0e0), ('poll_error_minus_2', 1e0, -2e0), ('poll_error_plus_2', 1e0, 2e0))
SELECT scenario, poll_id, candidate_id, {R("CASE WHEN candidate_id = 'A' THEN least(greatest(share + p, 0e0), 100e0) ELSE share END", "share")},
 {R("least(greatest((1 - undecided_share / 100) * t, 0e0), 1e0)", "expected_turnout")} FROM polls, s""", ("polls",))
def _(spark, d):
    df = v.polls(spark, d).withColumn("expected_turnout", 1 - F.col("undecided_share") / 100)
    return cd.apply_scenarios(df, "A").select("scenario", "poll_id", "candidate_id", r6("share"), r6("expected_turnout"))


@query("F29_publication_status", f"""
WITH e AS (SELECT event_id, 2020 + user_id % 3 * 2 AS y, CASE event_type WHEN 'click' THEN 'synthetic' WHEN 'view' THEN 'historical' ELSE 'operational' END AS t,
 CASE user_id % 3 WHEN 0 THEN 'independently_validated' WHEN 1 THEN 'backtested' ELSE 'unvalidated' END AS s FROM events)
SELECT event_id, t <> 'synthetic' AND s = 'independently_validated' AS allowed,
 CASE WHEN t = 'synthetic' THEN '{gates.SYNTHETIC[0]}' WHEN s <> 'independently_validated' THEN '{gates.PENDING[0]}' ELSE '{gates.ELIGIBLE[0]}' END AS status,
 CASE WHEN t = 'synthetic' THEN '{gates.SYNTHETIC[1]}' WHEN s <> 'independently_validated' THEN '{gates.PENDING[1]}' END AS watermark,
 CASE WHEN t = 'synthetic' THEN '{gates.SYNTHETIC[2]}' || y || '.' WHEN s <> 'independently_validated' THEN '{gates.PENDING[2]}' ELSE '{gates.ELIGIBLE[2]}' END AS reason FROM e""")
def _(spark, d):
    e = v.table(spark, d, "events").select(
        "event_id", (2020 + F.col("user_id") % 3 * 2).alias("election_year"),
        F.when(F.col("event_type") == "click", "synthetic").when(F.col("event_type") == "view", "historical").otherwise("operational").alias("dataset_type"),
        F.when(F.col("user_id") % 3 == 0, "independently_validated").when(F.col("user_id") % 3 == 1, "backtested").otherwise("unvalidated").alias("validation_status"))
    return gates.publication_status(e).select("event_id", "allowed", "status", "watermark", "reason")


_RR = gates.RELEASE_REASONS


@query("F30_release_gate", f"""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'Synthetic' ELSE 'Real' END AS t, CASE user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'Approved' ELSE 'validated' END AS s,
  user_id % 5 AS n, CASE WHEN event_type <> 'error' THEN value / 500 END AS b, value / 1000 AS c FROM events),
 r AS (SELECT event_id, concat_ws('; ', CASE WHEN lower(t) <> 'real' THEN '{_RR["dataset"]}' END, CASE WHEN lower(s) NOT IN ('validated', 'approved') THEN '{_RR["validation"]}' END,
  CASE WHEN n < 2 THEN '{_RR["elections"]}' END, CASE WHEN b IS NULL OR b > 0.25 THEN '{_RR["brier"]}' END, CASE WHEN c IS NULL OR c > 0.1 THEN '{_RR["calibration"]}' END) AS reasons FROM e)
SELECT event_id, reasons = '' AS allowed, reasons FROM r""")
def _(spark, d):
    e = v.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "Synthetic").otherwise("Real").alias("dataset_type"),
        F.when(F.col("user_id") % 4 == 0, "pending").when(F.col("user_id") % 4 == 1, "Approved").otherwise("validated").alias("validation_status"),
        (F.col("user_id") % 5).alias("backtest_elections"),
        F.when(F.col("event_type") != "error", F.col("value") / 500).alias("brier_score"), (F.col("value") / 1000).alias("calibration_error"))
    return gates.release_gate(e).select("event_id", "allowed", F.array_join("reasons", "; ").alias("reasons"))


@query("F31_drift_level", """
SELECT event_id, CASE WHEN value / 400 < 0.1e0 THEN 'stable' WHEN value / 400 < 0.25e0 THEN 'watch' ELSE 'drifted' END AS level FROM events""")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", nm.drift_level(F.col("value") / 400).alias("level"))


@query("F32_turnout_inputs", f"""
WITH s AS (SELECT n_name AS uf FROM nation), p AS (SELECT uf, max(CAST(eligible AS BIGINT)) AS rv FROM turnout WHERE "year" < 1998 AND region <> 'ASIA' GROUP BY uf),
 t AS (SELECT uf, min(present / eligible) AS h FROM turnout WHERE region <> 'AFRICA' GROUP BY uf)
SELECT s.uf, {R("coalesce(h, 0.79e0)", "historical_turnout")}, {R("0.5e0", "competitiveness")}, {R("coalesce(rv, 1000000)", "registered_voters")}
FROM s LEFT JOIN p USING (uf) LEFT JOIN t USING (uf)""", ("turnout",))
def _(spark, d):
    t = v.turnout(spark, d)
    states = v.table(spark, d, "nation").select(F.col("n_name").alias("uf"))
    priors = t.where((F.col("year") < 1998) & (F.col("region") != "ASIA")).select("uf", F.col("eligible").cast("bigint").alias("registered_voters"))
    turn = t.where(F.col("region") != "AFRICA").select("uf", (F.col("present") / F.col("eligible")).alias("historical_turnout"))
    return cd.turnout_inputs(states, priors, turn).select("uf", r6("historical_turnout"), r6("competitiveness"), r6("registered_voters"))


_ALIAS_SQL = ", ".join(f"('{c}', '{a}')" for c, names in cd.ALIASES.items() for a in names)


@query("J09_canonical_candidate", f"""
WITH al(canonical, alias) AS (VALUES {_ALIAS_SQL}),
 n AS (SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM (SELECT conv_id, turn,
   CASE conv_id % 7 WHEN 0 THEN 'José Lula ' || role WHEN 1 THEN 'Jair Messias Bolsonaro' WHEN 2 THEN 'AÉCIO Neves da Cunha' WHEN 3 THEN 'Ciro Haddad ' || turn
   WHEN 4 THEN 'Marina Silva / ' || role ELSE text END AS t FROM conversations)),
 c AS (SELECT conv_id, turn, norm, (SELECT max(canonical) FROM al WHERE alias = norm) AS exact,
  (SELECT max({{'n': len(string_split(alias, ' ')), 'c': canonical}}) FROM al WHERE len(list_filter(string_split(alias, ' '), lambda x: NOT list_contains(string_split(norm, ' '), x))) = 0) AS best FROM n)
SELECT conv_id, turn, md5(coalesce(exact, best.c, replace(norm, ' ', '_'))) AS canonical_md5 FROM c""")
def _(spark, d):
    c = F.col("conv_id") % 7
    name = (
        F.when(c == 0, F.concat(F.lit("José Lula "), "role")).when(c == 1, F.lit("Jair Messias Bolsonaro"))
        .when(c == 2, F.lit("AÉCIO Neves da Cunha")).when(c == 3, F.concat(F.lit("Ciro Haddad "), F.col("turn").cast("string")))
        .when(c == 4, F.concat(F.lit("Marina Silva / "), "role")).otherwise(F.col("text"))
    )
    return v.table(spark, d, "conversations").select("conv_id", "turn", F.md5(cd.canonical_candidate(name)).alias("canonical_md5"))


@query("J02_feature_frame", f"""
WITH s AS (SELECT race, candidate_id, candidate_name, search_share AS poll_mean FROM fund),
 g AS (SELECT * FROM fund WHERE bloc <> 'bloc2')
SELECT s.race, s.candidate_id, 'incomplete' AS problem FROM s LEFT JOIN g USING (race, candidate_id, candidate_name)
WHERE g.race IS NULL OR search_reliability IS NULL OR search_anomaly_score IS NULL""", ("fund",))
def _(spark, d):
    f = v.fund(spark, d)
    summary = f.select("race", "candidate_id", "candidate_name", F.col("search_share").alias("poll_mean"))
    _, problems = cd.build_feature_frame(summary, f.where(F.col("bloc") != "bloc2"), ["race"])
    return problems
