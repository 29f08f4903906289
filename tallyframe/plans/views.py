"""Survey tables derived from the given star-schema tables, in Spark and in SQL.

Each view exists twice: a DataFrame (used by the queries) and a SQL text
(used by the checks). Nation and region are fixed-size dimensions; every
other join leaves the strategy to the optimizer and adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import hash_normal
from tallyframe.operators.skew import partitions_for

SEED = 42


def fill_slots(df: DataFrame) -> DataFrame:
    """Spread a small input over all slots before a costly projection (large inputs have splits enough)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def polls(spark: SparkSession, d: str) -> DataFrame:
    """One row per (poll, candidate): orders are polls, return flags are candidates."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    parts = partitions_for(lines)
    # Lines are summed to candidates before they meet their order; an order that comes n times counts its lines n times.
    lines = lines.where(F.col("l_orderkey").isNotNull()).repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_returnflag").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    orders = table(spark, d, "orders").where(F.col("o_orderkey").isNotNull()).repartition(parts, "o_orderkey").groupBy(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("times"))
    buyers = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "c_mktsegment", "n_name")
    n = F.lit(500) + F.col("o_custkey") % 1500
    state = F.col("o_orderstatus") == "F"
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("qty", F.col("qty") * F.col("times"))
        .withColumn("total", F.sum("qty").over(Window.partitionBy("o_orderkey")))
        .repartition(parts, "o_custkey")
        .join(buyers.repartition(parts, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("poll_id"),
            F.to_date("o_orderdate").alias("field_date"),
            F.col("o_orderpriority").alias("institute"),
            F.col("c_mktsegment").alias("collection_mode"),
            F.col("o_orderstatus").alias("target_population"),
            F.when(state, "state").otherwise("national").alias("scope"),
            F.when(state, F.col("n_name")).otherwise("BR").alias("uf"),
            F.col("l_returnflag").alias("candidate_id"),
            F.concat(F.lit("Candidate "), "l_returnflag").alias("candidate_name"),
            (100.0 * F.col("qty") / F.col("total")).alias("share"),
            n.cast("int").alias("sample_size"),
            (98.0 / F.sqrt(n)).alias("margin_error"),
            (100.0 * F.col("disc")).alias("undecided_share"),
        )
    )


def lines_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with the year of the order and the state of the buyer."""
    return (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("year", F.year("o_orderdate"))
    )


def raw_results(spark: SparkSession, d: str) -> DataFrame:
    """Ballot counts before normalisation, in the official column layout."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return lines_by_place(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("year").alias("ANO_ELEICAO"),
        F.lit(1).alias("NR_TURNO"),
        F.lower("n_name").alias("SG_UF"),
        F.when(F.col("o_orderpriority") == "5-LOW", "GOVERNOR").otherwise("President").alias("DS_CARGO"),
        F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linenumber") == 7, "NULO")
               .otherwise(F.col("p_brand"))).otherwise(F.col("p_brand")).alias("NM_VOTAVEL"),
        F.lower("p_type").alias("SG_PARTIDO"),
        F.col("l_quantity").cast("bigint").alias("QT_VOTOS"),
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    """Votes by (year, uf, candidate): three candidates, one party each."""
    return (
        lines_by_place(spark, d)
        .groupBy("year", F.col("n_name").alias("uf"), F.col("l_returnflag").alias("candidate_id"))
        .agg(F.sum("l_quantity").cast("bigint").alias("votes"))
        .select("year", F.lit(1).alias("round"), "uf", "candidate_id",
                F.concat(F.lit("Candidate "), "candidate_id").alias("candidate_name"),
                F.concat(F.lit("P"), "candidate_id").alias("party"), "votes")
    )


def sparse_results(spark: SparkSession, d: str) -> DataFrame:
    """Votes with gaps: part names are candidates, brands are parties, only large urgent lines count."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return (
        lines_by_place(spark, d)
        .where((F.col("o_orderpriority") == "1-URGENT") & (F.col("l_quantity") >= 45))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("year", F.col("n_name").alias("uf"), F.col("p_name").alias("candidate_name"),
                 F.col("p_brand").alias("party"))
        .agg(F.sum("l_quantity").cast("bigint").alias("votes"))
    )


def turnout(spark: SparkSession, d: str) -> DataFrame:
    return (
        lines_by_place(spark, d)
        .groupBy("year", F.col("n_name").alias("uf"), F.col("r_name").alias("region"))
        .agg(F.sum("l_quantity").alias("eligible"),
             F.sum(F.col("l_quantity") * (1 - F.col("l_discount") * 3)).alias("present"))
    )


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Forecast records: one per order line."""
    supplier = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", "n_name", "n_regionkey")
    days = F.element_at(F.array(*[F.lit(x) for x in (1, 3, 7, 15, 30, 60, 90)]), F.col("l_linenumber"))
    strength = F.element_at(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.5, 5.0, 10.0)]), F.col("l_linenumber") % 5 + 1)
    return table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.year("l_shipdate").alias("election_year"),
        days.alias("days_before_election"),
        F.col("n_name").alias("uf"),
        F.when(F.col("n_regionkey") == 0, "national").otherwise("state").alias("level"),
        F.concat(F.lit("model_"), "l_linestatus").alias("model"),
        (F.col("l_quantity") > 2).alias("scorable"),
        (F.col("l_discount") * 10).alias("win_probability"),
        F.when(F.col("l_quantity") != 7, (F.col("l_returnflag") == "R").cast("int")).alias("outcome"),
        F.col("l_discount").alias("predicted_share"),
        F.col("l_tax").alias("actual_share"),
        (F.col("l_discount") - 0.03).alias("lower"),
        (F.col("l_discount") + 0.03).alias("upper"),
        strength.alias("prior_strength"),
    )


def fund(spark: SparkSession, d: str) -> DataFrame:
    """Fundamentals per race: the race is the shipping year, the brands are its candidates."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    g = (
        table(spark, d, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.year("l_shipdate").alias("race"), F.col("p_brand").alias("candidate_id"))
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"),
             F.sum("l_linenumber").alias("lines"), F.sum("l_discount").alias("disc"))
    )
    return g.select(
        "race", "candidate_id", F.concat(F.lit("Name "), "candidate_id").alias("candidate_name"),
        (F.round(F.col("disc") * 100) % 97).alias("rejection"),
        (F.col("qty") % 201 / 100.0 - 1.0).alias("ideology_score"),
        F.concat(F.lit("bloc"), (F.col("n") % 3).cast("string")).alias("bloc"),
        (F.col("n") % 2).cast("int").alias("incumbency"),
        (F.col("qty") % 101).alias("search_share"),
        (F.col("lines") % 301 / 100.0 - 1.5).alias("media_sentiment"),
        F.when(F.col("n") % 13 != 0, F.col("n") % 12 / 10.0).alias("search_reliability"),
        (F.col("lines") % 11 / 10.0).alias("sentiment_reliability"),
        F.when(F.col("lines") % 17 != 0, F.col("lines") % 25 / 10.0).alias("search_anomaly_score"),
        (F.col("n") % 19 / 10.0).alias("sentiment_anomaly_score"),
        (F.col("qty") % 41 / 10.0 - 2.0).alias("late_decider_score"),
    )


def geo_centers(spark: SparkSession, d: str) -> DataFrame:
    """Share of each candidate per region, and its log ratio to the last candidate."""
    return (
        lines_by_place(spark, d)
        .groupBy(F.col("r_name").alias("geo"))
        .agg(*[F.sum(F.when(F.col("l_returnflag") == c, F.col("l_quantity"))).alias(f"q_{c}") for c in "ANR"])
        .select("geo", F.log(F.col("q_A") / F.col("q_R")).alias("m0"), F.log(F.col("q_N") / F.col("q_R")).alias("m1"))
    )


def draws(spark: SparkSession, d: str) -> DataFrame:
    """Long draws table ``(draw_id, geo, candidate_id, share)``; every order seeds one draw.

    The five regional centres travel as one array, so the draw side never shuffles.
    """
    centers = geo_centers(spark, d).agg(F.collect_list(F.struct("geo", "m0", "m1")).alias("c"))
    key = F.col("o_orderkey")
    geo = F.col("g.geo")

    nation = [(0.3 * hash_normal(F.lit(SEED), F.lit("nat"), key, F.lit(dim))).alias(f"n{dim}") for dim in (0, 1)]

    def latent(dim: int):
        return F.col(f"g.m{dim}") + F.col(f"n{dim}") + 0.15 * hash_normal(F.lit(SEED), geo, key, F.lit(dim))

    # The national effect is drawn once per draw, before the draw unfolds to places.
    rows = fill_slots(table(spark, d, "orders").select(key)).select(key, *nation).select(key, "n0", "n1", F.explode(centers.scalar()).alias("g"))
    rows = rows.select(key.alias("draw_id"), geo.alias("geo"),
                       F.exp(latent(0)).alias("e0"), F.exp(latent(1)).alias("e1"))
    total = F.col("e0") + F.col("e1") + 1.0
    parts = [(c, e) for c, e in zip("ANR", (F.col("e0"), F.col("e1"), F.lit(1.0)))]
    return rows.select(
        "draw_id", "geo",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("candidate_id"), (100.0 * e / total).alias("share")) for c, e in parts
        ])).alias("p"),
    ).select("draw_id", "geo", "p.candidate_id", "p.share")


def national_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws without geography, from the national effect alone."""
    c = lines_by_place(spark, d).agg(
        *[F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity"))).alias(f"q_{x}") for x in "ANR"]
    ).select(F.struct(F.log(F.col("q_A") / F.col("q_R")).alias("m0"), F.log(F.col("q_N") / F.col("q_R")).alias("m1")).alias("c"))
    key = F.col("o_orderkey")
    rows = fill_slots(table(spark, d, "orders").select(key)).select(key, c.scalar().alias("c"))
    e = [F.exp(F.col(f"c.m{i}") + 0.3 * hash_normal(F.lit(SEED), F.lit("nat"), key, F.lit(i))) for i in (0, 1)]
    rows = rows.select(key.alias("draw_id"), e[0].alias("e0"), e[1].alias("e1"))
    total = F.col("e0") + F.col("e1") + 1.0
    return rows.select("draw_id", F.explode(F.array(*[
        F.struct(F.lit(x).alias("candidate_id"), (100.0 * v / total).alias("share"))
        for x, v in zip("ANR", (F.col("e0"), F.col("e1"), F.lit(1.0)))
    ])).alias("p")).select("draw_id", "p.candidate_id", "p.share")


# --- the same views as SQL -------------------------------------------------

def sql_uniform(text: str) -> str:
    return f"((('0x' || substr(sha256({text}), 1, 8))::UBIGINT)::DOUBLE + 0.5e0) / 4294967296e0"


def sql_normal(text: str) -> str:
    return (f"(sqrt(-2e0 * ln({sql_uniform(text + chr(32) + '|| ' + repr(':r'))})) * "
            f"cos({2 * math.pi!r}e0 * {sql_uniform(text + chr(32) + '|| ' + repr(':a'))}))")


_PLACE = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "polls": ((), """
 SELECT o_orderkey AS poll_id, CAST(o_orderdate AS DATE) AS field_date, o_orderpriority AS institute,
  c_mktsegment AS collection_mode, o_orderstatus AS target_population,
  CASE WHEN o_orderstatus = 'F' THEN 'state' ELSE 'national' END AS scope,
  CASE WHEN o_orderstatus = 'F' THEN n_name ELSE 'BR' END AS uf,
  l_returnflag AS candidate_id, 'Candidate ' || l_returnflag AS candidate_name,
  100e0 * qty / sum(qty) OVER (PARTITION BY o_orderkey) AS share,
  CAST(500 + o_custkey % 1500 AS INTEGER) AS sample_size,
  98e0 / sqrt(500 + o_custkey % 1500) AS margin_error, 100e0 * disc AS undecided_share
 FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS qty, avg(l_discount) AS disc
       FROM lineitem GROUP BY l_orderkey, l_returnflag)
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey"""),
    "raw_results": ((), f"""
 SELECT CAST(year(o_orderdate) AS INTEGER) AS ANO_ELEICAO, 1 AS NR_TURNO, lower(n_name) AS SG_UF,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'GOVERNOR' ELSE 'President' END AS DS_CARGO,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'NULO' ELSE p_brand END AS NM_VOTAVEL,
  lower(p_type) AS SG_PARTIDO, CAST(l_quantity AS BIGINT) AS QT_VOTOS
 FROM {_PLACE} JOIN part ON l_partkey = p_partkey"""),
    "results": ((), f"""
 SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", 1 AS "round", n_name AS uf, l_returnflag AS candidate_id,
  'Candidate ' || l_returnflag AS candidate_name, 'P' || l_returnflag AS party,
  CAST(sum(l_quantity) AS BIGINT) AS votes
 FROM {_PLACE} GROUP BY ALL"""),
    "sparse_results": ((), f"""
 SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", n_name AS uf, p_name AS candidate_name, p_brand AS party,
  CAST(sum(l_quantity) AS BIGINT) AS votes
 FROM {_PLACE} JOIN part ON l_partkey = p_partkey
 WHERE o_orderpriority = '1-URGENT' AND l_quantity >= 45 GROUP BY ALL"""),
    "turnout": ((), f"""
 SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", n_name AS uf, r_name AS region, sum(l_quantity) AS eligible,
  sum(l_quantity * (1 - l_discount * 3)) AS present FROM {_PLACE} GROUP BY ALL"""),
    "forecasts": ((), """
 SELECT CAST(year(l_shipdate) AS INTEGER) AS election_year, [1, 3, 7, 15, 30, 60, 90][l_linenumber] AS days_before_election,
  n_name AS uf, CASE WHEN n_regionkey = 0 THEN 'national' ELSE 'state' END AS level,
  'model_' || l_linestatus AS model, l_quantity > 2 AS scorable, l_discount * 10 AS win_probability,
  CASE WHEN l_quantity <> 7 THEN CAST(l_returnflag = 'R' AS INTEGER) END AS outcome,
  l_discount AS predicted_share, l_tax AS actual_share, l_discount - 0.03e0 AS lower, l_discount + 0.03e0 AS upper,
  [0.5e0, 1e0, 2.5e0, 5e0, 10e0][l_linenumber % 5 + 1] AS prior_strength
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""),
    "fund": ((), """
 SELECT race, candidate_id, 'Name ' || candidate_id AS candidate_name, round(disc * 100) % 97 AS rejection,
  qty % 201 / 100e0 - 1e0 AS ideology_score, 'bloc' || CAST(n % 3 AS VARCHAR) AS bloc,
  CAST(n % 2 AS INTEGER) AS incumbency, qty % 101 AS search_share, lines % 301 / 100e0 - 1.5e0 AS media_sentiment,
  CASE WHEN n % 13 <> 0 THEN n % 12 / 10e0 END AS search_reliability, lines % 11 / 10e0 AS sentiment_reliability,
  CASE WHEN lines % 17 <> 0 THEN lines % 25 / 10e0 END AS search_anomaly_score,
  n % 19 / 10e0 AS sentiment_anomaly_score, qty % 41 / 10e0 - 2e0 AS late_decider_score
 FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS race, p_brand AS candidate_id, count(*) AS n, sum(l_quantity) AS qty,
   CAST(sum(l_linenumber) AS BIGINT) AS lines, sum(l_discount) AS disc
   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""),
    "geo_centers": ((), f"""
 SELECT r_name AS geo, ln(sum(l_quantity) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'R')) AS m0,
  ln(sum(l_quantity) FILTER (l_returnflag = 'N') / sum(l_quantity) FILTER (l_returnflag = 'R')) AS m1
 FROM {_PLACE} GROUP BY r_name"""),
    "draw_parts": (("geo_centers",), f"""
 SELECT o_orderkey AS draw_id, geo,
  exp(m0 + 0.3e0 * {sql_normal("'42:nat:' || o_orderkey || ':0'")} + 0.15e0 * {sql_normal("'42:' || geo || ':' || o_orderkey || ':0'")}) AS e0,
  exp(m1 + 0.3e0 * {sql_normal("'42:nat:' || o_orderkey || ':1'")} + 0.15e0 * {sql_normal("'42:' || geo || ':' || o_orderkey || ':1'")}) AS e1
 FROM orders, geo_centers"""),
    "draws": (("draw_parts",), """
 SELECT draw_id, geo, 'A' AS candidate_id, 100e0 * e0 / (e0 + e1 + 1e0) AS share FROM draw_parts
 UNION ALL SELECT draw_id, geo, 'N', 100e0 * e1 / (e0 + e1 + 1e0) FROM draw_parts
 UNION ALL SELECT draw_id, geo, 'R', 100e0 * 1e0 / (e0 + e1 + 1e0) FROM draw_parts"""),
    "nat_parts": ((), f"""
 SELECT o_orderkey AS draw_id,
  exp(m0 + 0.3e0 * {sql_normal("'42:nat:' || o_orderkey || ':0'")}) AS e0,
  exp(m1 + 0.3e0 * {sql_normal("'42:nat:' || o_orderkey || ':1'")}) AS e1
 FROM orders, (SELECT ln(sum(l_quantity) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'R')) AS m0,
   ln(sum(l_quantity) FILTER (l_returnflag = 'N') / sum(l_quantity) FILTER (l_returnflag = 'R')) AS m1 FROM lineitem)"""),
    "national_draws": (("nat_parts",), """
 SELECT draw_id, 'A' AS candidate_id, 100e0 * e0 / (e0 + e1 + 1e0) AS share FROM nat_parts
 UNION ALL SELECT draw_id, 'N', 100e0 * e1 / (e0 + e1 + 1e0) FROM nat_parts
 UNION ALL SELECT draw_id, 'R', 100e0 * 1e0 / (e0 + e1 + 1e0) FROM nat_parts"""),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the views it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {head}, {rest[10:]}"
        return f"WITH {head}, {rest}"
    return f"WITH {head} {body}"
