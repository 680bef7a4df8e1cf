"""The test tables seen as profile data (see SURVEY 7.3), and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profloom.tables import table

#: Sales rows before this day are the baseline, the others the target.
SPLIT_DAY = "1998-07-01"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of the event log: a profile and version per day, a function per event type."""
    return resources_of(table(spark, sf_dir, "events"))


def resources_of(e: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        day.alias("profile_id"), day.alias("version"), F.hour("ts").alias("snapshot"), F.col("event_type").alias("uid"), F.col("user_id").alias("tid"),
        F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("double").alias("structure_unit_size"), F.col("event_id").alias("order"), F.col("ts").alias("moment"),
    )


EVENTS = """(SELECT strftime(ts, '%Y-%m-%d') AS profile_id, strftime(ts, '%Y-%m-%d') AS version, hour(ts)::INT AS snapshot, event_type AS uid, user_id AS tid, value AS amount,
  json_extract_string(props, '$.k')::DOUBLE AS structure_unit_size, event_id AS "order", ts AS moment FROM events)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of the line items: a function per part type, cost by quantity, baseline or target by day."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("uid"))
    side = F.when(F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz"), "baseline").otherwise("target")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, "l_partkey")
        .select(
            side.alias("profile_id"), "uid", F.col("l_returnflag").alias("location"), F.col("l_quantity").alias("structure_unit_size"),
            F.col("l_extendedprice").alias("amount"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order"),
        )
    )


SALES = f"""(SELECT CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DAY}' THEN 'baseline' ELSE 'target' END AS profile_id, p_type AS uid, l_returnflag AS location,
  l_quantity AS structure_unit_size, l_extendedprice AS amount, l_orderkey * 8 + l_linenumber AS "order" FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of the orders: trace region, nation; function the market segment; a version per year."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    frame = lambda c: F.struct(F.col(c).alias("func"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("line"))
    year = F.year("o_orderdate").cast("string")
    return joined.select(
        year.alias("profile_id"), year.alias("version"), F.col("c_mktsegment").alias("uid"), F.array(frame("r_name"), frame("n_name")).alias("trace"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("subtype"),
    )


ORDERS = """(SELECT year(o_orderdate)::VARCHAR AS profile_id, year(o_orderdate)::VARCHAR AS version, c_mktsegment AS uid, r_name || ',' || n_name AS trace, r_name, n_name,
  o_totalprice AS amount, o_orderkey AS "order", o_orderpriority AS subtype FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per day of the event log, its parent the day before."""
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("checksum")).distinct()
    parent = F.date_format(F.date_sub(F.to_date("checksum"), 1), "yyyy-MM-dd")
    known = days.select(F.col("checksum").alias("parent"))
    linked = days.withColumn("parent", parent).join(known.withColumn("has", F.lit(True)), "parent", "left")
    return linked.select("checksum", F.to_timestamp("checksum").alias("date"), F.when(F.col("has"), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("parents"))


VERSIONS = """(WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS checksum, date_trunc('day', ts)::DATE AS day FROM events)
  SELECT a.checksum, a.day::TIMESTAMP AS date, b.checksum AS parent FROM d a LEFT JOIN d b ON b.day = a.day - 1)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue entry per day and event type: what a day's log would be stored as."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("uid").isin("click", "view"), "time").when(F.col("uid") == "error", "memory").otherwise("mixed")
    found = e.select("version", "uid", kind.alias("type"), "moment").groupBy("version", "uid", "type").agg(F.max("moment").alias("time"))
    return found.select(
        F.concat_ws("-", "version", "uid").alias("profile_id"), "version", "time", "type", F.col("uid").alias("cmd"), F.lit("log").alias("workload"), F.lit("events").alias("collector"),
        F.when(F.dayofmonth("time") % 2 == 0, F.array(F.lit("filter"), F.lit("fit"))).otherwise(F.array(F.lit("filter"))).alias("postprocessors"),
    )


PROFILES = f"""(SELECT version || '-' || uid AS profile_id, version, max(moment) AS time, CASE WHEN uid IN ('click', 'view') THEN 'time' WHEN uid = 'error' THEN 'memory' ELSE 'mixed' END AS type,
  uid AS cmd, 'log' AS workload, 'events' AS collector, CASE WHEN day(max(moment)) % 2 = 0 THEN ['filter', 'fit'] ELSE ['filter'] END AS postprocessors FROM {EVENTS} GROUP BY version, uid)"""


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace records: each user's events of a type begin and end calls in turn; unfinished calls are left out."""
    e = events(spark, sf_dir)
    w = Window.partitionBy("tid", "uid").orderBy("moment", "order")
    e = e.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("tid", "uid")))
    e = e.where("k < n OR n % 2 = 0")
    return e.select("tid", F.col("uid").alias("probe_id"), (F.unix_micros(F.col("moment").cast("timestamp"))).alias("timestamp"), "order", F.when(F.col("k") % 2 == 1, 1).otherwise(-1).alias("step"))


CALL_RECORDS = f"""(SELECT tid, uid AS probe_id, epoch_us(moment) AS timestamp, "order", CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END AS step FROM (
  SELECT *, row_number() OVER (PARTITION BY tid, uid ORDER BY moment, "order") AS k, count(*) OVER (PARTITION BY tid, uid) AS n FROM {EVENTS}) WHERE k < n OR n % 2 = 0)"""


def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed begin and end records: a user's day is one call, its hours and then its events are calls inside."""
    e = events(spark, sf_dir).select("tid", "version", "snapshot", "uid", "order", F.unix_micros(F.col("moment").cast("timestamp")).alias("t"))
    day = e.groupBy("tid", "version").agg((F.min("t") - 2).alias("lo"), (F.max("t") + 12).alias("hi")).select("tid", F.lit("day").alias("func"), "lo", "hi")
    hour = e.groupBy("tid", "version", "snapshot").agg((F.min("t") - 1).alias("lo"), (F.max("t") + 11).alias("hi")).select("tid", F.concat(F.lit("hour"), (F.col("snapshot") % 3).cast("string")).alias("func"), "lo", "hi")
    event = e.groupBy("tid", "t").agg(F.min("uid").alias("func")).select("tid", "func", F.col("t").alias("lo"), (F.col("t") + 10).alias("hi"))
    calls = day.union(hour).union(event)
    ends = F.array(*[F.struct(F.col(c).alias("timestamp"), F.lit(step).alias("step")) for c, step in (("lo", 1), ("hi", -1))])
    return calls.select("tid", "func", F.explode(ends).alias("r")).select("tid", "func", "r.timestamp", "r.step")


NESTED_CALLS = f"""(WITH e AS (SELECT tid, version, snapshot, uid, epoch_us(moment) AS t FROM {EVENTS}), c AS (
  SELECT tid, 'day' AS func, min(t) - 2 AS lo, max(t) + 12 AS hi FROM e GROUP BY tid, version UNION ALL
  SELECT tid, 'hour' || (snapshot % 3), min(t) - 1, max(t) + 11 FROM e GROUP BY tid, version, snapshot UNION ALL
  SELECT tid, min(uid), t, t + 10 FROM e GROUP BY tid, t)
  SELECT tid, func, lo AS timestamp, 1 AS step FROM c UNION ALL SELECT tid, func, hi, -1 FROM c)"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call graph of the orders per year: region calls nation calls segment; ``main`` calls regions."""
    o = orders(spark, sf_dir).select("version", F.col("trace")[0]["func"].alias("r"), F.col("trace")[1]["func"].alias("n"), "uid").distinct()
    edge = lambda a, b: F.struct(a.alias("caller"), b.alias("callee"))
    pairs = F.array(edge(F.coalesce(F.lit("main"), F.col("r")), F.col("r")), edge(F.col("r"), F.col("n")), edge(F.col("n"), F.col("uid")))
    return o.select("version", F.explode(pairs).alias("e")).select("version", "e.caller", "e.callee").distinct()


CALL_EDGES = f"""(SELECT version, 'main' AS caller, r_name AS callee FROM {ORDERS} UNION SELECT version, r_name, n_name FROM {ORDERS} UNION SELECT version, n_name, uid FROM {ORDERS})"""
