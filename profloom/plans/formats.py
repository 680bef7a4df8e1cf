"""Queries over sources and sinks: texts in each input format are made from the test tables, parsed and summed.

The SQL forms take the same sums straight from the tables, so that they hold only if a format
is read back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.functions import scalars
from profloom.operators import fields, ranking, traces
from profloom.plans.catalog import E, O, P, _changes, query, rounded
from profloom.plans.sql import _CHANGES
from profloom.plans.views import EVENTS, NESTED_CALLS, ORDERS, PROFILES, nested_calls
from profloom.sources import readers, sinks


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


_C = "(amount * 100 + 1e-7)::BIGINT"


def _profiles(spark, sf_dir: str) -> DataFrame:
    """A profile file per user and day: arrays per function in the columnar layout."""
    rows = E(spark, sf_dir).groupBy("version", "tid", "uid").agg(F.sort_array(F.collect_list(F.struct("order", "amount", "structure_unit_size"))).alias("r"))
    arrays = F.create_map(F.lit("amount"), F.col("r.amount"), F.lit("structure-unit-size"), F.col("r.structure_unit_size"))
    fixed = F.create_map(F.lit("uid"), F.col("uid"), F.lit("type"), F.lit("mixed"), F.lit("location"), F.col("version"))
    pairs = rows.select("version", "tid", "uid", arrays.alias("a"), fixed.alias("f"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct(F.concat("uid", F.lit("#0")), F.col(c))))
    files = pairs.groupBy("version", "tid").agg(entry("a").alias("resources"), entry("f").alias("resource_type_map"))
    header = F.struct(F.lit("mixed").alias("type"), F.lit("app").alias("cmd"), F.col("tid").cast("string").alias("workload"))
    body = F.to_json(F.struct(F.col("version").alias("origin"), header.alias("header"), F.struct(F.lit("log").alias("name")).alias("collector_info"), "resources", "resource_type_map"))
    return files.select(F.concat_ws("/", "version", F.col("tid").cast("string")).alias("path"), F.to_timestamp("version").alias("modificationTime"), body.alias("text"))


@query(f"""SELECT version AS location, uid, 0 AS snapshot, count(*) AS n, round(sum(amount), 4) AS amount, sum(structure_unit_size) AS size FROM {EVENTS} GROUP BY version, uid""")
def profile_resources(spark, sf_dir):
    rows = readers.explode_resources(readers.parse_profiles(_profiles(spark, sf_dir)))
    return rounded(rows.groupBy("location", "uid", "snapshot").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("structure_unit_size").alias("size")))


@query(f"""SELECT version, cmd, type, workload, collector, count(*) AS n FROM (SELECT DISTINCT version, tid, 'app' AS cmd, 'mixed' AS type, tid::VARCHAR AS workload, 'log' AS collector FROM {EVENTS}) GROUP BY ALL""")
def profile_entries(spark, sf_dir):
    raw = readers.parse_profiles(_profiles(spark, sf_dir))
    entries = readers.profile_catalog(raw).withColumn("version", F.substring_index("path", "/", 1))
    return entries.groupBy("version", "cmd", "type", "workload", "collector").agg(F.count("*").alias("n"))


@query(f"""SELECT snapshot::INT AS snapshot, uid, count(*) AS n, round(sum(amount), 4) AS amount, round(sum(t), 4) AS time FROM (
  SELECT uid, amount, snapshot::DOUBLE AS t, dense_rank() OVER (PARTITION BY version, tid ORDER BY snapshot) - 1 AS snapshot FROM {EVENTS}) GROUP BY ALL""")
def legacy_resources(spark, sf_dir):
    one = E(spark, sf_dir).groupBy("version", "tid", "snapshot").agg(F.sort_array(F.collect_list(F.struct("uid", "amount"))).alias("resources"))
    snaps = F.transform(F.sort_array(F.collect_list(F.struct("snapshot", "resources"))), lambda s: F.struct(s["snapshot"].cast("string").alias("time"), s["resources"].alias("resources")))
    files = one.groupBy("version", "tid").agg(snaps.alias("snapshots"))
    texts = files.select(F.concat_ws("/", "version", F.col("tid").cast("string")).alias("path"), F.to_timestamp("version").alias("modificationTime"), F.to_json(F.struct(F.struct(F.lit("memory").alias("type")).alias("header"), "snapshots")).alias("text"))
    rows = readers.normalize_legacy(readers.parse_profiles(texts))
    return rounded(rows.groupBy("snapshot", "uid").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("snapshot_time").alias("time")))


@query(f"""SELECT version AS command, r_name || ',' || n_name AS trace, uid, count(*) AS n, sum({_C}::DOUBLE) AS amount FROM {ORDERS} GROUP BY ALL""")
def folded_stacks(spark, sf_dir):
    names = scalars.funcs(F.col("trace"))
    lines = O(spark, sf_dir).select(_text(F.col("version"), ";", F.array_join(names, ";"), ";", F.col("uid"), " ", _cents(F.col("amount"))).alias("value"))
    rows = readers.parse_folded(lines)
    return rows.groupBy("command", F.array_join(scalars.funcs(F.col("trace")), ",").alias("trace"), "uid").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(f"""SELECT tid::VARCHAR AS tid, func AS probe_id, step, count(*) AS n, sum(timestamp)::BIGINT AS timestamp, sum(length(func))::DOUBLE AS size FROM {NESTED_CALLS} GROUP BY ALL""")
def call_log(spark, sf_dir):
    rows = nested_calls(spark, sf_dir)
    value = _text(F.when(F.col("step") > 0, "i").otherwise("o"), " ", F.col("func"), " ", F.col("timestamp"), " ", F.length("func"))
    found = readers.parse_calls(rows.select(F.col("tid").cast("string").alias("tid"), value.alias("value")))
    return found.groupBy("tid", "probe_id", "step").agg(F.count("*").alias("n"), F.sum("timestamp").alias("timestamp"), F.sum("structure_unit_size").alias("size"))


@query(f"""SELECT CASE WHEN "order" % 7 = 0 THEN 9 WHEN uid = 'view' THEN 1 WHEN uid = 'error' THEN 7 WHEN uid = 'signup' THEN 2 ELSE 0 END AS record_type,
  CASE WHEN "order" % 7 <> 0 THEN uid END AS probe_id, count(*) AS n, sum(CASE WHEN "order" % 7 <> 0 THEN "order" END)::BIGINT AS timestamp,
  sum(CASE WHEN "order" % 7 <> 0 AND uid IN ('error', 'signup') THEN tid END)::BIGINT AS pid FROM {EVENTS} GROUP BY ALL""")
def trace_records(spark, sf_dir):
    e, tid, at, uid = E(spark, sf_dir), F.col("tid"), F.col("order"), F.col("uid")
    plain = lambda kind: _text(kind, " ", tid, " ", at, ";", uid)
    value = F.when(at % 7 == 0, _text(F.lit("0 x "), at, ";", uid)).when(uid == "view", plain("1")).when(uid == "error", _text("7 ", tid, " ", tid, " ", at, ";", uid))
    value = value.when(uid == "signup", _text("2 ", tid, " ", tid, " 1 ", at, ";", uid)).otherwise(plain("0"))
    rows = readers.parse_trace_records(e.select(value.alias("value")))
    return rows.groupBy("record_type", "probe_id").agg(F.count("*").alias("n"), F.sum("timestamp").alias("timestamp"), F.sum("pid").alias("pid"))


_ALLOCATIONS = f"""(SELECT CASE WHEN uid = 'error' THEN 'main' ELSE uid END AS uid, CASE WHEN uid = 'view' THEN 'free' ELSE 'malloc' END AS subtype, {_C}::DOUBLE AS amount, "order" AS address, snapshot FROM {EVENTS})"""


def _allocations(spark, sf_dir: str) -> DataFrame:
    """Allocation blocks: an event's hour as seconds, its function on top of the stack; unknown for errors."""
    e = E(spark, sf_dir)
    func = F.when(F.col("uid") == "error", "?").otherwise(F.col("uid"))
    value = _text("time ", F.col("snapshot") + 1, "\n", _cents(F.col("amount")), "B ", F.when(F.col("uid") == "view", "free").otherwise("malloc"), " ", F.col("order"), "\n", func, " 0x1 lib.c:1\nmain 0x2 main.c:9\n")
    return readers.parse_alloc_blocks(e.select(value.alias("value")), 1.0)


@query(f"""SELECT uid, subtype, snapshot, count(*) AS n, sum(amount) AS amount, sum(address)::BIGINT AS address FROM {_ALLOCATIONS} GROUP BY ALL""")
def alloc_log(spark, sf_dir):
    rows = _allocations(spark, sf_dir)
    return rows.groupBy("uid", "subtype", "snapshot").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("address").alias("address"))


@query(f"""SELECT CASE WHEN uid IN ('click', 'error') THEN 'main' WHEN uid = 'main' THEN 'main' ELSE uid END AS uid, count(*) AS n, sum(amount) AS amount FROM (
  SELECT CASE WHEN uid = 'click' THEN 'main' ELSE uid END AS uid, amount FROM {_ALLOCATIONS}) GROUP BY 1""")
def drop_allocator_frames(spark, sf_dir):
    # frames named ? keep their place in the stack, so that the block of an error names main by its source
    rows = fields.drop_allocator_frames(_allocations(spark, sf_dir), ["click", "?"], [".so"])
    return rows.groupBy("uid").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(f"""SELECT uid, count(*) AS n FROM {_ALLOCATIONS} WHERE uid NOT IN ('click', 'main') GROUP BY uid""")
def exclude_allocations(spark, sf_dir):
    return fields.exclude_allocations(_allocations(spark, sf_dir), ["click", "main"], ".so").groupBy("uid").agg(F.count("*").alias("n"))


@query(f"""SELECT uid AS func, snapshot::BIGINT AS line, dayofyear(version::DATE)::BIGINT AS "column", 'O(n^' || snapshot % 3 || ')' AS class, 'O(n^2)' AS total, count(*) AS n
  FROM (SELECT DISTINCT uid, version, snapshot FROM {EVENTS}) GROUP BY ALL""")
def bounds_report(spark, sf_dir):
    found = E(spark, sf_dir).select("uid", "version", "snapshot").distinct()
    line = _text("line ", F.col("snapshot"), " / ", F.dayofyear("version"), "\nbound n\nO(n^", F.col("snapshot") % 3, ")\n")
    texts = found.groupBy("uid", "version").agg(F.array_join(F.collect_list(line), "").alias("l"))
    report = texts.select(_text("-" * 20, "\nFunction ", F.col("uid"), "\n", F.col("l"), "Total Complexity: O(n^2)\n").alias("value"))
    return readers.parse_bounds(report).groupBy("func", "line", "column", "class", "total").agg(F.count("*").alias("n"))


@query(f"""SELECT file, subtype, count(*) AS n, sum(amount) AS amount, sum(amount * k) AS weighted FROM (SELECT version AS file,
  CASE uid WHEN 'click' THEN 'real' WHEN 'view' THEN 'user' WHEN 'error' THEN 'sys' END AS subtype, {_C}::DOUBLE + CASE WHEN uid = 'view' THEN 60 ELSE 0 END AS amount,
  row_number() OVER (PARTITION BY version, uid ORDER BY "order") AS k FROM {EVENTS}) WHERE subtype IS NOT NULL GROUP BY ALL""")
def time_output(spark, sf_dir):
    uid, cents = F.col("uid"), _cents(F.col("amount"))
    value = F.when(uid == "click", _text("real ", cents)).when(uid == "view", _text("user 1m", cents, "s")).when(uid == "error", _text("sys ", cents, "s")).otherwise("noise")
    rows = readers.parse_times(E(spark, sf_dir).select(F.col("version").alias("file"), F.col("order").alias("at"), value.alias("value")))
    return rows.groupBy("file", "subtype").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum(F.col("amount") * F.col("order")).alias("weighted"))


# sinks and the catalogue


@query(f"""SELECT result, uid || ' ' || version AS location, round(rate, 4) AS rate, 'time' AS type, 'log x' AS cmdstr FROM {_CHANGES}""")
def parse_changes(spark, sf_dir):
    null = F.lit(None).cast("string")
    rows = _changes(spark, sf_dir).select(
        "result", F.concat_ws(" ", "uid", "version").alias("location"), null.alias("from_baseline"), null.alias("to_target"), "rate", null.alias("confidence_type"), F.lit(None).cast("double").alias("confidence"),
        F.lit("time").alias("type"), F.lit("log x").alias("cmdstr"),
    )
    good, _ = sinks.parse_changes(sinks.change_lines(rows))
    return rounded(good.select("result", "location", "rate", "type", "cmdstr"))


@query(f"""SELECT uid || ';' || n_name || ';' || r_name || ' ' || trunc(amount)::BIGINT AS value, count(*) AS n FROM {ORDERS} WHERE subtype <> '5-LOW' GROUP BY 1""")
def write_folded(spark, sf_dir):
    rows = O(spark, sf_dir).withColumn("subtype", F.when(F.col("subtype") == "5-LOW", "free").otherwise(F.col("subtype")))
    return traces.folded_lines(rows).groupBy("value").agg(F.count("*").alias("n"))


@query(f"""SELECT "order", uid, amount FROM {EVENTS}""")
def table_of_resources(spark, sf_dir):
    return sinks.table_of(E(spark, sf_dir), ["order", "uid", "amount"], sort="order")


def _entries(spark, sf_dir: str) -> DataFrame:
    return P(spark, sf_dir).select("version", "profile_id", "time", "type", "cmd", F.col("profile_id").alias("path"), F.md5(F.col("profile_id").cast("binary")).alias("checksum"))


@query(f"""SELECT version, profile_id, type FROM {PROFILES}""")
def register_profile(spark, sf_dir):
    p = _entries(spark, sf_dir)
    return sinks.register_profile(p.where("type <> 'mixed'"), p.union(p.where("cmd = 'view'"))).select("version", "profile_id", "type")


@query(f"""SELECT version, profile_id FROM {PROFILES} WHERE cmd NOT IN ('click', 'view')""")
def deregister_profile(spark, sf_dir):
    p = _entries(spark, sf_dir)
    keys = p.where("cmd = 'click'").select(F.col("path").alias("key")).union(p.where("cmd = 'view'").select("checksum"))
    return sinks.deregister_profile(p, keys).select("version", "profile_id")


@query(f"""SELECT profile_id, type, count(*) OVER (PARTITION BY type) AS of_type FROM {PROFILES} WHERE version >= '2024-01-20'""")
def pending_status(spark, sf_dir):
    p = _entries(spark, sf_dir).withColumn("version", F.when(F.col("version") < "2024-01-20", F.col("version")))
    return ranking.pending_status(p).select("profile_id", "type", "of_type")


@query(f"""SELECT profile_id, cmd FROM {PROFILES} WHERE profile_id = '2024-01-03-click' UNION ALL SELECT profile_id, cmd FROM {PROFILES} WHERE md5(profile_id) = md5('2024-01-04-view')""")
def find_profile(spark, sf_dir):
    p = _entries(spark, sf_dir)
    digest = "select md5('2024-01-04-view')"
    return ranking.find_profile(p, "2024-01-03-click").union(ranking.find_profile(p, spark.sql(digest).first()[0])).select("profile_id", "cmd")


@query(f"""SELECT profile_id, row_number() OVER (ORDER BY time DESC, profile_id)::INT AS place FROM {PROFILES} QUALIFY place <= 20""")
def sort_profiles(spark, sf_dir):
    first = ranking.sort_profiles(P(spark, sf_dir)).limit(20)  # the twenty latest, as a status report shows them
    return first.select("profile_id", F.row_number().over(Window.orderBy(F.desc("time"), "profile_id")).alias("place"))
