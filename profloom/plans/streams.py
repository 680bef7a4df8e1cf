"""Queries that replay the event log as streams and return what their sinks hold."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.plans import sql, views
from profloom.plans.catalog import query, rounded
from profloom.plans.views import EVENTS
from profloom.streaming import ops
from profloom.tables import table

#: A time after all others: a record of it carries the watermark past the end of the log.
END = "2100-01-01 00:00:00"
HALF = "2024-01-16 00:00:00"


def workdir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _two_batches(rows: DataFrame, at: str, who: str, end: DataFrame) -> list[DataFrame]:
    """Rows before and after the middle of the log; some of the last two days before it come late, with the second batch."""
    late = (F.col(at) >= F.lit(HALF).cast("timestamp") - F.expr("INTERVAL 2 DAYS")) & (F.col(who) % 3 == 0)
    first = (F.col(at) < F.lit(HALF).cast("timestamp")) & ~late
    return [rows.where(first), rows.where(~first).unionByName(end)]


@query(f"SELECT tid, uid, depth, begin, amount, exclusive FROM {sql._EXCL}")
def stream_pair_calls(spark, sf_dir):
    records = views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id").withColumn("at", F.timestamp_micros("timestamp"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("tid"), F.lit("").alias("probe_id"), F.lit(0).cast("long").alias("timestamp"), F.lit(0).alias("step"), F.lit(END).cast("timestamp").alias("at"))
    found = ops.replay(workdir(spark), lambda r: ops.stream_pair_calls(r, late="3 days"), _two_batches(records, "at", "tid", end))
    return found.select("tid", "uid", "depth", "begin", "amount", "exclusive")


@query(f"""SELECT "order", uid, snapshot, tid, round(amount, 4) AS amount FROM {EVENTS}""")
def stream_resources(spark, sf_dir):
    base = f"{workdir(spark)}/{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = views.resources_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))
    ops.stream_resources(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(f"{base}/out").select("order", "uid", "snapshot", "tid", "amount"))


@query(f"SELECT epoch_us(date_trunc('hour', moment)) AS snapshot, uid, round(sum(amount), 4) AS amount, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def stream_snapshots(spark, sf_dir):
    rows = views.events(spark, sf_dir).select(F.col("moment").cast("timestamp").alias("at"), "uid", "tid", "amount")
    end = spark.range(1).select(F.lit(END).cast("timestamp").alias("at"), F.lit("end").alias("uid"), F.lit(-1).cast("long").alias("tid"), F.lit(0.0).alias("amount"))
    found = ops.replay(workdir(spark), lambda r: ops.stream_snapshots(r, "1 hour", late="3 days"), _two_batches(rows, "at", "tid", end))
    return rounded(found.select(F.unix_micros("snapshot").alias("snapshot"), "uid", "amount", "n"))


@query(f"SELECT tid, uid = 'error' AS corrupt, count(*) AS n FROM {EVENTS} WHERE uid <> 'error' GROUP BY ALL UNION ALL SELECT NULL, true, count(*) FROM {EVENTS} WHERE uid = 'error'")
def stream_corrupt(spark, sf_dir):
    """The log as trace lines, those of errors without their separator."""
    base = f"{workdir(spark)}/{uuid.uuid4().hex}"
    e = views.events(spark, sf_dir)
    line = F.concat_ws(" ", F.lit(0), "tid", F.concat(F.unix_micros(F.col("moment").cast("timestamp")), F.when(F.col("uid") == "error", " ").otherwise(";"), "uid"))
    e.select(line.alias("value")).write.text(f"{base}/in")
    ops.stream_corrupt(ops.stream_trace_records(spark, f"{base}/in"), f"{base}/good", f"{base}/bad", f"{base}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{base}/good").groupBy("tid").agg(F.count("*").alias("n")).select("tid", F.lit(False).alias("corrupt"), "n")
    bad = spark.read.parquet(f"{base}/bad").agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("tid"), F.lit(True).alias("corrupt"), "n")
    return good.unionByName(bad)
