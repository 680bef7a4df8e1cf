"""The canonical tables: one flat row per measured resource, fitted model, change or version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


FRAME = "struct<func:string,source:string,line:bigint>"
PROFILES = (
    "profile_id string, version string, time timestamp, checksum string, path string, type string, units map<string,string>, "
    "cmd string, workload string, collector string, postprocessors array<string>"
)
RESOURCES = (
    "profile_id string, version string, snapshot int, snapshot_time double, uid string, uid_parts map<string,string>, type string, subtype string, "
    f"location string, trace array<{FRAME}>, tid bigint, amount double, exclusive double, structure_unit_size double, call_order bigint, "
    "`order` bigint, address bigint, timestamp bigint, extra map<string,string>"
)
MODELS = (
    "profile_id string, uid string, model string, method string, r_square double, x_start double, x_end double, b0 double, b1 double, b2 double, "
    "bucket_stats array<double>, params map<string,string>"
)
CHANGES = (
    "version string, baseline_version string, cmdstr string, location string, type string, result int, from_baseline string, to_target string, rate double, "
    "rate_relative double, confidence_type string, confidence double, intervals array<struct<result:int,rate:double,x_start:double,x_end:double>>"
)
VERSIONS = "checksum string, date timestamp, author string, email string, desc string, parents array<string>"
TRACE_RECORDS = "record_type int, tid bigint, pid bigint, ppid bigint, timestamp bigint, probe_id string"
CG_EDGES = "version string, caller string, callee string"

#: Severities of a change.
SEVERITY = {
    "Unknown": -6, "NotInBaseline": -5, "TotalDegradation": -4, "SevereDegradation": -3, "Degradation": -2, "MaybeDegradation": -1, "NoChange": 0,
    "MaybeOptimization": 1, "Optimization": 2, "SevereOptimization": 3, "TotalOptimization": 4, "NotInTarget": 5,
}
#: Fields that can stand on the x axis, by priority, and on the y axis.
INDEPENDENT = ("structure_unit_size", "snapshot", "order", "call_order", "address", "timestamp", "exclusive")
DEPENDENT = ("amount",)


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with the columns of a canonical table: missing ones null, types cast, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(ddl)])


def promote_fields(df: DataFrame, keys: list[str], kind: str = "string") -> DataFrame:
    """Entries of the ``extra`` map as columns of their own."""
    return df.withColumns({k: F.try_element_at("extra", F.lit(k)).try_cast(kind) for k in keys})
