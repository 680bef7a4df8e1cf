"""Readers of profiler output, as DataFrame plans over text and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profloom.schema import RESOURCES, TRACE_RECORDS, conform, fields

_RAW = "map<string,string>"
_PROFILE = (
    "origin string, header struct<type:string,cmd:string,workload:string,units:map<string,string>>, collector_info struct<name:string>, postprocessors array<struct<name:string>>, "
    f"resources map<string,map<string,array<string>>>, resource_type_map map<string,{_RAW}>, global struct<time:string,resources:array<{_RAW}>>, "
    f"snapshots array<struct<time:string,resources:array<{_RAW}>>>, models array<{_RAW}>"
)


def read_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, profile_id, raw): one row per profile file; packed files (zlib under a short header) are unpacked.

    Malformed JSON gives a null ``raw``, not an error.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content", "modificationTime")

    def unpack(batches):
        import zlib

        for pdf in batches:
            texts = []
            for body in pdf["content"]:
                body = bytes(body)
                if body.lstrip()[:1] not in (b"{", b"["):
                    try:
                        body = zlib.decompress(body)
                        body = body[body.index(b"\0") + 1 :]  # header, zero byte, JSON
                    except (zlib.error, ValueError):
                        body = b""
                texts.append(body.decode("utf-8", "replace"))
            pdf["text"] = texts
            yield pdf[["path", "modificationTime", "text"]]

    return parse_profiles(files.mapInPandas(unpack, "path string, modificationTime timestamp, text string"))


def parse_profiles(texts: DataFrame) -> DataFrame:
    """(path, profile_id, modificationTime, text, raw) of profiles as JSON text."""
    return texts.select("path", F.sha1("text").alias("profile_id"), "modificationTime", "text", F.from_json("text", _PROFILE).alias("raw"))


def profile_catalog(raw: DataFrame, version: str | None = None) -> DataFrame:
    return raw.where("raw IS NOT NULL").select(
        "profile_id", F.lit(version).cast("string").alias("version"), F.col("modificationTime").alias("time"), F.col("profile_id").alias("checksum"), "path", "raw.header.type", "raw.header.units",
        "raw.header.cmd", "raw.header.workload", F.col("raw.collector_info.name").alias("collector"), F.transform("raw.postprocessors", lambda p: p["name"]).alias("postprocessors"),
    )


_NAMES = {"structure-unit-size": "structure_unit_size", "call-order": "call_order", "time": "snapshot_time"}


def _flat(rows: DataFrame) -> DataFrame:
    """Canonical resources from (profile_id, snapshot, kv): known keys as columns, others in ``extra``."""
    get = lambda k: F.try_element_at("kv", F.lit(k))
    known = ["uid", "type", "subtype", "location", "tid", "amount", "exclusive", "structure-unit-size", "call-order", "order", "address", "timestamp", "time", "trace", "snapshot"]
    parts = F.from_json(get("uid"), _RAW, {"mode": "PERMISSIVE"})
    frames = F.from_json(get("trace"), "array<map<string,string>>")
    trace = F.transform(frames, lambda f: F.struct(F.coalesce(F.try_element_at(f, F.lit("func")), F.try_element_at(f, F.lit("function"))).alias("func"), F.try_element_at(f, F.lit("source")).alias("source"), F.try_element_at(f, F.lit("line")).try_cast("bigint").alias("line")))
    is_map = F.ltrim(get("uid")).startswith("{")
    plain = rows.select(
        "profile_id", F.coalesce(F.col("snapshot"), get("snapshot").try_cast("int"), F.lit(0)).alias("snapshot"), F.when(is_map, F.array_join(F.map_values(parts), ":")).otherwise(get("uid")).alias("uid"),
        F.when(is_map, parts).alias("uid_parts"), trace.alias("trace"), F.map_filter("kv", lambda k, _: ~k.isin(*known)).alias("extra"),
        *[get(k).alias(_NAMES.get(k, k)) for k in known if k not in ("uid", "trace", "snapshot")],
    )
    numbers = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields(RESOURCES) if f.name in plain.columns and f.dataType.simpleString() in ("double", "bigint")}
    return conform(plain.withColumns(numbers), RESOURCES)


def explode_resources(raw: DataFrame) -> DataFrame:
    """Rows of the columnar layout: parallel arrays per resource type, persistent keys from the type map."""
    types = raw.where("raw IS NOT NULL").select("profile_id", F.col("raw.resources").alias("res"), F.explode("raw.resource_type_map").alias("kind", "fixed"))
    arrays = F.map_entries(F.coalesce(F.try_element_at("res", F.col("kind")), F.create_map().cast("map<string,array<string>>")))
    rows = types.withColumn("arrays", arrays).withColumn("n", F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform("arrays", lambda a: F.size(a["value"]))), F.lit(1))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    own = F.map_from_entries(F.transform("arrays", lambda a: F.struct(a["key"], F.get(a["value"], F.col("i")))))
    merged = F.map_concat(F.map_filter("fixed", lambda k, _: ~F.exists("arrays", lambda a: a["key"] == k)), own)
    return _flat(rows.select("profile_id", F.lit(None).cast("int").alias("snapshot"), merged.alias("kv")))


def normalize_legacy(raw: DataFrame) -> DataFrame:
    """Rows of the older layouts: ``global`` (snapshot 0) and ``snapshots`` (numbered by position)."""
    one = raw.where("raw.global IS NOT NULL").select("profile_id", F.lit(0).alias("snapshot"), F.col("raw.global.time").alias("t"), F.explode("raw.global.resources").alias("kv"))
    many = raw.select("profile_id", F.posexplode("raw.snapshots").alias("snapshot", "s")).select("profile_id", "snapshot", F.col("s.time").alias("t"), F.explode("s.resources").alias("kv"))
    timed = one.unionByName(many)
    kv = F.when(F.map_contains_key("kv", "time") | F.col("t").isNull(), F.col("kv")).otherwise(F.map_concat("kv", F.create_map(F.lit("time"), "t")))
    return _flat(timed.select("profile_id", "snapshot", kv.alias("kv")))


def read_folded_stacks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``cmd;f1;...;fn count`` lines: command, trace without the last frame, uid the last frame, amount."""
    return parse_folded(spark.read.text(paths))


def parse_folded(lines: DataFrame) -> DataFrame:
    lines = lines.where("trim(value) <> ''")
    m = lambda g: F.regexp_extract("value", r"^(.*)\s+(\S+)\s*$", g)
    f = F.split(m(1), ";")
    frame = lambda x: F.struct(x.alias("func"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("line"))
    rows = lines.select(f.alias("f"), m(2).try_cast("double").alias("amount"))
    return rows.select(
        F.get("f", F.lit(0)).alias("command"), F.transform(F.slice("f", 2, F.greatest(F.size("f") - 2, F.lit(0))), frame).alias("trace"), F.element_at("f", -1).alias("uid"), "amount"
    )


def read_call_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``i|o function timestamp size`` lines as begin and end records of one thread per file."""
    return parse_calls(spark.read.text(paths).select(F.input_file_name().alias("tid"), "value"))


def parse_calls(lines: DataFrame) -> DataFrame:
    """``lines``: tid, value."""
    rows = lines.select("tid", F.split(F.trim("value"), r"\s+").alias("p")).where("size(p) = 4")
    return rows.select(
        "tid", F.when(F.get("p", F.lit(0)) == "i", 1).otherwise(-1).alias("step"), F.get("p", F.lit(1)).alias("probe_id"), F.get("p", F.lit(2)).try_cast("bigint").alias("timestamp"), F.get("p", F.lit(3)).try_cast("double").alias("structure_unit_size")
    )


def parse_trace_records(lines: DataFrame) -> DataFrame:
    """``type tid [pid [ppid]] timestamp;probe`` lines; what does not fit its type becomes a CORRUPT record."""
    p = F.split(F.trim(F.substring_index("value", ";", 1)), r"\s+")
    probe = F.when(F.instr("value", ";") > 0, F.substring_index("value", ";", -1))
    kind = F.get(p, F.lit(0)).try_cast("int")
    # words before the probe by record type: processes have pid and ppid, threads have pid
    arity = F.when(kind.isin(2, 3), 5).when(kind.isin(7, 8), F.when(F.size(p) == 5, 5).otherwise(4)).when(kind.isin(0, 1, 4, 5, 6), 3)
    at = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    time = F.get(p, F.size(p) - 1).try_cast("bigint")
    ok = (F.size(p) == arity) & at(1).isNotNull() & time.isNotNull() & (F.length(probe) > 0)
    good = F.coalesce(ok, F.lit(False))
    pick = lambda c: F.when(good, c)
    rows = lines.select(
        F.when(good, kind).otherwise(9).alias("record_type"), pick(at(1)).alias("tid"), pick(F.when(F.size(p) >= 4, at(2))).alias("pid"), pick(F.when(F.size(p) == 5, at(3))).alias("ppid"),
        pick(time).alias("timestamp"), pick(probe).alias("probe_id"),
    )
    return conform(rows, TRACE_RECORDS)


def read_trace_records(spark: SparkSession, paths: str | list[str], probes: DataFrame | None = None) -> DataFrame:
    """Trace records of files; with ``probes(probe_id, step)``, each with its ordinal in sampling steps."""
    rows = parse_trace_records(spark.read.text(paths))
    if probes is None:
        return rows
    w = Window.partitionBy("tid", "probe_id").orderBy("timestamp")
    return rows.join(probes, "probe_id", "left").withColumn("sequence", (F.row_number().over(w) - 1) * F.coalesce("step", F.lit(1))).drop("step")


def parse_alloc_blocks(blocks: DataFrame, interval: float) -> DataFrame:
    """Blocks of time, ``amountB allocator address`` and stack lines, symbol names resolved."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    b = blocks.select(lines.alias("l")).where("size(l) >= 2 AND l[0] NOT LIKE 'EXIT%'")
    head = F.get("l", F.lit(1))
    frames = F.transform(F.slice("l", 3, F.size("l")), lambda s: F.struct(F.regexp_extract(s, r"^(\S+)", 1).alias("func"), F.regexp_extract(s, r"\s(\S+\.\S+)(?::\d+)?$", 1).alias("source"), F.regexp_extract(s, r":(\d+)$", 1).try_cast("bigint").alias("line")))
    time = F.regexp_extract(F.get("l", F.lit(0)), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("decimal(18,6)")
    rows = b.select(
        time.alias("t"), F.regexp_extract(head, r"^(\d+)B?", 1).try_cast("double").alias("amount"), F.regexp_extract(head, r"^\S+\s+(\S+)", 1).alias("subtype"),
        F.regexp_extract(head, r"(\d+)$", 1).try_cast("bigint").alias("address"), frames.alias("trace"),
    )
    reached = F.get(F.filter("trace", lambda f: ~f["func"].isin("?", "??", "")), F.lit(0))["func"]
    rows = rows.withColumn("uid", reached).withColumn("snapshot", F.greatest(F.ceil(F.col("t") / interval) - 1, F.lit(0)).cast("int")).withColumn("snapshot_time", F.col("t").cast("double")).drop("t")
    order = F.row_number().over(Window.partitionBy("uid").orderBy("snapshot_time", "address"))
    return conform(rows.withColumn("order", order).withColumn("type", F.lit("memory")), RESOURCES)


def read_alloc_log(spark: SparkSession, paths: str | list[str], interval: float = 0.001) -> DataFrame:
    return parse_alloc_blocks(spark.read.option("lineSep", "\n\n").text(paths), interval)


def read_bounds_report(spark: SparkSession, paths: str | list[str], ruler: str = "-" * 20) -> DataFrame:
    """(func, line, column, bound, class, total): local bounds of functions and each one's total bound."""
    return parse_bounds(spark.read.text(paths, wholetext=True))


def parse_bounds(texts: DataFrame) -> DataFrame:
    blocks = texts.select(F.explode(F.split("value", "Function ")).alias("b")).where("b RLIKE '^[A-Za-z_]'")
    func = F.regexp_extract("b", r"^([A-Za-z_][A-Za-z_0-9]*)", 1)
    found = F.regexp_extract_all("b", F.lit(r"(?s)line\s+\d+\s*/\s*\d+.*?O\([^)]*\)"), 0)
    failed = F.col("b").contains("FAILED")
    total = F.when(failed, "O(∞)").otherwise(F.regexp_extract("b", r"Total Complexity:\s*(O\([^)]*\))", 1))
    rows = blocks.select(func.alias("func"), total.alias("total"), F.explode_outer(found).alias("l"))
    e = lambda pat, g: F.regexp_extract("l", pat, g)
    return rows.select(
        "func", e(r"line\s+(\d+)", 1).try_cast("bigint").alias("line"), e(r"line\s+\d+\s*/\s*(\d+)", 1).try_cast("bigint").alias("column"),
        F.trim(e(r"(?s)line\s+\d+\s*/\s*\d+\s*(.*?)O\([^)]*\)$", 1)).alias("bound"), e(r"(O\([^)]*\))$", 1).alias("class"), "total",
    )


def read_time_output(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``real|user|sys value`` lines: amount in seconds by repetition."""
    return parse_times(spark.read.text(paths).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")).drop("file")


def parse_times(lines: DataFrame) -> DataFrame:
    """``lines``: file, at (their order), value."""
    m = lambda g: F.regexp_extract("value", r"^\s*(real|user|sys)\s+(?:(\d+)m)?([0-9.]+)s?\s*$", g)
    rows = lines.where(m(1) != "").select("file", "at", m(1).alias("subtype"), (F.coalesce(m(2).try_cast("double"), F.lit(0.0)) * 60 + m(3).try_cast("double")).alias("amount"))
    order = F.row_number().over(Window.partitionBy("file", "subtype").orderBy("at"))
    return rows.select("file", order.alias("order"), "subtype", "amount")
