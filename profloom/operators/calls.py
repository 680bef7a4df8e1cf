"""Trace records to calls: pairing, exclusive time, spans.

Well-formed threads need no state: a running sum of +1 and -1 is the depth, and at one depth
of a thread begins and ends alternate. Threads that are damaged (a negative depth, an end that
does not match, an open end) are found by aggregates and only they go to a stack per thread.
"""

from __future__ import annotations

from itertools import groupby, islice
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators.graph import breadth_first, keep

#: Record types of the raw trace format.
FUNC_BEGIN, FUNC_END, USDT_SINGLE, USDT_BEGIN, USDT_END, THREAD_BEGIN, THREAD_END, PROCESS_BEGIN, PROCESS_END, CORRUPT = 0, 1, 4, 5, 6, 7, 8, 2, 3, 9

#: Rows of a batch that a task hands back.
_ROWS = 10_000

_CALL = "tid {tid}, uid string, depth int, begin bigint, end bigint, amount bigint, parent_begin bigint, parent string"


def _depths(records: DataFrame) -> DataFrame:
    """Records with their call's depth, from 1; ends before begins at one instant."""
    line = Window.partitionBy("tid").orderBy("timestamp", "step", "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("step").over(line)
    return records.withColumn("depth", F.when(F.col("step") > 0, run).otherwise(run + 1).cast("int"))


def damaged_threads(records: DataFrame) -> DataFrame:
    """Threads whose begins and ends do not nest."""
    deep = _depths(records)
    level = Window.partitionBy("tid", "depth").orderBy("timestamp", "step", "probe_id")
    last = F.lag("probe_id").over(level)
    bad = (F.col("depth") < 1) | ((F.col("step") < 0) & ~F.coalesce((last == F.col("probe_id")) & (F.lag("step").over(level) > 0), F.lit(False)))
    marked = deep.withColumn("bad", bad).groupBy("tid").agg(F.max("bad").alias("bad"), F.sum("step").alias("left"))
    return marked.where("bad OR left <> 0").select("tid")


def _pair_nested(records: DataFrame) -> DataFrame:
    """Calls of well-formed threads: (tid, uid, depth, begin, end, amount, parent_begin, parent).

    All windows are parts of a thread, so the records are shuffled once. The first call inside
    another one stands right behind the begin of its parent; its later siblings, at the same
    depth, take over what the first has found.
    """
    line = Window.partitionBy("tid").orderBy("timestamp", "step", "probe_id")
    level = Window.partitionBy("tid", "depth").orderBy("timestamp", "step", "probe_id")
    before = F.struct(F.lag("timestamp").over(line).alias("b"), F.lag("probe_id").over(line).alias("u"))
    deep = _depths(records).withColumn("up", F.when((F.col("step") > 0) & (F.lag("step").over(line) > 0), before))
    deep = deep.withColumn("end", F.lead("timestamp").over(level)).withColumn("p", F.last("up", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    return deep.where("step > 0").select(
        "tid", F.col("probe_id").alias("uid"), "depth", F.col("timestamp").alias("begin"), "end", (F.col("end") - F.col("timestamp")).alias("amount"), F.col("p.b").alias("parent_begin"), F.col("p.u").alias("parent")
    )


def stack_fold(rows, strict: bool = False):
    """Calls of one thread's (timestamp, step, probe) records in order, with a stack.

    Tolerant: an end closes the nearest open begin of its probe and drops what is open above
    it, an end without begin is ignored, calls left open at the end of the trace are dropped.
    Yields (uid, depth, begin, end, parent_begin, parent).
    """
    stack: list[tuple[str, int]] = []
    for timestamp, step, probe in rows:
        if step > 0:
            stack.append((probe, timestamp))
            continue
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == probe), None)
        if strict and at != len(stack) - 1:
            raise ValueError(f"end of {probe} at {timestamp} does not match the open call")
        if at is not None:
            begin = stack[at][1]
            parent = stack[at - 1] if at else (None, None)
            del stack[at:]
            yield probe, at + 1, begin, timestamp, parent[1], parent[0]
    if strict and stack:
        raise ValueError(f"{len(stack)} calls were never closed")


def pair_damaged(records: DataFrame, strict: bool = False) -> DataFrame:
    """Calls by a stack per thread, over records sorted by thread and time."""
    kind = records.schema["tid"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        calls = ((tid, u, d, b, e, e - b, pb, p) for tid, own in groupby(rows, itemgetter(0)) for u, d, b, e, pb, p in stack_fold((r[1:] for r in own), strict))
        while some := list(islice(calls, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(_CALL.format(tid=kind)))
    order = [F.col(c).asc_nulls_last() for c in ("timestamp", "step", "probe_id")]
    return records.select("tid", "timestamp", "step", "probe_id").repartition("tid").sortWithinPartitions("tid", *order).mapInArrow(run, _CALL.format(tid=kind))


def pair_calls(records: DataFrame, strict: bool = False) -> DataFrame:
    """(tid, uid, depth, begin, end, amount, parent_begin, parent) of (tid, timestamp, step, probe_id) records.

    Which threads are damaged is settled once, before the calls are paired; where all are sound
    nothing is joined and the records are read only once more.
    """
    bad = keep(damaged_threads(records))
    if bad.isEmpty():
        return _pair_nested(records)
    good = _pair_nested(records.join(bad, "tid", "left_anti"))
    return good.unionByName(pair_damaged(records.join(bad, "tid", "left_semi"), strict))


def exclusive_time(calls: DataFrame) -> DataFrame:
    """Calls with exclusive time: inclusive minus what direct callees took; and whether they call anything.

    A call also gives its time to the place (thread, depth, begin) of its caller, where a window
    adds up, so that the calls are made once and not joined with themselves.
    """
    place = lambda depth, begin, inner: F.struct(depth.alias("depth"), F.col(begin).alias("begin"), inner.alias("inner"))
    own, given = place(F.col("depth"), "begin", F.lit(None).cast("bigint")), place(F.col("depth") - 1, "parent_begin", F.col("amount").cast("bigint"))
    rows = calls.withColumn("_at", F.explode(F.array_compact(F.array(own, F.when(F.col("parent_begin").isNotNull(), given)))))
    rows = rows.withColumns({"_depth": F.col("_at.depth"), "_begin": F.col("_at.begin"), "_inner": F.col("_at.inner")}).drop("_at")
    inner = F.sum("_inner").over(Window.partitionBy("tid", "_depth", "_begin"))
    joined = rows.withColumn("_sum", inner).where(F.col("_inner").isNull())
    joined = joined.withColumn("exclusive", F.col("amount") - F.coalesce("_sum", F.lit(0))).withColumn("has_children", F.col("_sum").isNotNull())
    return joined.drop("_depth", "_begin", "_inner", "_sum")


def pair_usdt(records: DataFrame) -> DataFrame:
    """Static probes: single ones by consecutive hits, others by begin and end; uid ``a#b``.

    ``records``: tid, timestamp, probe_id, pair_id (null: single), step (+1, -1; 0: single).
    """
    w = Window.partitionBy("tid", "probe_id").orderBy("timestamp")
    single = records.where("pair_id IS NULL").withColumn("begin", F.lag("timestamp").over(w)).where("begin IS NOT NULL")
    single = single.select("tid", F.concat_ws("#", "probe_id", "probe_id").alias("uid"), "begin", F.col("timestamp").alias("end"))
    p = Window.partitionBy("tid", "pair_id").orderBy("timestamp")
    paired = records.where("pair_id IS NOT NULL")
    paired = paired.withColumns({"end": F.lead("timestamp").over(p), "to": F.lead("probe_id").over(p), "next": F.lead("step").over(p)}).where("step > 0 AND next < 0")
    paired = paired.select("tid", F.concat_ws("#", "probe_id", "to").alias("uid"), F.col("timestamp").alias("begin"), "end")
    return single.unionByName(paired).withColumn("amount", F.col("end") - F.col("begin"))


def spans(records: DataFrame, begin: int, end: int, key: str) -> DataFrame:
    side = lambda t, name: records.where(F.col("record_type") == t).groupBy(key, "probe_id").agg((F.min if t == begin else F.max)("timestamp").alias(name))
    return side(begin, "begin").join(side(end, "end"), [key, "probe_id"]).withColumn("amount", F.col("end") - F.col("begin"))


def thread_spans(records: DataFrame) -> DataFrame:
    return spans(records, THREAD_BEGIN, THREAD_END, "tid")


def process_spans(records: DataFrame, binaries: list[str]) -> DataFrame:
    """Durations of the processes of the given binaries."""
    return spans(records, PROCESS_BEGIN, PROCESS_END, "pid").where(F.col("probe_id").isin(*binaries))


def process_hierarchy(records: DataFrame) -> DataFrame:
    """(pid, ppid, level, children, threads, bottom) of the processes of a trace, roots at level 0."""
    procs = records.where("pid IS NOT NULL").groupBy("pid").agg(F.max("ppid").alias("ppid"), F.sort_array(F.collect_set("tid")).alias("threads"))
    kids = procs.groupBy(F.col("ppid").alias("pid")).agg(F.sort_array(F.collect_set("pid")).alias("children"))
    roots = procs.join(procs.select(F.col("pid").alias("ppid")), "ppid", "left_anti").select("pid", F.lit(0).alias("level"))
    level = breadth_first(roots, procs.select(F.col("ppid").alias("caller"), F.col("pid").alias("callee")), "pid")
    found = procs.join(kids, "pid", "left").join(level, "pid", "left")
    return found.select("pid", "ppid", "level", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), "threads", F.col("children").isNull().alias("bottom"))
