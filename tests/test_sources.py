import json
import zlib

import pytest
from pyspark.sql import functions as F

from profloom.operators import fields, joins, nonparam, windows
from profloom.schema import promote_fields
from profloom.sources import readers, sinks
from profloom.streaming import ops

PROFILE = {
    "header": {"type": "time", "cmd": "app", "workload": "w", "units": {"time": "ms"}}, "collector_info": {"name": "trace"}, "postprocessors": [{"name": "fit"}],
    "resources": {"f#0": {"amount": [1, 2, 3], "structure-unit-size": [10, 20, 30], "color": [7, 8, 9]}, "g#0": {}},
    "resource_type_map": {
        "f#0": {"uid": "f", "type": "mixed", "time": "0.5", "snapshot": 2, "trace": [{"func": "main"}, {"function": "f", "source": "f.c", "line": 3}]},
        "g#0": {"uid": {"function": "g", "source": "g.c"}, "type": "mixed", "amount": 5, "location": "lib"},
    },
}


@pytest.fixture
def folder(tmp_path):
    text = json.dumps(PROFILE)
    (tmp_path / "a.perf").write_text(text)
    (tmp_path / "b.perf").write_bytes(zlib.compress(b"profile 1\0" + text.replace('"app"', '"packed"').encode()))
    (tmp_path / "c.perf").write_text("{broken")
    old = {"header": {"type": "memory"}, "global": {"time": "1.5", "resources": [{"uid": "h", "amount": 4}]}}
    (tmp_path / "d.perf").write_text(json.dumps(old))
    snaps = {"header": {"type": "memory"}, "snapshots": [{"time": "0.1", "resources": [{"uid": "s", "amount": 1}]}, {"time": "0.2", "resources": [{"uid": "s", "amount": 2}]}]}
    (tmp_path / "e.perf").write_text(json.dumps(snaps))
    return str(tmp_path)


def test_profiles(spark, folder):
    raw = readers.read_profiles(spark, f"{folder}/*.perf").cache()
    assert raw.count() == 5
    catalog = readers.profile_catalog(raw).where("cmd IS NOT NULL")
    assert sorted((r.cmd, r.collector, r.postprocessors) for r in catalog.collect()) == [("app", "trace", ["fit"]), ("packed", "trace", ["fit"])]
    rows = readers.explode_resources(raw.where("path LIKE '%a.perf'"))
    found = sorted((r.uid, r.amount, r.structure_unit_size, r.snapshot, r.snapshot_time, r.location) for r in rows.collect())
    assert found == [("f", 1.0, 10.0, 2, 0.5, None), ("f", 2.0, 20.0, 2, 0.5, None), ("f", 3.0, 30.0, 2, 0.5, None), ("g:g.c", 5.0, None, 0, None, "lib")]
    f = rows.where("uid = 'f'")
    assert sorted(r.color for r in promote_fields(f, ["color"], "int").collect()) == [7, 8, 9]
    assert [tuple(x) for x in f.first().trace] == [("main", None, None), ("f", "f.c", 3)]
    old = sorted((r.uid, r.amount, r.snapshot, r.snapshot_time) for r in readers.normalize_legacy(raw).collect())
    assert old == [("h", 4.0, 0, 1.5), ("s", 1.0, 0, 0.1), ("s", 2.0, 1, 0.2)]


def test_text_formats(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    folded = readers.read_folded_stacks(spark, write("s", "cmd;a;b;c 12\n\ncmd;x 3\n"))
    assert sorted((r.command, [f.func for f in r.trace], r.uid, r.amount) for r in folded.collect()) == [("cmd", [], "x", 3.0), ("cmd", ["a", "b"], "c", 12.0)]
    log = readers.read_call_log(spark, write("l", "i f 1 10\ni g 2 20\no g 5 20\no f 9 10\nbad\n"))
    assert sorted((r.step, r.probe_id, r.timestamp, r.structure_unit_size) for r in log.collect()) == [(-1, "f", 9, 10.0), (-1, "g", 5, 20.0), (1, "f", 1, 10.0), (1, "g", 2, 20.0)]
    records = readers.read_trace_records(spark, write("r", "7 15 15 14 1519;tst\n0 15 1815;frame\n0 x 1;f\n0 15 18;\n1 15\n42 1 2;f\n"))
    assert sorted(map(tuple, records.collect()), key=str) == sorted([(7, 15, 15, 14, 1519, "tst"), (0, 15, None, None, 1815, "frame"), *[(9, None, None, None, None, None)] * 4], key=str)
    times = readers.read_time_output(spark, write("t", "real 1.5\nuser 0m0.25s\nnoise\nsys 0.1\nreal 2m1.0s\n"))
    assert sorted((r.order, r.subtype, r.amount) for r in times.collect()) == [(1, "real", 1.5), (1, "sys", 0.1), (1, "user", 0.25), (2, "real", 121.0)]
    report = "Function f\nline 3 / 5\nbound n\nO(n^1)\nline 7 / 1\nbound 1\nO(1)\nTotal Complexity: O(n^1)\n-----\nFunction g\nFAILED\n"
    bounds = readers.read_bounds_report(spark, write("b", report))
    assert sorted((r.func, r.line, r["class"], r.total) for r in bounds.where("func = 'f'").collect()) == [("f", 3, "O(n^1)", "O(n^1)"), ("f", 7, "O(1)", "O(n^1)")]
    assert bounds.where("func = 'g'").first().total == "O(∞)"
    blocks = "time 0.0015\n32B malloc 4096\nmalloc 0x1 lib.c:1\nmain 0x2 main.c:9\n\ntime 0.0001\n16B free 4096\n? 0x1\nmain 0x2 main.c:9\n\nEXIT 1\n"
    allocs = readers.read_alloc_log(spark, write("m", blocks), 0.001)
    assert sorted((r.uid, r.amount, r.subtype, r.address, r.snapshot) for r in allocs.collect()) == [("main", 16.0, "free", 4096, 0), ("malloc", 32.0, "malloc", 4096, 1)]
    kept = fields.drop_allocator_frames(allocs, ["malloc"], [".so"])
    assert {r.uid for r in kept.where("amount = 32").collect()} == {"main"}
    assert {r.uid for r in fields.exclude_allocations(allocs, ["malloc"], ".h").collect()} == {"main"}


def test_catalog_updates(spark):
    t = "version string, path string, time string, checksum string"
    old = spark.createDataFrame([("v", "p", "1", "c1"), ("v", "q", "1", "c2")], t)
    new = spark.createDataFrame([("v", "p", "1", "c9"), ("v", "p", "2", "c3"), ("v", "p", "2", "c4")], t)
    assert sinks.register_profile(old, new).count() == 3
    assert [r.path for r in sinks.deregister_profile(old, spark.createDataFrame([("c1",), ("zz",)], "key string")).collect()] == ["q"]


def test_change_lines_round_trip(spark):
    schema = "result string, location string, from_baseline string, to_target string, rate double, confidence_type string, confidence double, type string, cmdstr string"
    rows = [("Degradation", "f", "linear", "power", 2.5, "r_square", 0.9, "model", "app x"), ("Optimization", "g h", None, None, -1.0, None, None, "time", None)]
    lines = sinks.change_lines(spark.createDataFrame(rows, schema))
    good, bad = sinks.parse_changes(lines.union(spark.createDataFrame([("nonsense",), ("Weird at f (a -> b): 1% by x",)], "value string")))
    assert sorted(map(tuple, good.collect()), key=str) == sorted(rows, key=str)
    assert bad.count() == 2


def test_write_and_stats(spark, tmp_path):
    df = spark.createDataFrame([("v1", "f", 1.0), ("v2", "g", 2.0)], "version string, uid string, amount double")
    sinks.write_resources(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("version = 'v2'").count() == 1
    m = "version string, name string, stat_id string, value map<string,int>"
    a, b = spark.createDataFrame([("v", "n", "s", {"x": 1, "y": 2})], m), spark.createDataFrame([("v", "n", "s", {"y": 3}), ("v", "n", "t", {"z": 4})], m)
    assert {r.stat_id: r.value for r in sinks.update_stats(a, b).collect()} == {"s": {"x": 1, "y": 3}, "t": {"z": 4}}
    assert {r.stat_id: r.value for r in sinks.save_stats(a, b).collect()} == {"s": {"y": 3}, "t": {"z": 4}}
    assert sinks.delete_stats(b, a).count() == 1
    rows = df.withColumn("profile_id", F.lit("p"))
    assert sinks.content_checksum(rows).first() == sinks.content_checksum(rows.orderBy(F.desc("uid"))).first()


def test_locations_match_by_name(spark):
    side = lambda *names: spark.createDataFrame([(n,) for n in names], "location string")
    found = joins.match_locations(side("libc-2.31.so", "app", "xyz"), side("libc-2.35.so", "app", "other"))
    assert [tuple(r) for r in found.collect()] == [("libc-2.31.so", "libc-2.35.so", "libc-2.3")]


def test_windows_against_pandas(spark):
    import pandas as pd

    ys = [float((i * 37) % 23) for i in range(60)]
    df = spark.createDataFrame([("f", i, y) for i, y in enumerate(ys)], "uid string, x int, y double")
    run = lambda **k: [r.average for r in windows.moving_average(df, "uid", x="x", y="y", **k).orderBy("x").collect()]
    same = lambda a, b: all((x is None and pd.isna(y)) or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    s = pd.Series(ys)
    for w in (3, 4, 7, 8):
        assert same(run(window=w), s.rolling(w, center=True).mean())
        assert same(run(window=w, method="smm", center=False), s.rolling(w).median())
    assert same(run(window=3, method="ema", alpha=0.5), s.ewm(alpha=0.5, min_periods=3).mean())
    assert same(run(window=3, method="ema", alpha=0.01), s.ewm(alpha=0.01, min_periods=3).mean())
    assert windows.ema_alpha(span=3) == 0.5 and windows.ema_alpha(com=1) == 0.5
    with pytest.raises(ValueError, match="decay"):
        windows.ema_alpha(alpha=2.0)
    assert sum(windows.weights("hamming", 5)) == pytest.approx(2.24)
    assert windows.auto_window(df, "uid", x="x", y="y").first().width >= 1


def test_banded_pairs_need_no_nested_loop(spark):
    df = spark.createDataFrame([("f", float(i), float(i * i)) for i in range(40)], "uid string, structure_unit_size double, amount double")
    sizes = nonparam.distinct_sizes(df, "uid")
    banded = joins.self_pairs(sizes.withColumn("y", F.col("sy")), "uid", width=2.0)
    assert {(r.xi, r.xj) for r in banded.collect()} == {(float(i), float(j)) for i in range(40) for j in range(40) if abs(i - j) <= 2}
    assert "NestedLoop" not in banded._jdf.queryExecution().executedPlan().toString()
    line = nonparam.kernel_estimate(nonparam.distinct_sizes(df.withColumn("amount", 3 * F.col("structure_unit_size")), "uid"), "uid", h=4.0, order=1)
    assert all(abs(r.estimate - 3 * r.x) < 1e-6 for r in line.collect())


def test_stream_splits_corrupt_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0 1 5;f\nbad line\n1 1 9;f\n")
    kept: dict[str, int] = {"good": 0, "bad": 0}
    count = lambda k: lambda df, _: kept.__setitem__(k, kept[k] + df.count())
    stream = ops.stream_trace_records(spark, str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(ops.split_corrupt(count("good"), count("bad"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert kept == {"good": 2, "bad": 1}


def test_stream_snapshots(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, 0, m), "f", 1.0) for m in (0, 3, 12)]
    spark.createDataFrame(rows, "at timestamp, uid string, amount double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, uid string, amount double").parquet(str(tmp_path / "in"))
    query = ops.stream_snapshots(stream, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("snaps").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.snapshot.minute, r.amount, r.n) for r in spark.sql("SELECT * FROM snaps").collect()) == [(0, 2.0, 2), (10, 1.0, 1)]
