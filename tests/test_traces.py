import random

import pytest
from pyspark.sql import functions as F

from profloom.operators import calls, graph, traces


def test_distances():
    assert traces.distance(["a", "b"], ["a", "b"]) == 0
    assert traces.distance(["a"], ["a", "b", "c"]) == 2.0
    assert traces.distance(["read_file", "x"], ["read_line", "x"]) == 0.5
    assert traces.distance([], ["a"]) == 1.0
    assert traces.distance(["a"] * 9, ["b"], 2.0) == float("inf")
    assert traces.distance(["a", "b", "c"], ["x", "y", "z"], 2.0) == float("inf")


@pytest.mark.parametrize("bound", [None, 1.0, 2.5])
def test_distances_of_many_pairs(bound):
    r = random.Random(2)
    trace = lambda: ["_".join(r.choice("abcd") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(6))]
    left, right = ([trace() for _ in range(300)] for _ in range(2))
    right[:20] = left[:20]
    one = [traces.distance(x, y) for x, y in zip(left, right, strict=True)]
    wanted = [d if bound is None or d <= bound else float("inf") for d in one]
    assert traces.distances(left, right, bound).tolist() == pytest.approx(wanted)
    assert traces.distances([], [], bound).tolist() == []


def test_trace_distance_frame(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["a", "b"], ["a", "c"]), (["a"], ["a"] * 6)], "a array<string>, b array<string>")
    assert sorted((r.distance is None, r.distance) for r in traces.trace_distance(df, "a", "b", 2.0).collect()) == [(False, 1.0), (False, 1.0), (True, None)]


@pytest.mark.parametrize("strategy", ["first-fit", "best-fit"])
def test_clusters(spark, strategy):
    rows = [(["m", "f", "a_b"],), (["m", "f", "a_c"],), (["m", "f", "x", "y", "z", "w"],), (["m", "g", "a_b"],)]
    found = traces.cluster_traces(spark.createDataFrame(rows, "t array<string>"), "t", 1.0, strategy)
    assert {",".join(r.t): r.cluster for r in found.collect()} == {"m,f,a_b": "m,f,a_b", "m,f,a_c": "m,f,a_b", "m,f,x,y,z,w": "m,f,x,y,z,w", "m,g,a_b": "m,g,a_b"}


@pytest.mark.parametrize("strategy", ["first-fit", "nearest"])
@pytest.mark.parametrize("threshold", [0.4, 1.0, 2.0])
def test_clusters_equal_one_pass(spark, strategy, threshold):
    r = random.Random(11)
    frame = lambda: "_".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 4)))
    seen = [["m", "f" + str(r.randrange(2))] + [frame() for _ in range(r.randrange(0, 5))] for _ in range(60)]
    seen += [[x if r.random() < 0.8 else frame() for x in t] for t in seen] + seen[:5] + [["m"], [], ["m", "f0", "b_a"], ["m", "f0", "a_b"]]
    wanted, pivots = {}, {}
    for t in sorted({",".join(x) for x in seen}):
        frames = next(x for x in seen if ",".join(x) == t)
        near = [(traces.distance(frames, p), p) for p in pivots.setdefault(",".join(frames[:2]), [])]
        near = [(d, p) for d, p in near if d <= threshold]
        if not near:
            pivots[",".join(frames[:2])].append(frames)
            wanted[t] = t
        elif strategy == "first-fit":
            wanted[t] = ",".join(near[0][1])
        else:
            wanted[t] = ",".join(max(near, key=lambda x: (-x[0], ",".join(x[1])))[1])
    found = traces.cluster_traces(spark.createDataFrame([(x,) for x in seen] + [(None,)], "t array<string>"), "t", threshold, strategy).collect()
    assert len(found) == len(seen)
    assert {",".join(x.t): x.cluster for x in found} == wanted
    assert len(set(wanted.values())) < len(wanted)


def random_thread(r, tid, broken):
    out, stack, t = [], [], 0
    while len(out) < 60 or stack:
        t += r.randrange(1, 5)
        if stack and (r.random() < 0.5 or len(out) >= 60):
            out.append((tid, t, -1, stack.pop()))
        else:
            stack.append("f" + str(r.randrange(4)))
            out.append((tid, t, 1, stack[-1]))
    return [x for x in out if not broken or r.random() > 0.1]


def test_windows_pair_like_a_stack(spark):
    r = random.Random(3)
    rows = [x for tid in range(8) for x in random_thread(r, tid, tid % 3 == 2)]
    records = spark.createDataFrame(rows, "tid long, timestamp long, step int, probe_id string").repartition(4)
    found = {(c.tid, c.uid, c.depth, c.begin, c.end, c.parent_begin, c.parent) for c in calls.pair_calls(records).collect()}
    wanted = set()
    for tid in range(8):
        mine = sorted((t, s, p) for i, t, s, p in rows if i == tid)
        wanted |= {(tid, *c) for c in calls.stack_fold(mine)}
    assert found == wanted
    assert {x.tid for x in calls.damaged_threads(records).collect()} <= {2, 5}


def test_strict_pairing_fails_on_damage():
    assert list(calls.stack_fold([(1, 1, "a"), (2, 1, "b"), (5, -1, "b"), (9, -1, "a")], True)) == [("b", 2, 2, 5, 1, "a"), ("a", 1, 1, 9, None, None)]
    with pytest.raises(ValueError, match="does not match"):
        list(calls.stack_fold([(1, 1, "a"), (2, -1, "b")], True))


def test_exclusive_time(spark):
    rows = [(1, 0, 1, "a"), (1, 2, 1, "b"), (1, 5, -1, "b"), (1, 6, 1, "b"), (1, 7, -1, "b"), (1, 10, -1, "a")]
    found = calls.exclusive_time(calls.pair_calls(spark.createDataFrame(rows, "tid long, timestamp long, step int, probe_id string")))
    assert sorted((r.uid, r.begin, r.amount, r.exclusive, r.has_children) for r in found.collect()) == [("a", 0, 10, 6, True), ("b", 2, 3, 3, False), ("b", 6, 1, 1, False)]


def test_usdt_pairs(spark):
    rows = [(1, 1, "s", None, 0), (1, 4, "s", None, 0), (1, 9, "s", None, 0), (1, 2, "in", "p", 1), (1, 7, "out", "p", -1)]
    found = calls.pair_usdt(spark.createDataFrame(rows, "tid long, timestamp long, probe_id string, pair_id string, step int"))
    assert sorted((r.uid, r.amount) for r in found.collect()) == [("in#out", 5), ("s#s", 3), ("s#s", 5)]


def test_processes(spark):
    rows = [(0, 1, 1, 0, 5, "p"), (0, 2, 2, 1, 6, "q"), (0, 3, 2, 1, 7, "q")]
    found = calls.process_hierarchy(spark.createDataFrame(rows, "record_type int, tid long, pid long, ppid long, timestamp long, probe_id string"))
    assert sorted((r.pid, r.level, r.children, r.threads, r.bottom) for r in found.collect()) == [(1, 0, [2], [1], False), (2, 1, [], [2, 3], True)]


@pytest.fixture
def loop(spark):
    edges = [("main", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "d"), ("a", "d"), ("x", "y")]
    return spark.createDataFrame(edges, "caller string, callee string")


def names(df):
    return sorted(r.func for r in df.collect())


def test_graph_with_cycles(loop):
    assert sorted((r.caller, r.callee) for r in graph.back_edges(loop).collect()) == [("c", "a"), ("d", "d")]
    assert {r.func: r.level for r in graph.graph_levels(loop).collect()} == {"main": 0, "a": 1, "b": 2, "c": 3, "d": 3}
    assert names(graph.leaves(loop)) == ["d", "y"]
    assert names(graph.recursive(loop)) == ["d"]
    assert names(graph.bottom(loop)) == ["c", "d", "y"]
    assert names(graph.top(loop)) == ["a", "b", "main"]


def test_remove_filtered_only_leaves(loop, spark):
    edges = loop.where("caller <> 'c' AND caller <> 'd'")
    drop = spark.createDataFrame([("d",), ("b",)], "func string")
    assert sorted((r.caller, r.callee) for r in graph.remove_filtered(edges, drop).collect()) == [("a", "b"), ("b", "c"), ("main", "a"), ("x", "y")]
    keep = spark.createDataFrame([("d",)], "func string")
    assert graph.remove_filtered(edges, drop, keep).count() == edges.count()


def test_cfg_diff_compares_all_blocks(spark):
    schema = "func string, position int, opcodes array<string>, operands array<string>, successors array<int>"
    a = spark.createDataFrame([("f", 0, ["mov", "jmp"], ["a", "1"], [1]), ("f", 1, ["ret"], [""], []), ("g", 0, ["add"], ["x"], [])], schema)
    b = spark.createDataFrame([("f", 0, ["mov", "jmp"], ["a", "2"], [1]), ("f", 1, ["leave"], [""], []), ("g", 0, ["add"], ["y"], [])], schema)
    assert [names(graph.diff_cfg(a, b, m)) for m in ("soft", "semistrict", "strict")] == [[], ["f"], ["f", "g"]]


def test_folded_lines(spark):
    frame = "struct<func:string,source:string,line:bigint>"
    df = spark.createDataFrame([([("m", None, None), ("f", None, None)], "u", "malloc", 3.0), ([], "v", "free", 1.0)], f"trace array<{frame}>, uid string, subtype string, amount double")
    assert [r.value for r in traces.folded_lines(df).collect()] == ["u;f;m 3"]
    assert [(r.stack, r.amount) for r in traces.fold_stacks(df.where("uid = 'u'")).collect()] == [("m;f;u", 3.0)]
    assert F is not None


def test_calls_are_made_once(spark):
    """Sound threads are paired, and get their exclusive time, in one pass over the records."""
    rows = [(t, 10 * t + k, s, p) for t in range(3) for k, (s, p) in enumerate([(1, "a"), (1, "b"), (-1, "b"), (1, "b"), (1, "c"), (-1, "c"), (-1, "b"), (-1, "a")])]
    records = spark.createDataFrame(rows, "tid long, timestamp long, step int, probe_id string")
    found = calls.exclusive_time(calls.pair_calls(records))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan
    of = {(r.tid, r.uid, r.depth, r.begin - 10 * r.tid): (r.amount, r.exclusive, r.has_children, r.parent) for r in found.collect()}
    one = {("a", 1, 0): (7, 3, True, None), ("b", 2, 1): (1, 1, False, "a"), ("b", 2, 3): (3, 2, True, "a"), ("c", 3, 4): (1, 1, False, "b")}
    assert of == {(t, *k): v for t in range(3) for k, v in one.items()}


def test_damaged_threads_share_a_task(spark):
    """Many small damaged threads, one without a number, next to a sound one: a stack each, also where batches end inside them."""
    rows = [(t if t else None, k, s, p) for t in range(60) for k, (s, p) in enumerate([(1, "a"), (1, "b"), (-1, "a"), (-1, "b"), (1, "c")])] + [(100, 0, 1, "a"), (100, 4, -1, "a")]
    records = spark.createDataFrame(rows, "tid long, timestamp long, step int, probe_id string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {tuple(r) for r in calls.pair_damaged(records).collect()}
        plan = calls.pair_damaged(records)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {(t or None, "a", 1, 0, 2, 2, None, None) for t in range(60)} | {(100, "a", 1, 0, 4, 4, None, None)}
    assert "FlatMapGroupsInPandas" not in plan


def test_rounds_do_not_make_the_edges_anew(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chain = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(5)], "caller string, callee string").coalesce(1)
    found = graph.reachable_from(chain.mapInArrow(count, chain.schema), "f0")
    assert sorted((r.func, r.level) for r in found.collect()) == [(f"f{i}", i) for i in range(6)]
    assert made.value == 5


def test_wrappers_need_no_exclusive_times(spark, same_as_duckdb, tmp_path, monkeypatch):
    """All that a user with one event calls only wraps; the query just pairs its calls."""
    from profloom.plans import catalog

    rows = [(i, f"2024-01-{d:02d} {h:02d}:05:00", u, k, 1.0, '{"k": 1}') for i, (u, d, h, k) in enumerate([(1, 1, 4, "view"), (2, 1, 4, "view"), (2, 2, 5, "click"), (2, 2, 6, "view"), (3, 7, 8, "error")])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    (tmp_path / "t").mkdir()
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toPandas().to_parquet(tmp_path / "t" / "events.parquet", coerce_timestamps="us")
    monkeypatch.setattr(calls, "exclusive_time", None)
    found = same_as_duckdb(catalog.QUERIES["filter_wrappers"], catalog.ORACLES["filter_wrappers"], str(tmp_path / "t"))
    assert sorted(found) == [("click-2",), ("error-3",), ("hour1-1",), ("hour2-3",), ("view-1",)]
