"""Call-graph operators over edge tables (caller, callee).

Closures run level by level: the frontier is joined with the edges, what is already known is
taken off by an anti join, and every round is materialised (checkpointed where a folder is set),
so lineage does not grow with depth. An empty frontier ends the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.functions.scalars import complexity_rank


def keep(df: DataFrame) -> DataFrame:
    """A round's rows, written where a checkpoint folder is set, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def breadth_first(roots: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, level): least number of steps from a root (whose level is given)."""
    seen = frontier = keep(roots.select(key, "level").distinct())
    step = keep(edges.select("caller", "callee").distinct())  # else every round makes the edges anew
    while True:
        reach = frontier.join(step, F.col(key) == F.col("caller")).select(F.col("callee").alias(key), (F.col("level") + 1).alias("level")).distinct()
        frontier = keep(reach.join(seen, key, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = keep(seen.unionByName(frontier))


def reachable_from(edges: DataFrame, root: str) -> DataFrame:
    """(func, level): the root and everything that it calls, directly or not."""
    start = edges.sparkSession.createDataFrame([(root, 0)], "func string, level int")
    return breadth_first(start, edges, "func")


def dynamic_call_graph(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee) pairs of a trace."""
    return calls.where("parent IS NOT NULL").select(F.col("parent").alias("caller"), F.col("uid").alias("callee")).distinct()


def mixed_call_graph(static: DataFrame, dynamic: DataFrame, root: str = "main") -> DataFrame:
    """Static and dynamic edges together, among what the root reaches."""
    both = static.select("caller", "callee").union(dynamic.select("caller", "callee")).distinct()
    known = reachable_from(both, root).select("func")
    return both.join(known.withColumnRenamed("func", "caller"), "caller", "left_semi")


def functions(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("func")).union(edges.select(F.col("callee").alias("func"))).distinct()


def back_edges(edges: DataFrame, root: str = "main") -> DataFrame:
    """Edges inside a cycle that lead to a function no further from the root."""
    near = reachable_from(edges, root)
    mine = edges.where("caller <> callee").select("caller", "callee").distinct()
    mine = mine.join(near.select(F.col("func").alias("caller"), F.col("level").alias("a")), "caller").join(near.select(F.col("func").alias("callee"), F.col("level").alias("b")), "callee")
    down = mine.where("b <= a")
    if down.isEmpty():
        return down.select("caller", "callee").union(edges.where("caller = callee").select("caller", "callee").distinct())
    # a candidate is in a cycle when its target reaches its source
    start = down.select(F.struct("callee", "caller").alias("e"), F.col("callee").alias("at")).distinct()
    seen = frontier = keep(start)
    while True:
        reach = frontier.join(mine.select(F.col("caller").alias("at"), "callee"), "at").select("e", F.col("callee").alias("at")).distinct()
        frontier = keep(reach.join(seen, ["e", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = keep(seen.unionByName(frontier))
    cyclic = seen.where("at = e.caller").select(F.col("e.caller").alias("caller"), F.col("e.callee").alias("callee"))
    return cyclic.union(edges.where("caller = callee").select("caller", "callee")).distinct()


def graph_levels(edges: DataFrame, root: str = "main") -> DataFrame:
    """(func, level): longest distance from the root, back edges left out.

    Rounds: a function gets its level when all its callers have one.
    """
    known = reachable_from(edges, root).select("func")
    forward = edges.select("caller", "callee").distinct().join(back_edges(edges, root), ["caller", "callee"], "left_anti")
    forward = keep(forward.join(known.withColumnRenamed("func", "caller"), "caller", "left_semi"))
    done = keep(edges.sparkSession.createDataFrame([(root, 0)], "func string, level int"))
    left = keep(known.where(F.col("func") != root))
    while True:
        if left.isEmpty():
            return done
        into = forward.join(left.withColumnRenamed("func", "callee"), "callee", "left_semi").join(done.select(F.col("func").alias("caller"), "level"), "caller", "left")
        ready = into.groupBy(F.col("callee").alias("func")).agg((F.max("level") + 1).alias("level"), F.count("level").alias("have"), F.count("*").alias("all"))
        ready = keep(ready.where("have = all").select("func", "level"))
        if ready.isEmpty():
            raise ValueError("functions without a level: a cycle is left")  # cannot be once back edges are gone
        done, left = keep(done.unionByName(ready)), keep(left.join(ready, "func", "left_anti"))


def leaves(edges: DataFrame) -> DataFrame:
    return functions(edges).join(edges.where("caller <> callee").select(F.col("caller").alias("func")), "func", "left_anti")


def recursive(edges: DataFrame) -> DataFrame:
    return edges.where("caller = callee").select(F.col("caller").alias("func")).distinct()


def bottom(edges: DataFrame, root: str = "main") -> DataFrame:
    """Functions all of whose calls go back up."""
    forward = edges.select("caller", "callee").distinct().join(back_edges(edges, root), ["caller", "callee"], "left_anti")
    return functions(edges).join(forward.select(F.col("caller").alias("func")), "func", "left_anti")


def top(edges: DataFrame, root: str = "main") -> DataFrame:
    """The chain of single calls from the root, and what its last function calls that nothing else among them calls."""
    forward = keep(edges.select("caller", "callee").distinct().join(back_edges(edges, root), ["caller", "callee"], "left_anti"))
    n_out = forward.groupBy("caller").agg(F.count("*").alias("k"), F.first("callee").alias("only"))
    spark = edges.sparkSession
    chain = spark.createDataFrame([(root, 0)], "func string, level int")
    single = n_out.where("k = 1").select("caller", F.col("only").alias("callee"))
    chain = breadth_first(chain, single, "func")
    last = chain.orderBy(F.desc("level")).limit(1).select("func")
    fan = forward.join(last.withColumnRenamed("func", "caller"), "caller", "left_semi").select("callee")
    inner = forward.join(fan.withColumnRenamed("callee", "caller"), "caller", "left_semi").select("callee")
    return chain.select("func").union(fan.join(inner, "callee", "left_anti").withColumnRenamed("callee", "func")).distinct()


def project_top_down(levels: DataFrame, k: int, edges: DataFrame | None = None, keep_leaf: bool = True) -> DataFrame:
    kept = levels.where(F.col("level") < k)
    return kept if keep_leaf or edges is None else kept.join(leaves(edges), "func", "left_anti")


def project_bottom_up(edges: DataFrame, levels: DataFrame, k: int, root: str = "main") -> DataFrame:
    """Functions that reach a bottom function within k - 1 calls, at most k / 2 levels away from it."""
    low = bottom(edges, root).join(levels, "func").select("func", F.col("level").alias("bottom_level"))
    seen = frontier = keep(low)
    for _ in range(k - 1):
        up = frontier.join(edges.select(F.col("callee").alias("func"), "caller"), "func").select(F.col("caller").alias("func"), "bottom_level").distinct()
        up = up.join(levels, "func").where(F.abs(F.col("level") - F.col("bottom_level")) <= k / 2).select("func", "bottom_level")
        frontier = keep(up.join(seen, ["func", "bottom_level"], "left_anti"))
        seen = keep(seen.unionByName(frontier))
    return seen.select("func").distinct()


def filter_hot_calls(stats: DataFrame, limit: int) -> DataFrame:
    return stats.where(F.col("count") > limit)


def filter_constant(stats: DataFrame, limit: int) -> DataFrame:
    """Often called functions whose time hardly varies."""
    return stats.where((F.col("count") > limit) & ((F.col("iqr") < 0.05 * F.col("median")) | (F.col("median") <= 10)))


def filter_wrappers(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Functions that only wrap: each caller calls nothing else, as often, and spends most of its time here."""
    alone = edges.groupBy("caller").agg(F.count_distinct("callee").alias("fan"))
    s = stats.select("uid", "count", "median")
    rows = edges.select("caller", "callee").distinct().join(alone, "caller")
    rows = rows.join(s.select(F.col("uid").alias("caller"), F.col("count").alias("cc"), F.col("median").alias("cm")), "caller").join(s.select(F.col("uid").alias("callee"), "count", "median"), "callee")
    good = (F.col("fan") == 1) & (F.col("cc") == F.col("count")) & (F.col("median") >= 0.8 * F.col("cm"))
    return rows.groupBy(F.col("callee").alias("func")).agg(F.bool_and(good).alias("ok")).where("ok").select("func")


def remove_filtered(edges: DataFrame, filtered: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Edges without the filtered functions that are or become leaves; others stay. Changed ones always stay."""
    drop = filtered.select("func").distinct()
    if changed is not None:
        drop = drop.join(changed.select("func"), "func", "left_anti")
    drop = keep(drop)
    while True:
        gone = keep(leaves(edges).join(drop, "func", "left_semi"))
        if gone.isEmpty():
            return edges
        edges = keep(edges.join(gone.withColumnRenamed("func", "callee"), "callee", "left_anti").select("caller", "callee"))


def filter_complexity(bounds: DataFrame, levels: DataFrame, limit: int, keep_top: int = 1) -> DataFrame:
    """(func, rank) kept: a bound above class ``limit``, or among the first levels. ``bounds``: func, bound."""
    worst = bounds.groupBy("func").agg(F.max(complexity_rank(F.col("bound"))).alias("rank"))
    return levels.join(worst, "func", "left").where((F.col("level") < keep_top) | F.col("rank").isNull() | (F.col("rank") > limit)).select("func", "rank")


SAMPLING_TOP = 2_000_000_000


def suggest_sampling(levels: DataFrame, stats: DataFrame, step: float, threshold: int, complexity: Column | None = None) -> DataFrame:
    """(func, sample): step to the power of the level, corrected where the calls miss the threshold by more than a tenth."""
    rows = levels.join(stats.select(F.col("uid").alias("func"), F.col("count").alias("calls")), "func", "left")
    base = F.pow(F.lit(float(step)), F.col("level"))
    near = F.col("calls").isNull() | F.col("calls").between(0.9 * threshold, 1.1 * threshold)
    sample = F.when(near, base).otherwise(F.greatest(F.lit(1.0), F.floor(base * F.col("calls") / threshold)))
    if complexity is not None:
        sample = F.floor(sample * F.when(complexity == "O(1)", 2.0).when(complexity == "O(n^1)", 1.5).otherwise(1.0))
    return rows.select("func", F.least(F.lit(float(SAMPLING_TOP)), F.floor(sample).cast("double")).cast("bigint").alias("sample"))


def new_functions(baseline: DataFrame, target: DataFrame) -> DataFrame:
    return functions(target).subtract(functions(baseline))


def deleted_functions(baseline: DataFrame, target: DataFrame) -> DataFrame:
    return new_functions(target, baseline)


def _neighbours(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("caller").alias("func"), F.lit("d").alias("side"), F.col("callee").alias("other")).union(edges.select("callee", F.lit("u"), "caller"))
    sets = lambda s: F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("other"))))
    return both.groupBy("func").agg(sets("u").alias("callers"), sets("d").alias("callees"))


def diff_call_graphs(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """(kind, func, renamed_from): new, deleted, renamed (same callers and callees) and modified (other callees) functions."""
    b, t = _neighbours(baseline), _neighbours(target)
    gone = b.join(t.select("func"), "func", "left_anti")
    fresh = t.join(b.select("func"), "func", "left_anti")
    number = F.row_number().over(Window.partitionBy("callers", "callees").orderBy("func"))
    renamed = fresh.withColumn("k", number).alias("f").join(gone.withColumn("k", number).alias("g"), ["callers", "callees", "k"]).select(F.col("f.func").alias("func"), F.col("g.func").alias("old"))
    both = b.alias("b").join(t.alias("t"), "func").where(F.col("b.callees") != F.col("t.callees")).select("func")
    row = lambda df, kind, old=None: df.select(F.lit(kind).alias("kind"), "func", (F.col(old) if old else F.lit(None).cast("string")).alias("renamed_from"))
    out = row(renamed, "renamed", "old")
    out = out.unionByName(row(fresh.join(renamed.select("func"), "func", "left_anti"), "new"))
    out = out.unionByName(row(gone.join(renamed.select(F.col("old").alias("func")), "func", "left_anti"), "deleted"))
    return out.unionByName(row(both, "modified"))


def diff_cfg(baseline: DataFrame, target: DataFrame, mode: str = "semistrict") -> DataFrame:
    """Functions whose blocks differ: by instruction count (soft), operations, or operations and operands (strict).

    ``blocks``: func, position, opcodes ARRAY, operands ARRAY, successors ARRAY. Operands of jumps do not count.
    """
    jump = lambda op: op.startswith("j") | op.startswith("call")
    body = {
        "soft": F.size("opcodes").cast("string"),
        "semistrict": F.sha2(F.to_json("opcodes"), 256),
        "strict": F.sha2(F.to_json(F.zip_with("opcodes", "operands", lambda op, arg: F.when(jump(op), op).otherwise(F.concat_ws(" ", op, arg)))), 256),
    }[mode]
    side = lambda df, name: df.select("func", "position", F.struct(body.alias("body"), F.sort_array("successors").alias("next")).alias(name))
    known = baseline.select("func").intersect(target.select("func"))
    both = side(baseline, "b").join(side(target, "t"), ["func", "position"], "full_outer").join(known, "func", "left_semi")
    return both.where(~F.col("b").eqNullSafe(F.col("t"))).select("func").distinct()
