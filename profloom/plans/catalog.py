"""Every query of the core library by name, and its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profloom import schema
from profloom.functions import scalars
from profloom.operators import aggregates, calls, checks, fields, graph, joins, models, nonparam, ranking, traces, windows
from profloom.plans import sql, views
from profloom.sources import sinks

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

E, S, O, V, P = views.events, views.sales, views.orders, views.versions, views.profiles


def query(oracle: str | None = None):
    """Register a function under its own name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql.off_ties(oracle)
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`") + sql.NUDGE, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def sides(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = S(spark, sf_dir)
    return rows.where("profile_id = 'baseline'").drop("profile_id"), rows.where("profile_id = 'target'").drop("profile_id")


def fits(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = models.fit_all(S(spark, sf_dir), "profile_id", "uid").cache()  # a row per function and kind
    return rows.where("profile_id = 'baseline'").drop("profile_id"), rows.where("profile_id = 'target'").drop("profile_id")


# aggregates


def _aggregate(name: str, func: str, of: str, per: str, by: str) -> None:
    def run(spark, sf_dir):
        return rounded(aggregates.aggregate_by(E(spark, sf_dir), func, of, per, by))

    QUERIES[name], ORACLES[name] = run, sql.off_ties(sql.aggregate(func, of, per, by))


_aggregate("agg_sum_per_version", "sum", "amount", "uid", "version")
_aggregate("agg_mean", "mean", "amount", "uid", "snapshot")
_aggregate("agg_median", "median", "amount", "uid", "version")
_aggregate("agg_nunique", "nunique", "tid", "uid", "version")
_aggregate("agg_count", "count", "amount", "tid", "uid")


@query(sql.MIN_MAX_COUNT)
def agg_min_max_count(spark, sf_dir):
    return E(spark, sf_dir).groupBy("version", "uid").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count("*").alias("n"))


@query(sql.FLOW)
def flow_dense(spark, sf_dir):
    return rounded(aggregates.flow(E(spark, sf_dir), "sum", "amount", "snapshot", "tid"))


@query(sql.FLOW_ACCUMULATED)
def flow_accumulated(spark, sf_dir):
    dense = aggregates.flow(E(spark, sf_dir), "sum", "amount", "snapshot", "uid")
    return rounded(windows.accumulate_flow(dense))


@query(sql.MEAN_AMOUNT)
def mean_amount_by_uid(spark, sf_dir):
    return rounded(aggregates.mean_amount_by_uid(E(spark, sf_dir), "version"))


@query(sql.TRACE_TOTALS)
def trace_totals(spark, sf_dir):
    rows = O(spark, sf_dir).withColumn("trace", F.array_join(scalars.funcs(F.col("trace")), ","))
    return rounded(aggregates.trace_totals(rows), 2)


@query(sql.FUNCTION_STATS)
def function_stats(spark, sf_dir):
    return rounded(aggregates.function_stats(E(spark, sf_dir).withColumn("sample", F.lit(3)), "version", sample="sample", exclusive="amount"))


@query(sql.FUNCTION_STATS_LEVELS)
def function_stats_levels(spark, sf_dir):
    return rounded(aggregates.function_stats_levels(E(spark, sf_dir)).select("tid", "uid", "count", "total", "q1", "median", "q3"))


@query(sql.PROFILES_PER_TYPE)
def profiles_per_type(spark, sf_dir):
    return aggregates.profiles_per_type(P(spark, sf_dir))


def _changes(spark, sf_dir):
    """Changes of mean amounts between each day and the day before."""
    pairs = joins.parent_baselines(P(spark, sf_dir), V(spark, sf_dir), P(spark, sf_dir))
    rows = E(spark, sf_dir).withColumn("profile_id", F.concat_ws("-", "version", "uid"))
    found = checks.check_history(pairs, rows, checks.average_amount_threshold)
    return found.withColumn("version", F.substring(F.substring_index("pair_id", "..", -1), 1, 10))


@query(sql.CHANGES_PER_RESULT)
def changes_per_result(spark, sf_dir):
    return aggregates.changes_per_result(_changes(spark, sf_dir))


@query(sql.CHECK_HISTORY)
def check_history(spark, sf_dir):
    return rounded(_changes(spark, sf_dir).select("version", "uid", "rate", "result"))


@query(sql.VERSION_LOG)
def version_log(spark, sf_dir):
    return ranking.version_log(V(spark, sf_dir), P(spark, sf_dir), _changes(spark, sf_dir)).select("checksum", "n_profiles", "changes")


@query(sql.DEGRADATION_RATIO)
def degradation_ratio(spark, sf_dir):
    return rounded(aggregates.degradation_ratio(_changes(spark, sf_dir), "uid"))


@query(sql.SNAPSHOTS_DENSE)
def snapshots_dense(spark, sf_dir):
    return rounded(aggregates.snapshots_dense(E(spark, sf_dir), F.sum("amount").alias("amount")))


@query(sql.MERGE_PROFILES)
def merge_profiles(spark, sf_dir):
    a, b = E(spark, sf_dir).select("uid", "amount", "snapshot"), O(spark, sf_dir).select("uid", "amount", "subtype")
    return rounded(aggregates.merge_profiles(a, b).groupBy("uid", "snapshot", "subtype").agg(F.sum("amount").alias("amount")))


# fields and filters


@query(sql.FILTER_AND_OR)
def filter_and_or(spark, sf_dir):
    return fields.filter_and_or(E(spark, sf_dir), [("uid", "click"), ("snapshot", 3), ("uid", "error")]).select("order", "uid", "snapshot", "amount")


@query(sql.FILTER_OR)
def filter_or(spark, sf_dir):
    return fields.filter_or(E(spark, sf_dir), [("uid", "click"), ("snapshot", 3)]).select("order", "uid", "snapshot")


@query(sql.UNIQUE_VALUES)
def unique_values(spark, sf_dir):
    return fields.unique_values(E(spark, sf_dir), "structure_unit_size", "order")


@query(sql.FIELD_NAMES)
def field_names(spark, sf_dir):
    return fields.field_names(E(spark, sf_dir).select("uid", "amount", "snapshot", F.when(F.col("amount") < 0, F.lit(1)).alias("never")))


@query(sql.NUMERIC_FIELDS)
def numeric_fields(spark, sf_dir):
    return fields.numeric_fields(E(spark, sf_dir).select("uid", "amount", "snapshot", "version", "structure_unit_size"))


@query(sql.KEY_VALUES)
def key_values(spark, sf_dir):
    return fields.key_values(O(spark, sf_dir), "trace::func").groupBy("value").agg(F.count("*").alias("n"))


@query(sql.FLATTEN)
def flatten_fields(spark, sf_dir):
    return fields.flatten_fields(O(spark, sf_dir).select("order", F.struct("uid", "version").alias("key"), F.transform("trace", lambda f: F.struct(f["func"])).alias("trace")))


@query(sql.COMPATIBLE)
def compatible_profiles(spark, sf_dir):
    p = P(spark, sf_dir)
    return fields.compatible_profiles(p.where("version < '2024-01-04'"), p.where("version >= '2024-01-04'"))


@query(sql.SHORT_TRACE)
def short_trace(spark, sf_dir):
    o = O(spark, sf_dir).select("order", F.concat(scalars.funcs(F.col("trace")), F.array("subtype")).alias("names"), "uid")
    full = o.withColumn("names", F.array_append("names", F.col("uid")))
    return o.select("order", scalars.short_trace(F.col("names")).alias("three")).join(full.select("order", scalars.short_trace(F.col("names")).alias("four")), "order")


@query(sql.TRACE_STEPS)
def trace_steps(spark, sf_dir):
    o = O(spark, sf_dir).select(scalars.funcs(F.col("trace")).alias("names"), "uid").distinct()
    return o.select(F.array_join(scalars.trace_steps(F.col("names"), F.col("uid")), "|").alias("steps"))


# rankings and sets


@query(sql.TOP_N)
def top_n_records(spark, sf_dir):
    rows = O(spark, sf_dir).withColumn("trace", F.array_join(scalars.funcs(F.col("trace")), ","))
    return rounded(ranking.top_n_records(rows, 10, "version").drop("percent"), 2)


@query(sql.COMPARE_TOP_N)
def compare_top_n(spark, sf_dir):
    rows = O(spark, sf_dir).withColumn("trace", F.array_join(scalars.funcs(F.col("trace")), ","))
    found = ranking.compare_top_n(rows.where("version = '1996'"), rows.where("version = '1997'"), 10)
    return rounded(found.select("rank", "base_uid", "base_trace", "target_uid", "target_trace", "delta"), 2)


@query(sql.NTH_PROFILE)
def nth_profile(spark, sf_dir):
    return ranking.nth_profile(P(spark, sf_dir), 1, 2).select("version", "profile_id", "nth")


@query(sql.COMMON_UIDS)
def common_uids(spark, sf_dir):
    e = E(spark, sf_dir)
    return ranking.common_uids(e.where("amount >= 50").select(F.col("tid").alias("uid")), e.where("amount < 50").select(F.col("tid").alias("uid")))


@query(sql.NEW_FUNCTIONS)
def new_functions(spark, sf_dir):
    e = views.call_edges(spark, sf_dir)
    return graph.new_functions(e.where("version = '1995'"), e.where("version = '1996'"))


# joins


@query(sql.PARENT_BASELINES)
def parent_baselines(spark, sf_dir):
    return joins.parent_baselines(P(spark, sf_dir), V(spark, sf_dir), P(spark, sf_dir))


@query(sql.ANCESTORS)
def ancestor_baselines(spark, sf_dir):
    found = joins.ancestor_baselines(P(spark, sf_dir), V(spark, sf_dir), P(spark, sf_dir))
    return found.groupBy("target_id").agg(F.count("*").alias("n"), F.min("baseline_id").alias("oldest"))


@query(sql.NEAREST_VERSION)
def nearest_version(spark, sf_dir):
    wanted = E(spark, sf_dir).select(F.col("uid"), F.col("moment").cast("timestamp").alias("date"))
    known = E(spark, sf_dir).select("uid", F.col("moment").cast("timestamp").alias("date"), F.col("order").cast("string").alias("checksum"), F.col("order").alias("ordinal"))
    found = joins.nearest_version(wanted, known, "uid")
    return found.select("uid", F.unix_micros("date").alias("t"), "checksum")


@query(sql.LATEST_STATS)
def latest_stats(spark, sf_dir):
    stats = E(spark, sf_dir).groupBy("version", F.concat(F.lit("u"), F.col("tid").cast("string")).alias("name")).agg(F.round(F.sum("amount"), 4).alias("value"))
    return joins.latest_stats(stats, V(spark, sf_dir))


@query(sql.UPSERT)
def upsert_changes(spark, sf_dir):
    c = _changes(spark, sf_dir).select("version", F.col("uid").alias("location"), F.lit("time").alias("type"), F.lit("log").alias("cmdstr"), "result", "rate")
    fresh = c.where("version >= '2024-01-10'").withColumn("rate", F.lit(0.0))
    return rounded(sinks.upsert_changes(c.where("version <= '2024-01-20'"), fresh))


@query(sql.CALLERS_CALLEES)
def callers_callees(spark, sf_dir):
    found = joins.callers_callees(views.call_edges(spark, sf_dir).select("caller", "callee"))
    return found.select("func", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query(sql.ZIP_TRACES)
def zip_traces(spark, sf_dir):
    o = O(spark, sf_dir).select("order", scalars.funcs(F.col("trace")).alias("a"), F.array("uid", "subtype", F.col("trace")[1]["func"]).alias("b"))
    return ranking.zip_traces(o, "a", "b").select("order", "i", "frame_a", "frame_b", "a_in_b", "b_in_a")


# windows


@query(sql.SMA)
def sma_centered(spark, sf_dir):
    rows = E(spark, sf_dir).withColumn("at_", F.col("order"))
    return rounded(windows.moving_average(rows, "uid", x="at_", window=4).select("order", "average"))


@query(sql.SMM)
def smm(spark, sf_dir):
    return rounded(windows.moving_average(E(spark, sf_dir), "uid", x="order", window=5, method="smm", center=False, min_periods=2).select("order", "average"))


@query(sql.EMA)
def ema(spark, sf_dir):
    return rounded(windows.moving_average(E(spark, sf_dir), "uid", x="order", window=3, method="ema", alpha=0.5).select("order", "average"))


@query(sql.SMA_WEIGHTED)
def sma_triangular(spark, sf_dir):
    return rounded(windows.moving_average(E(spark, sf_dir), "uid", x="order", window=5, window_type="triang").select("order", "average"))


@query(sql.AUTO_WINDOW)
def auto_window(spark, sf_dir):
    return rounded(windows.auto_window(E(spark, sf_dir), "uid", x="order"))


@query(sql.SORT_AND_SPLIT)
def sort_and_split(spark, sf_dir):
    parts = windows.sort_and_split(E(spark, sf_dir), 7, "uid", x="order")
    return rounded(parts.groupBy("uid", "part").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")))


@query(sql.TRACE_SEQUENCE)
def trace_sequence(spark, sf_dir):
    records = E(spark, sf_dir).select("tid", F.col("uid").alias("probe_id"), F.col("order").alias("timestamp"))
    return windows.trace_sequence(records, 3).select("timestamp", "sequence")


@query(sql.PERCENT)
def percent_of_total(spark, sf_dir):
    return rounded(windows.percent_of_total(E(spark, sf_dir).groupBy("version", "uid").agg(F.sum("amount").alias("amount")), "version"))


@query(sql.MERGE_INTERVALS)
def merge_intervals(spark, sf_dir):
    day = E(spark, sf_dir).groupBy("uid", F.dayofyear("version").cast("double").alias("x_start")).agg(F.avg("amount").alias("rate"))
    day = day.withColumn("x_end", F.col("x_start") + 1).withColumn("result", F.when(F.col("rate") > 21, "Degradation").when(F.col("rate") < 19, "Optimization").otherwise("NoChange"))
    return rounded(windows.merge_intervals(day, "uid"))


# models


def _fit(kind: str) -> None:
    def run(spark, sf_dir):
        found = models.fit(S(spark, sf_dir), kind, "profile_id", "uid")
        return rounded(found.select("profile_id", "uid", "r_square", "x_start", "x_end", "b0", "b1", "b2", "n"), 6 if kind != "quadratic" else 4)

    QUERIES[f"fit_{kind}"], ORACLES[f"fit_{kind}"] = run, sql.off_ties(sql.fit(kind))


for _kind in ("linear", "logarithmic", "power", "exponential", "quadratic", "constant"):
    _fit(_kind)


@query(sql.BEST_MODEL)
def best_model(spark, sf_dir):
    found = windows.best_model_per_uid(models.fit_all(S(spark, sf_dir), "profile_id", "uid"), "profile_id", "uid")
    return rounded(found.select("profile_id", "uid", "model", "r_square"))


@query(sql.BEST_MODEL_COUNTS)
def best_model_counts(spark, sf_dir):
    return aggregates.best_model_counts(models.fit_all(E(spark, sf_dir).withColumn("uid", F.concat_ws("-", "uid", "version")), "uid"))


@query(sql.FIT_INTERVAL)
def fit_interval(spark, sf_dir):
    rows = S(spark, sf_dir).withColumn("x", F.col("order").cast("double") + 1)
    found = models.fit_interval(rows, 4, "uid", x="x", y="structure_unit_size")
    return rounded(found.select("uid", "part", "n", "x_start", "x_end"))


@query(sql.FIT_ITERATIVE)
def fit_iterative(spark, sf_dir):
    return rounded(models.fit_iterative(S(spark, sf_dir), 4, "uid").select("uid", "model", "r_square", "b0", "b1"))


@query(sql.FIT_INITIAL_GUESS)
def fit_initial_guess(spark, sf_dir):
    return rounded(models.fit_initial_guess(S(spark, sf_dir), 4, "uid").select("uid", "model", "r_square", "b0", "b1"))


@query(sql.FIT_BISECTION)
def fit_bisection(spark, sf_dir):
    return rounded(models.fit_bisection(S(spark, sf_dir), "uid").select("uid", "segment", "model", "x_start", "x_end"))


@query(sql.MODEL_POINTS)
def model_points(spark, sf_dir):
    return rounded(models.model_points(models.fit(S(spark, sf_dir), "linear", "uid"), 51, "uid"))


@query(sql.INTEGRAL)
def integral_param(spark, sf_dir):
    m = models.fit_all(S(spark, sf_dir), "uid")
    area = scalars.integral_param(*[F.col(c) for c in ("model", "b0", "b1", "b2", "x_start", "x_end")])
    return rounded(m.where("model IN ('linear', 'logarithmic', 'constant')").select("uid", "model", area.alias("area")), 2)


@query(sql.regressogram("avg"))
def regressogram_mean(spark, sf_dir):
    found = nonparam.regressogram(S(spark, sf_dir), "uid", buckets=8)
    return rounded(found.select("uid", "x_start", "x_end", "y_start", "r_square", F.posexplode("bucket_stats").alias("bucket", "stat")))


@query(sql.regressogram("median"))
def regressogram_median(spark, sf_dir):
    found = nonparam.regressogram(S(spark, sf_dir), "uid", buckets=8, stat="median")
    return rounded(found.select("uid", "x_start", "x_end", "y_start", "r_square", F.posexplode("bucket_stats").alias("bucket", "stat")))


@query(sql.REGRESSOGRAM_RULES)
def regressogram_rules(spark, sf_dir):
    found = None
    for rule in ("fd", "rice", "scott", "sqrt", "sturges", "auto"):
        one = nonparam.regressogram(S(spark, sf_dir), "uid", buckets=rule, compat=False).select("uid", F.lit(rule).alias("rule"), "buckets")
        found = one if found is None else found.union(one)
    return found


@query(sql.KERNEL_CONSTANT)
def kernel_local_constant(spark, sf_dir):
    sizes = nonparam.distinct_sizes(S(spark, sf_dir), "uid")
    return rounded(nonparam.kernel_estimate(sizes, "uid", h=5.0).select("uid", "x", "estimate"), 2)


@query(sql.KERNEL_LINEAR)
def kernel_local_linear(spark, sf_dir):
    sizes = nonparam.distinct_sizes(S(spark, sf_dir), "uid")
    return rounded(nonparam.kernel_estimate(sizes, "uid", h=5.0, order=1).select("uid", "x", "estimate"), 2)


@query()
def kernel_local_cubic(spark, sf_dir):
    sizes = nonparam.distinct_sizes(S(spark, sf_dir), "uid")
    return rounded(nonparam.kernel_estimate(sizes, "uid", h=9.0, kind="tricube", order=3).select("uid", "x", "estimate"), 2)


@query(sql.KERNEL_RIDGE)
def kernel_ridge_grid(spark, sf_dir):
    found = nonparam.kernel_ridge_grid(S(spark, sf_dir), "uid", gammas=[0.001, 0.01, 0.1, 1.0])
    return rounded(found.select("uid", "gamma", (F.col("mse") / 1e6).alias("mse")))


@query(sql.MOVING_MODEL)
def moving_average_model(spark, sf_dir):
    found = nonparam.moving_average_model(S(spark, sf_dir).withColumn("x", F.col("order").cast("double")), "uid", x="x", window=9, length=100_000)
    whole = found.groupBy("uid", "x_start", "x_end", "window_width", "r_square").agg(F.sum(F.size("bucket_stats")).cast("int").alias("points"))
    return rounded(whole)


@query(sql.BANDWIDTH)
def kernel_bandwidth(spark, sf_dir):
    rows = S(spark, sf_dir)
    scott, silverman = nonparam.bandwidth(rows, "uid"), nonparam.bandwidth(rows, "uid", rule="silverman")
    return rounded(scott.withColumnRenamed("h", "scott").join(silverman.withColumnRenamed("h", "silverman"), "uid"))


# checks


@query(sql.CHECK_AAT)
def check_aat(spark, sf_dir):
    return rounded(checks.average_amount_threshold(*sides(spark, sf_dir)))


@query(sql.CHECK_ORDER)
def check_order(spark, sf_dir):
    return rounded(checks.best_model_order_equality(*fits(spark, sf_dir)))


@query(sql.CHECK_GENERAL)
def check_general(spark, sf_dir):
    return rounded(checks.general_detection(*fits(spark, sf_dir)))


def _typed(kind: str) -> None:
    def run(spark, sf_dir):
        found = checks.general_detection(*fits(spark, sf_dir), kind=kind)
        return rounded(found.select("uid", "rate", "result", "change_type"))

    QUERIES[f"check_{kind}"] = run
    ORACLES[f"check_{kind}"] = sql.off_ties(f"SELECT uid, rate, result, change_type FROM ({sql.CHECK_TYPED[kind]})")


for _kind in ("polynomial_regression", "linear_regression", "fast_check"):
    _typed(_kind)


@query(sql.CHECK_INTEGRAL)
def check_integral(spark, sf_dir):
    linear = lambda m: m.where("model = 'linear'")
    b, t = fits(spark, sf_dir)
    return rounded(checks.integral_comparison(linear(b), linear(t)), 2)


def _series(spark, sf_dir):
    """Mean cost per size of both sides: one point per quantity."""
    rows = S(spark, sf_dir).groupBy("profile_id", "uid", F.col("structure_unit_size").alias("x")).agg(F.avg("amount").alias("y"))
    return rows.where("profile_id = 'baseline'"), rows.where("profile_id = 'target'")


@query(sql.CHECK_LOCAL)
def check_local_stats(spark, sf_dir):
    b, t = _series(spark, sf_dir)
    return rounded(checks.local_statistics(b, t)[0])


@query(sql.LOCAL_INTERVALS)
def local_intervals(spark, sf_dir):
    b, t = _series(spark, sf_dir)
    return rounded(checks.local_statistics(b, t)[1])


@query(sql.LOCAL_WINDOWS)
def local_windows(spark, sf_dir):
    b, _ = _series(spark, sf_dir)
    return rounded(windows.local_windows(b, "uid").drop("int"), 3)


def _exclusive(spark, sf_dir):
    rows = S(spark, sf_dir).withColumn("exclusive", F.col("amount") * 1000)
    return rows.where("profile_id = 'baseline'"), rows.where("profile_id = 'target'").withColumn("uid", F.expr("if(uid LIKE 'E%' AND location = 'A', concat(uid, '_v2'), uid)"))


@query(sql.CHECK_OUTLIERS)
def check_outliers(spark, sf_dir):
    return rounded(checks.exclusive_time_outliers(checks.exclusive_diff(*_exclusive(spark, sf_dir)), cut_off=0.01), 3)


@query(sql.LOCATION_TOTALS)
def location_totals(spark, sf_dir):
    return rounded(aggregates.total_by_location(checks.exclusive_diff(*_exclusive(spark, sf_dir))), 3)


@query(sql.EXCLUSIVE_DIFF)
def exclusive_diff(spark, sf_dir):
    return rounded(checks.exclusive_diff(*_exclusive(spark, sf_dir)), 3)


# traces and graphs


@query(sql.PAIR_CALLS)
def pair_calls(spark, sf_dir):
    records = views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id")
    return calls.pair_calls(records).select("tid", "uid", "depth", "begin", "amount", "parent")


@query(sql.EXCLUSIVE_TIME)
def exclusive_time(spark, sf_dir):
    records = views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id")
    return calls.exclusive_time(calls.pair_calls(records)).groupBy("uid", "depth").agg(F.sum("amount").alias("amount"), F.sum("exclusive").alias("exclusive"), F.count("*").alias("n"))


@query()
def pair_damaged_calls(spark, sf_dir):
    return calls.pair_calls(views.call_records(spark, sf_dir)).groupBy("uid").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(sql.HOTSPOTS)
def hotspot_coverage(spark, sf_dir):
    records = views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id")
    return aggregates.hotspot_coverage(calls.exclusive_time(calls.pair_calls(records)))


@query(sql.DYNAMIC_GRAPH)
def dynamic_call_graph(spark, sf_dir):
    records = views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id")
    return graph.dynamic_call_graph(calls.pair_calls(records))


def _edges(spark, sf_dir):
    """The few edges of the graph, kept: closures and levels take them in every round."""
    return graph.keep(views.call_edges(spark, sf_dir).select("caller", "callee").distinct())


@query(sql.REACHABLE)
def reachable(spark, sf_dir):
    return graph.reachable_from(_edges(spark, sf_dir), "main")


@query(sql.LEVELS)
def graph_levels(spark, sf_dir):
    return graph.graph_levels(_edges(spark, sf_dir))


@query(sql.LEAVES)
def graph_leaves(spark, sf_dir):
    return graph.leaves(_edges(spark, sf_dir))


@query(sql.TOP_DOWN)
def project_top_down(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.project_top_down(graph.graph_levels(e), 3, e, keep_leaf=False)


@query(sql.BOTTOM_UP)
def project_bottom_up(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.project_bottom_up(e, graph.graph_levels(e), 2)


@query(sql.WRAPPERS)
def filter_wrappers(spark, sf_dir):
    records = views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id")
    found = calls.pair_calls(records).withColumn("uid", F.concat_ws("-", "uid", F.col("tid").cast("string"))).withColumn("parent", F.concat_ws("-", "parent", F.col("tid").cast("string")))
    return graph.filter_wrappers(graph.dynamic_call_graph(found.where("parent_begin IS NOT NULL")), aggregates.function_stats(found.withColumn("amount", F.col("amount").cast("double")), exclusive="amount"))


@query(sql.SAMPLING)
def suggest_sampling(spark, sf_dir):
    e = _edges(spark, sf_dir)
    counts = O(spark, sf_dir).groupBy("uid").agg(F.count("*").alias("count"))
    return graph.suggest_sampling(graph.graph_levels(e), counts, 2.0, 500)


@query(sql.DIFF_GRAPHS)
def diff_call_graphs(spark, sf_dir):
    e = views.call_edges(spark, sf_dir)
    named = e.where("version = '1997'").select("caller", F.when(F.col("callee").endswith("Y"), F.concat(F.lit("new_"), "callee")).otherwise(F.col("callee")).alias("callee"))
    return graph.diff_call_graphs(e.where("version = '1996'").select("caller", "callee"), named)


@query(sql.FOLD)
def fold_stacks(spark, sf_dir):
    return rounded(traces.fold_stacks(O(spark, sf_dir), "version"), 2)


@query(sql.DIFF_FOLDED)
def diff_folded(spark, sf_dir):
    o = O(spark, sf_dir)
    return rounded(traces.diff_folded(o.where("version = '1996'"), o.where("version = '1997'")), 2)


@query()
def cluster_traces(spark, sf_dir):
    o = O(spark, sf_dir).select(F.concat(scalars.funcs(F.col("trace")), F.array(F.concat_ws("_", "uid", "subtype"))).alias("t"), "amount")
    found = traces.cluster_traces(o, "t", 0.7)
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query()
def match_locations(spark, sf_dir):
    rows = O(spark, sf_dir).select(F.concat_ws("-", F.col("trace")[1]["func"], "uid").alias("location")).distinct()
    return joins.match_locations(rows.select(F.concat("location", F.lit(".1.0")).alias("location")), rows.select(F.concat("location", F.lit(".2.0")).alias("location")))


@query(sql.PROMOTE)
def promote_fields(spark, sf_dir):
    rows = E(spark, sf_dir).withColumn("extra", F.create_map(F.lit("size"), F.col("structure_unit_size").cast("string"), F.lit("hour"), F.col("snapshot").cast("string")))
    return schema.promote_fields(rows, ["size", "hour"], "double").groupBy("hour").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


@query(sql.UID_ORDER)
def uid_order(spark, sf_dir):
    o = O(spark, sf_dir)
    parts = F.create_map(F.lit("line"), "subtype", F.lit("func"), "uid", F.lit("zone"), "version", F.lit("file"), F.col("trace")[1]["func"])
    return o.select(fields.uid_order(parts).alias("uid")).groupBy("uid").agg(F.count("*").alias("n"))


@query(sql.RULES)
def rule_applicable(spark, sf_dir):
    rules = spark.createDataFrame(
        [(1, "aat", None, "time", None, None), (2, "bmoe", "events", None, None, "fit"), (3, "eto", None, None, "error", None)], "ordinal int, method string, collector string, type string, cmd string, postprocessor string"
    )
    return fields.rule_applicable(rules, P(spark, sf_dir), "first")


@query(sql.LAST_OF_DAY)
def sync_catalog(spark, sf_dir):
    p = P(spark, sf_dir).withColumn("path", F.col("profile_id"))
    listed, stored = p.where("type <> 'mixed'"), p.where("cmd <> 'click'")
    return ranking.sync_catalog(listed.select("version", "path", "type"), stored.select("version", "path", "type"))


@query(sql.RUNNING_BEST)
def thread_spans(spark, sf_dir):
    e = E(spark, sf_dir)
    records = e.select(F.when(F.col("uid").isin("click", "purchase", "signup"), calls.THREAD_BEGIN).otherwise(calls.THREAD_END).alias("record_type"), "tid", F.lit("t").alias("probe_id"), F.col("order").alias("timestamp"))
    return calls.thread_spans(records).select("tid", "begin", "end", "amount")


@query(sql.STATS_UPDATE)
def update_stats(spark, sf_dir):
    e = E(spark, sf_dir)
    moved = F.expr("if(snapshot >= 12 AND version <= '2024-01-05', concat(uid, '_moved'), uid)")
    one = lambda rows, key: rows.groupBy("version", moved.alias("name")).agg(F.count("*").cast("string").alias("n")).select("version", "name", F.lit("calls").alias("stat_id"), F.create_map(F.lit(key), "n", F.lit("k"), F.lit(key)).alias("value"))
    found = sinks.update_stats(one(e.where("snapshot < 12"), "am"), one(e.where("snapshot >= 12"), "pm"))
    get = lambda k: F.try_element_at("value", F.lit(k)).alias(k)
    return found.select("version", "name", get("am"), get("pm"), get("k"))

