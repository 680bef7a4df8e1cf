"""Queries over filters, scalar functions, call graphs, model strategies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profloom.functions import scalars
from profloom.operators import aggregates, calls, checks, fields, graph, models, nonparam, ranking, traces
from profloom.plans import plugins, sql, views
from profloom.plans.catalog import E, O, P, S, V, _changes, _edges, query, rounded, sides
from profloom.plans.sql import _CHANGES, _EXCL, _REACH, _UID_FITS, _XY
from profloom.plans.views import EVENTS, ORDERS, SALES


def _area(p: str) -> str:
    """The area under a fitted curve, by its antiderivative; ``p`` is a table with the model's columns."""
    lo, hi, b0, b1, b2 = (f"{p}.{c}" for c in ("x_start", "x_end", "b0", "b1", "b2"))
    return f"""(CASE {p}.model WHEN 'constant' THEN {b0} * ({hi} - {lo}) WHEN 'linear' THEN {b0} * ({hi} - {lo}) + {b1} * ({hi} * {hi} - {lo} * {lo}) / 2
  WHEN 'logarithmic' THEN {b0} * ({hi} - {lo}) + {b1} * ({hi} * ln({hi}) - {hi} - {lo} * ln({lo}) + {lo})
  WHEN 'quadratic' THEN {b0} * ({hi} - {lo}) + {b1} * ({hi} * {hi} - {lo} * {lo}) / 2 + {b2} * (power({hi}, 3) - power({lo}, 3)) / 3
  WHEN 'power' THEN {b0} * (power({hi}, {b1} + 1) - power({lo}, {b1} + 1)) / ({b1} + 1) WHEN 'exponential' THEN {b0} * (power({b1}, {hi}) - power({b1}, {lo})) / ln({b1}) END)"""


_CLASS = sql._CLASS


def _compared(source: str, on: str) -> str:
    """Relative areas of both sides' models, joined on ``on``."""
    return f"""(SELECT *, (ta - ba) / CASE WHEN ba = 0 THEN 1e-6 ELSE ba END AS rate FROM (SELECT b.uid, b.model, {_area('b')} AS ba, {_area('t')} AS ta
  FROM (SELECT * FROM {source} WHERE profile_id = 'baseline') b JOIN (SELECT * FROM {source} WHERE profile_id = 'target') t ON {on}))"""


# models


@query(f"SELECT uid, model, round({_area('m')}, 2) AS area FROM {_UID_FITS} m")
def integral_all_kinds(spark, sf_dir):
    m = models.fit_all(S(spark, sf_dir), "uid")
    return rounded(m.select("uid", "model", scalars.integral_param(*[F.col(c) for c in ("model", "b0", "b1", "b2", "x_start", "x_end")]).alias("area")), 2)


_FIT = "(SELECT * FROM {0} WHERE r_square >= 0.15)"
#: Costs that grow with the square of the size, some a third more in the target.
_SHAPED_XY = f"(SELECT profile_id, uid, x, x * x * CASE WHEN profile_id = 'target' AND uid < 'N' THEN 1.3 ELSE 1 END + y / 10000 AS y FROM {_XY})"
_SHAPED = sql.models(_SHAPED_XY, "profile_id, uid")


def _shaped(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = F.col("structure_unit_size")
    more = F.when(F.expr("profile_id = 'target' AND uid < 'N'"), 1.3).otherwise(1.0)
    found = models.fit_all(S(spark, sf_dir).withColumn("amount", x * x * more + F.col("amount") / 10000), "profile_id", "uid")
    return found.where("profile_id = 'baseline'").drop("profile_id"), found.where("profile_id = 'target'").drop("profile_id")


@query(f"SELECT uid, round(ba, 2) AS base_area, round(ta, 2) AS target_area, round(round(rate, 2), 2) AS rate, {_CLASS.format('rate', 0.1, 0.25)} AS result FROM {_compared(_FIT.format(sql._best(_SHAPED, 'profile_id, uid')), 'b.uid = t.uid')}")
def run_with_best_models(spark, sf_dir):
    return rounded(checks.run_with_models(*_shaped(spark, sf_dir), strategy="best-param"), 2)


@query(f"SELECT uid, model AS kind, round(round(rate, 2), 4) AS rate, {_CLASS.format('rate', 0.1, 0.25)} AS result FROM {_compared(_FIT.format(_SHAPED), 'b.uid = t.uid AND b.model = t.model')}")
def run_with_all_models(spark, sf_dir):
    return rounded(checks.run_with_models(*_shaped(spark, sf_dir), strategy="all-param").select("uid", "kind", "rate", "result"))


@query(f"""SELECT CASE WHEN model = 'regressogram' THEN 'nonparam' ELSE 'param' END AS kind, model, count(*) AS n FROM (
  SELECT uid, model FROM {_UID_FITS} UNION ALL SELECT DISTINCT uid, 'regressogram' FROM {_XY}) GROUP BY ALL""")
def models_by_group(spark, sf_dir):
    buckets = nonparam.regressogram(S(spark, sf_dir), "uid", buckets=8).select("uid", F.lit("regressogram").alias("model"))
    rows = models.fit_all(S(spark, sf_dir), "uid").select("uid", "model").union(buckets)
    one = lambda g: fields.models_by_group(rows, g).select(F.lit(g).alias("kind"), "model")
    return one("param").union(one("nonparam")).groupBy("kind", "model").agg(F.count("*").alias("n"))


@query(f"""SELECT 'click' AS uid, 'linear' AS model, round(regr_r2(amount, structure_unit_size), 4) AS r_square, round(regr_intercept(amount, structure_unit_size), 4) AS b0,
  round(regr_slope(amount, structure_unit_size), 4) AS b1 FROM {EVENTS} WHERE uid = 'click'""")
def model_of(spark, sf_dir):
    return rounded(fields.model_of(models.fit_all(E(spark, sf_dir), "uid"), "linear", "click").select("uid", "model", "r_square", "b0", "b1"))


@query(f"""SELECT uid, bucket, round(x_start + bucket * (x_end - x_start) / 8, 4) AS x_start, round(x_start + (bucket + 1) * (x_end - x_start) / 8, 4) AS x_end, stat AS y FROM ({sql.regressogram('avg')})""")
def bucket_points(spark, sf_dir):
    return rounded(models.bucket_points(nonparam.regressogram(S(spark, sf_dir), "uid", buckets=8), "uid"))


@query(f"""SELECT uid, n, models FROM (SELECT uid, count(*) AS n FROM {_XY} GROUP BY uid HAVING count(*) > 1) JOIN (
  SELECT uid, string_agg(model, ',' ORDER BY model) AS models FROM {_UID_FITS} GROUP BY uid, x_start, x_end) USING (uid)""")
def scatter_slices(spark, sf_dir):
    rows = S(spark, sf_dir)
    points, kinds = models.scatter_slices(rows, models.fit_all(rows, "uid"))
    return points.groupBy("uid").agg(F.count("*").alias("n")).join(kinds.select("uid", F.array_join("models", ",").alias("models")), "uid")


@query(f"""WITH p AS (SELECT profile_id, uid, part, count(*) AS n, min(x) AS x_start, max(x) AS x_end, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, regr_r2(y, x) AS r2 FROM (
  SELECT *, ntile(4) OVER (PARTITION BY profile_id, uid ORDER BY x, y) AS part FROM {_XY}) GROUP BY ALL)
  SELECT profile_id, uid, part::INT AS part, n, x_start, x_end, round(b0, 4) AS b0, round(b1, 4) AS b1, round(r2, 4) AS r_square FROM p WHERE n >= 3 AND b1 IS NOT NULL AND NOT isnan(b1)""")
def fit_parts(spark, sf_dir):
    """The lines of the parts that the interval method fits."""
    rows = S(spark, sf_dir)
    parts = rows.withColumn("part", F.ntile(4).over(Window.partitionBy("profile_id", "uid").orderBy("structure_unit_size", "amount")))
    found = models.fit(parts, "linear", "profile_id", "uid", "part")
    return rounded(found.select("profile_id", "uid", "part", "n", "x_start", "x_end", "b0", "b1", "r_square"))


_INTERVAL = f"(SELECT uid, ntile(4) OVER (PARTITION BY uid ORDER BY x, y) AS part, x, y FROM {_XY})"


@query(f"SELECT uid, part::INT AS part, model, round(x_start, 4) AS x_start, round(x_end, 4) AS x_end, round(r_square, 4) AS r_square, round(b0, 2) AS b0 FROM {sql._best(sql.models(_INTERVAL, 'uid, part'), 'uid, part')}")
def fit_interval_models(spark, sf_dir):
    found = models.fit_interval(S(spark, sf_dir), 4, "uid")
    return rounded(found.select("uid", "part", "model", "x_start", "x_end", "r_square")).join(rounded(found.select("uid", "part", "b0"), 2), ["uid", "part"])


@query(f"""WITH z AS (SELECT uid, x, count(*) AS m, sum(y) AS sy, sum(y * y) AS syy FROM {_XY} GROUP BY uid, x),
  k AS (SELECT a.uid, a.x, sum(exp(-(b.x - a.x) * (b.x - a.x) / 50) * b.sy) / sum(exp(-(b.x - a.x) * (b.x - a.x) / 50) * b.m) AS e FROM z a JOIN z b ON a.uid = b.uid GROUP BY a.uid, a.x)
  SELECT uid, min(x) AS x_start, max(x) AS x_end, 5.0 AS bandwidth, count(*)::INT AS points, round(1 - sum(syy - 2 * e * sy + m * e * e) / (sum(syy) - sum(sy) * sum(sy) / sum(m)), 4) AS r_square
  FROM z JOIN k USING (uid, x) GROUP BY uid""")
def kernel_model(spark, sf_dir):
    found = plugins.postprocess("kernel_regression", S(spark, sf_dir), "uid", h=5.0)
    return rounded(found.select("uid", "x_start", "x_end", "bandwidth", F.size("bucket_stats").alias("points"), "r_square"))


@query(f"""WITH z AS (SELECT uid, x, count(*) AS m, sum(y) AS sy, sum(y * y) AS syy FROM {_XY} GROUP BY uid, x), g AS (SELECT unnest([1.0, 3.0, 9.0])::DOUBLE AS h),
  k AS (SELECT a.uid, a.x, h, sum(exp(-(b.x - a.x) * (b.x - a.x) / (2 * h * h)) * b.sy) AS sa, sum(exp(-(b.x - a.x) * (b.x - a.x) / (2 * h * h)) * b.m) AS sb FROM z a JOIN z b ON a.uid = b.uid CROSS JOIN g GROUP BY ALL),
  e AS (SELECT uid, h, sum((1 + 1 / (sb - 1)) * (1 + 1 / (sb - 1)) * syy - 2 * (1 + 1 / (sb - 1)) * (sa / (sb - 1)) * sy + m * (sa / (sb - 1)) * (sa / (sb - 1))) / sum(m) AS mse FROM k JOIN z USING (uid, x) GROUP BY uid, h)
  SELECT uid, arg_min(h, mse) AS h, round(min(mse) / 1e6, 4) AS mse FROM e GROUP BY uid""")
def bandwidth_by_cv(spark, sf_dir):
    found = nonparam.bandwidth_by_cv(S(spark, sf_dir), "uid", grid=[1.0, 3.0, 9.0])
    return rounded(found.select("uid", "h", (F.col("mse") / 1e6).alias("mse")))


@query(f"""SELECT uid, (b.bucket)::INT AS bucket, b.stat AS base, t.stat AS target FROM ({sql.regressogram('avg').replace(SALES, f"(SELECT * FROM {SALES} WHERE profile_id = 'baseline')")}) b
  JOIN ({sql.regressogram('avg').replace(SALES, f"(SELECT * FROM {SALES} WHERE profile_id = 'target')")}) t USING (uid, bucket)""")
def align_nonparam(spark, sf_dir):
    b, t = (nonparam.regressogram(side, "uid", buckets=8) for side in sides(spark, sf_dir))
    both = checks.align_nonparam(b, t)
    pair = F.posexplode(F.arrays_zip(F.col("base_stats").alias("base"), F.col("target_stats").alias("target"))).alias("bucket", "p")
    return rounded(both.select("uid", pair).select("uid", "bucket", F.col("p.base").alias("base"), F.col("p.target").alias("target")))


@query(f"""SELECT uid, round(r_square, 4) AS r_square, round(b0, 4) AS b0, round(b1, 4) AS b1 FROM (
  SELECT uid, regr_r2(y, sqrt(x)) AS r_square, regr_intercept(y, sqrt(x)) AS b0, regr_slope(y, sqrt(x)) * 2 AS b1 FROM {_XY} GROUP BY uid)""")
def registered_model(spark, sf_dir):
    """A kind of the user's own: a line over the root of the size, whose slope is told for a fourfold size."""
    root = models.Kind("root", F.sqrt, lambda y: y, f_b=lambda b: b * 2)
    found = models.fit(S(spark, sf_dir), root, "uid")
    return rounded(found.select("uid", "r_square", "b0", "b1"))


# scalar functions and filters


@query(f"SELECT location, count(*) AS n FROM {SALES} WHERE regexp_matches(location, '^[AN]') GROUP BY 1")
def location_filter(spark, sf_dir):
    return fields.location_filter(S(spark, sf_dir), "^[AN]").groupBy("location").agg(F.count("*").alias("n"))


@query(f"""SELECT abs(amount - 50) <= 10 AS near, abs(amount) BETWEEN 0.9 * 50 AND 1.1 * 50 AS close, count(*) AS n FROM {EVENTS} GROUP BY ALL""")
def in_ranges(spark, sf_dir):
    near = scalars.in_abs_range(F.col("amount") - 50, F.lit(-10.0))
    close = scalars.in_rel_range(F.col("amount"), F.lit(50.0), 0.1)
    return E(spark, sf_dir).groupBy(near.alias("near"), close.alias("close")).agg(F.count("*").alias("n"))


_WORDS = "list_distinct(string_split({0}, '_'))"
_COST = f"(1 - 2.0 * len(list_intersect({_WORDS.format('{0}')}, {_WORDS.format('{1}')})) / (len({_WORDS.format('{0}')}) + len({_WORDS.format('{1}')})))"


@query(f"SELECT DISTINCT n_name AS a, r_name AS b, round({_COST.format('n_name', 'r_name')}, 4) AS cost FROM {ORDERS}")
def switch_cost(spark, sf_dir):
    names = O(spark, sf_dir).select(F.col("trace")[1]["func"].alias("a"), F.col("trace")[0]["func"].alias("b")).distinct()
    return rounded(names.withColumn("cost", scalars.switch_cost(F.col("a"), F.col("b"))))


_STEP = f"(CASE WHEN {{0}} = {{1}} THEN 0 ELSE {_COST} END)"


@query(f"""SELECT DISTINCT r_name || ',' || n_name AS a, n_name || ',' || uid AS b, round(least({_STEP.format('r_name', 'n_name')} + {_STEP.format('n_name', 'uid')},
  2 + {_STEP.format('n_name', 'n_name')}, 2 + {_STEP.format('r_name', 'uid')}), 4) AS distance FROM {ORDERS}""")
def trace_distance(spark, sf_dir):
    names = scalars.funcs(F.col("trace"))
    pairs = O(spark, sf_dir).select(names.alias("a"), F.array(F.col("trace")[1]["func"], "uid").alias("b")).distinct()
    found = traces.trace_distance(pairs, "a", "b")
    return rounded(found.select(F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"), "distance"))


@query(f"""WITH g AS (SELECT uid, version, snapshot // 2 AS part, snapshot % 4 AS s, dayofyear(version::DATE) % 2 = 1 AS odd FROM {EVENTS}),
  d AS (SELECT uid, version, part, CASE WHEN odd THEN greatest(s, 1) ELSE s END AS degree, CASE WHEN odd AND s <= 1 THEN 1 ELSE 0 END AS logs FROM g)
  SELECT uid, version, part::INT AS part, CASE WHEN m.degree = 0 THEN 'O(1)' WHEN m.logs = 1 THEN 'O(n^1 log(n))' ELSE 'O(n^' || m.degree || ')' END AS worst FROM (
    SELECT uid, version, part, max({{'degree': degree, 'logs': logs}}) AS m FROM d GROUP BY ALL)""")
def bound_growth(spark, sf_dir):
    """The greatest of the polynomial bounds of each function's hours."""
    more = F.when(F.dayofyear("version") % 2 == 1, " + n*log(n)").otherwise(" + 2*(1 + 3)")
    rows = E(spark, sf_dir).select("uid", "version", F.expr("snapshot div 2").cast("int").alias("part"), F.concat(F.lit("3*n^"), (F.col("snapshot") % 4).cast("string"), more).alias("bound"))
    worst = rows.groupBy("uid", "version", "part").agg(F.max_by("bound", scalars.bound_growth(F.col("bound"))).alias("bound"))
    return worst.select("uid", "version", "part", scalars.complexity_of(F.col("bound")).alias("worst"))


@query(f"""SELECT 'O(n^' || snapshot % 7 || ')' AS bound, CASE snapshot % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS rank, count(*) AS n FROM {EVENTS} GROUP BY ALL""")
def complexity_of(spark, sf_dir):
    bound = F.concat(F.lit("O(n^"), (F.col("snapshot") % 7).cast("string"), F.lit(")"))
    return E(spark, sf_dir).select(bound.alias("bound")).groupBy("bound", scalars.complexity_rank(F.col("bound")).alias("rank")).agg(F.count("*").alias("n"))


@query(f"""SELECT result, CASE result {' '.join(f"WHEN '{k}' THEN {v}" for k, v in scalars.SEVERITY.items())} END AS severity, count(*) AS n FROM {_CHANGES} GROUP BY ALL""")
def severity(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("result", scalars.severity(F.col("result")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"""SELECT version || ' ' || uid AS location, result, row_number() OVER (ORDER BY version || ' ' || uid)::INT AS place FROM {_CHANGES}""")
def sort_changes(spark, sf_dir):
    rows = _changes(spark, sf_dir).select(F.concat_ws(" ", "version", "uid").alias("location"), F.lit("time").alias("type"), F.lit("log").alias("cmdstr"), "result")
    ordered = ranking.sort_changes(rows)
    ahead = ordered.groupBy("location", "result").agg(F.count("*").alias("n"))
    return ahead.select("location", "result", F.row_number().over(Window.orderBy("location")).alias("place"))  # a row per change


@query(f"SELECT coalesce(b.tid, t.tid) AS tid, b.tid IS NULL OR t.tid IS NULL AS fresh FROM (SELECT DISTINCT tid FROM {EVENTS} WHERE version = '2024-01-02') b FULL JOIN (SELECT DISTINCT tid FROM {EVENTS} WHERE version = '2024-01-03') t ON b.tid = t.tid")
def new_or_deleted_flag(spark, sf_dir):
    users = lambda day: ranking.uids_of(E(spark, sf_dir).where(F.col("version") == day).select(F.col("tid").alias("uid")))
    both = users("2024-01-02").select(F.col("uid").alias("base")).join(users("2024-01-03").select(F.col("uid").alias("target")), F.col("base") == F.col("target"), "full_outer")
    return both.select(F.coalesce("base", "target").alias("tid"), ranking.new_or_deleted(F.col("base"), F.col("target")).alias("fresh"))


# aggregates, reports


@query(f"SELECT tid, depth, sum(exclusive)::BIGINT AS exclusive FROM {_EXCL} GROUP BY tid, depth")
def level_exclusive(spark, sf_dir):
    return aggregates.level_exclusive(calls.exclusive_time(calls.pair_calls(views.nested_calls(spark, sf_dir).withColumnRenamed("func", "probe_id"))))


@query(f"SELECT profile_id, uid, location, round(sum(y * 1000) / 1e6, 4) AS exclusive FROM {_XY} GROUP BY ALL")
def exclusive_by_function(spark, sf_dir):
    rows = S(spark, sf_dir).withColumn("exclusive", F.col("amount") * 1000)
    return rounded(aggregates.exclusive_by_function(rows, "profile_id"))


@query(f"""SELECT side, uid, trace, round(amount, 2) AS amount, round(round(100 * amount / sum(amount) OVER (PARTITION BY side), 2), 2) AS percent,
  row_number() OVER (PARTITION BY side ORDER BY amount DESC, uid, trace)::INT AS rank FROM (
  SELECT CASE version WHEN '1996' THEN 'baseline' ELSE 'target' END AS side, uid, trace, sum(amount) AS amount FROM {ORDERS} WHERE version IN ('1996', '1997') GROUP BY ALL)""")
def diff_report(spark, sf_dir):
    rows = O(spark, sf_dir).withColumn("trace", F.array_join(scalars.funcs(F.col("trace")), ","))
    return rounded(checks.diff_report(rows.where("version = '1996'"), rows.where("version = '1997'")), 2)


@query(f"""SELECT target_id, baseline_id FROM {sql._PARENTS} WHERE version = '2024-01-10'""")
def history_pairs(spark, sf_dir):
    return plugins.history_pairs(V(spark, sf_dir), P(spark, sf_dir), version="2024-01-10").select("target_id", "baseline_id")


# calls and graphs


@query(f"""WITH s AS (SELECT tid, 'click#click' AS uid, "order" - lag("order") OVER (PARTITION BY tid ORDER BY "order") AS amount FROM {EVENTS} WHERE uid = 'click'),
  p AS (SELECT tid, uid, "order" AS t, lead("order") OVER w AS e, lead(uid) OVER w AS u FROM {EVENTS} WHERE uid IN ('view', 'error') WINDOW w AS (PARTITION BY tid ORDER BY "order"))
  SELECT tid, uid, count(*) AS n, sum(amount)::BIGINT AS amount FROM (SELECT * FROM s WHERE amount IS NOT NULL UNION ALL SELECT tid, 'view#error', e - t FROM p WHERE uid = 'view' AND u = 'error') GROUP BY ALL""")
def pair_usdt(spark, sf_dir):
    e, uid = E(spark, sf_dir).where("uid IN ('click', 'view', 'error')"), F.col("uid")
    records = e.select("tid", F.col("order").alias("timestamp"), uid.alias("probe_id"), F.when(uid != "click", "p").alias("pair_id"), F.when(uid == "view", 1).when(uid == "error", -1).otherwise(0).alias("step"))
    return calls.pair_usdt(records).groupBy("tid", "uid").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(f"""SELECT tid AS pid, uid AS probe_id, hi - lo AS amount FROM (SELECT tid, uid, min("order") FILTER (WHERE snapshot < 12) AS lo, max("order") FILTER (WHERE snapshot >= 12) AS hi FROM {EVENTS}
  WHERE uid IN ('click', 'view') GROUP BY ALL) WHERE lo IS NOT NULL AND hi IS NOT NULL""")
def process_spans(spark, sf_dir):
    kind = F.when(F.col("snapshot") < 12, calls.PROCESS_BEGIN).otherwise(calls.PROCESS_END)
    records = E(spark, sf_dir).select(kind.alias("record_type"), F.col("tid").alias("pid"), F.col("uid").alias("probe_id"), F.col("order").alias("timestamp"))
    return calls.process_spans(records, ["click", "view"]).select("pid", "probe_id", "amount")


@query(f"""WITH RECURSIVE p AS (SELECT tid + 1 AS pid, (tid + 1) // 2 AS ppid, count(DISTINCT uid) AS n FROM {EVENTS} GROUP BY tid),
  l(pid, level) AS (SELECT pid, 0 FROM p WHERE ppid NOT IN (SELECT pid FROM p) UNION ALL SELECT p.pid, level + 1 FROM l JOIN p ON p.ppid = l.pid)
  SELECT p.pid, p.ppid, level, coalesce(c.k, 0)::INT AS children, n::INT AS threads, c.k IS NULL AS bottom FROM p JOIN l USING (pid) LEFT JOIN (SELECT ppid AS pid, count(*) AS k FROM p GROUP BY 1) c ON c.pid = p.pid""")
def process_hierarchy(spark, sf_dir):
    """Users as a binary tree of processes, each event type a thread."""
    kinds = F.expr("CASE uid WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END")
    records = E(spark, sf_dir).select((F.col("tid") + 1).alias("pid"), F.expr("(tid + 1) div 2").alias("ppid"), kinds.alias("tid"))
    return calls.process_hierarchy(records).select("pid", "ppid", "level", F.size("children").alias("children"), F.size("threads").alias("threads"), "bottom")


@query(f"""WITH e AS (SELECT * FROM {views.CALL_EDGES}) SELECT DISTINCT caller, callee FROM e WHERE version IN ('1995', '1996') AND NOT (version = '1996' AND caller = 'main')""")
def mixed_call_graph(spark, sf_dir):
    e = views.call_edges(spark, sf_dir)
    return graph.mixed_call_graph(e.where("version = '1995'"), e.where("version = '1996' AND caller <> 'main'"))


@query(f"""SELECT func FROM {sql._FUNCTIONS.format(views.CALL_EDGES, "version = '1995'")} EXCEPT
  SELECT func FROM {sql._FUNCTIONS.format(views.CALL_EDGES, "version = '1996' AND caller NOT LIKE '%_1_' AND callee NOT LIKE '%_1_'")}""")
def deleted_functions(spark, sf_dir):
    e = views.call_edges(spark, sf_dir)
    return graph.deleted_functions(e.where("version = '1995'"), e.where("version = '1996' AND caller NOT LIKE '%_1_' AND callee NOT LIKE '%_1_'"))


_STATS = f"(SELECT version || uid AS uid, count(*) AS n, quantile_cont(amount, 0.5) AS med, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS iqr FROM {EVENTS} GROUP BY 1)"


def _stats(spark, sf_dir: str) -> DataFrame:
    return aggregates.function_stats(E(spark, sf_dir).withColumn("uid", F.concat("version", "uid")), exclusive="amount")


@query(f"SELECT uid, n AS count FROM {_STATS} WHERE n > 6")
def filter_hot_calls(spark, sf_dir):
    return graph.filter_hot_calls(_stats(spark, sf_dir), 6).select("uid", "count")


@query(f"SELECT uid, n AS count FROM {_STATS.replace('version || uid', 'version || uid || snapshot')} WHERE n > 1 AND (iqr < 0.05 * med OR med <= 10)")
def filter_constant(spark, sf_dir):
    hourly = E(spark, sf_dir).withColumn("uid", F.concat("version", "uid", F.col("snapshot").cast("string")))
    return graph.filter_constant(aggregates.function_stats(hourly, exclusive="amount"), 1).select("uid", "count")


_OUT = "(SELECT c_mktsegment FROM customer UNION SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)"


@query(f"SELECT caller, callee FROM {sql._EDGES} WHERE callee NOT IN {_OUT}")
def remove_filtered(spark, sf_dir):
    """Segments go as leaves; then some nations are leaves and go as well."""
    nation = views.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("func"))
    segment = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("func")).distinct()
    return graph.remove_filtered(_edges(spark, sf_dir), segment.union(nation))


@query(f"""{_REACH}, l AS (SELECT func, max(level) AS level FROM reach GROUP BY func), b AS (SELECT n_name AS func, CASE n_nationkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS rank FROM nation)
  SELECT l.func, rank FROM l LEFT JOIN b USING (func) WHERE level < 1 OR rank IS NULL OR rank > 3""")
def filter_complexity(spark, sf_dir):
    bound = F.concat(F.lit("O(n^"), (F.col("n_nationkey") % 7).cast("string"), F.lit(")"))
    bounds = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("func"), bound.alias("bound"))
    return graph.filter_complexity(bounds, graph.graph_levels(_edges(spark, sf_dir)), 3)


_BLOCKS = f"(SELECT version, n_name AS func, subtype, list_sort(list_distinct(list(uid))) AS ops FROM {ORDERS} GROUP BY ALL)"


@query(f"""WITH b AS (SELECT * FROM {_BLOCKS} WHERE version = '1996'), t AS (SELECT * FROM {_BLOCKS} WHERE version = '1997')
  SELECT DISTINCT func FROM (SELECT coalesce(b.func, t.func) AS func, b.ops AS x, t.ops AS y FROM b FULL JOIN t ON b.func = t.func AND b.subtype = t.subtype)
  WHERE x IS DISTINCT FROM y AND func IN (SELECT func FROM b) AND func IN (SELECT func FROM t)""")
def diff_cfg(spark, sf_dir):
    """Blocks by order priority, operations the market segments."""
    rows = O(spark, sf_dir).groupBy("version", F.col("trace")[1]["func"].alias("func"), F.col("subtype").alias("position")).agg(F.sort_array(F.collect_set("uid")).alias("opcodes"))
    rows = rows.withColumn("operands", F.col("opcodes")).withColumn("successors", F.array().cast("array<string>"))
    return graph.diff_cfg(rows.where("version = '1996'"), rows.where("version = '1997'"))


@query(f"""SELECT DISTINCT callee AS func FROM {sql._EDGES} WHERE callee LIKE '%5'""")
def recursive_functions(spark, sf_dir):
    e = _edges(spark, sf_dir)
    loops = e.where("callee LIKE '%5'").select(F.col("callee").alias("caller"), "callee")
    return graph.recursive(e.union(loops))


@query(f"""SELECT callee AS func FROM {sql._EDGES} EXCEPT SELECT caller FROM {sql._EDGES}""")
def bottom_functions(spark, sf_dir):
    return graph.bottom(_edges(spark, sf_dir))
