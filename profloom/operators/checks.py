"""Change detection between a baseline and a target.

Every check takes both sides as frames grouped by the same ``keys`` (for example a pair id), so
a whole version history is one job over all pairs: see ``check_history``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.functions.scalars import classify_change, growth_rank, integral_param, integral_points, model_value, safe_div
from profloom.operators.aggregates import NS_PER_MS, mean_amount_by_uid, total_by_location
from profloom.operators.graph import keep
from profloom.operators.joins import join_averages, join_baseline_target, join_model_quadruple, join_models
from profloom.operators.models import fit_all
from profloom.operators.windows import best_model_per_uid, local_windows, merge_intervals

DEGRADED, OPTIMIZED = 2.0, 0.5
LEAST_CONFIDENCE = 0.9
POINTS = 1000
SAME_COEFFICIENTS, CERTAIN = 0.05, 25.0
INTEGRAL = (0.10, 0.25)
STATISTIC, STATISTICS_CHANGED = (0.10, 0.25), (0.20, 0.50)
STATISTICS = ("int", "avg", "med", "max", "min", "sum", "q1", "q3")


def average_amount_threshold(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Ratio of mean amounts per function."""
    both = join_averages(mean_amount_by_uid(baseline, *keys), mean_amount_by_uid(target, *keys), *keys)
    rate = safe_div(F.col("target"), F.col("base"))
    result = F.when(rate >= DEGRADED, "Degradation").when((rate > 0) & (rate <= OPTIMIZED), "Optimization").otherwise("NoChange")
    return both.select(*keys, "uid", "base", "target", rate.alias("rate"), result.alias("result"))


def best_model_order_equality(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Growth class of the best models; the rate is the difference of their ranks."""
    both = join_models(baseline, target, *keys)
    confidence = F.least("base_r_square", "target_r_square")
    b, t = growth_rank(F.col("base_model")), growth_rank(F.col("target_model"))
    changed = (confidence >= LEAST_CONFIDENCE) & (F.col("base_model") != F.col("target_model"))
    result = F.when(~changed, "NoChange").when(b > t, "Optimization").otherwise("Degradation")
    return both.select(*keys, "uid", "base_model", "target_model", confidence.alias("confidence"), F.when(changed, t - b).otherwise(0).alias("rate"), result.alias("result"))


def _curve(prefix: str, x: Column) -> Column:
    return model_value(*[F.col(f"{prefix}_{c}") for c in ("model", "b0", "b1", "b2")], x)


def _steps(prefix: str) -> Column:
    lo, hi = F.col(f"{prefix}_x_start"), F.col(f"{prefix}_x_end")
    x = lo + F.col("i") * (hi - lo) / (POINTS - 1)
    return F.when(x == 0, F.lit(1e-6)).otherwise(x)


def error_points(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """(keys, uid, models..., i, x, error, relative, linear_error): both best curves at 1000 points of their own ranges.

    Points are made after the join on uid, so only functions that both sides model have any.
    """
    quad = join_model_quadruple(baseline, target, *keys)
    rows = quad.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    b, t = _curve("base", _steps("base")), _curve("target", _steps("target"))
    lin = _curve("target_linear", _steps("target_linear")) - _curve("base_linear", _steps("base_linear"))
    rows = rows.withColumn("x", _steps("base")).withColumn("base_y", b).withColumn("error", t - b).withColumn("linear_error", lin)
    return rows.withColumn("relative", F.coalesce(F.try_divide("error", "base_y"), F.lit(0.0)))


def general_detection(baseline: DataFrame, target: DataFrame, *keys: str, kind: str | None = None) -> DataFrame:
    """Mean relative error of the best curves, judged by sign and size; ``kind`` adds the type of change.

    Kinds: ``polynomial_regression``, ``linear_regression``, ``fast_check``.
    """
    pts = error_points(baseline, target, *keys)
    pts = pts if kind is None else keep(pts)
    same = reduce(lambda a, c: a & (F.abs(F.col(f"target_{c}") - F.col(f"base_{c}")) <= SAME_COEFFICIENTS * F.abs(F.col(f"base_{c}"))), ("b0", "b1"), F.lit(True))
    head = lambda c: F.first(c).alias(c)
    sums = pts.withColumn("same", same).groupBy(*keys, "uid").agg(
        (F.sum("relative") / POINTS * 100).alias("rate"), F.sum("error").alias("total"), F.max("error").alias("top"), head("same"), head("base_model"), head("target_model"),
        head("base_linear_b1"), head("target_linear_b1"), F.least(F.first("base_linear_r_square"), F.first("target_linear_r_square")).alias("confidence"),
    )
    up = F.when(F.col("rate") > CERTAIN, "Degradation").otherwise("MaybeDegradation")
    down = F.when(F.col("rate") < -CERTAIN, "Optimization").otherwise("MaybeOptimization")
    found = sums.withColumn("result", F.when(F.col("same"), "NoChange").when(F.col("total") > 0, up).otherwise(down))
    out = ["base_model", "target_model", "rate", "confidence", "result"]
    if kind is not None:
        types = {"polynomial_regression": polynomial_type, "linear_regression": linear_type, "fast_check": fast_type}[kind](pts, found, *keys)
        found = found.join(types, [*keys, "uid"], "left")
        out.append("change_type")
    return found.select(*keys, "uid", *out)


def fast_type(pts: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The kind of model that fits the error series best."""
    fits = fit_all(pts, *keys, "uid", x="x", y="error")
    return best_model_per_uid(fits, *keys, "uid").select(*keys, "uid", F.upper("model").alias("change_type"))


def linear_type(pts: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Constant, linear or quadratic by a regression of the linear models' error, else the best kind.

    A slope near that of the difference of both linear models is a linear change; none is a constant one.
    """
    line = pts.groupBy(*keys, "uid").agg(F.regr_slope("linear_error", "x").alias("slope"), F.regr_intercept("linear_error", "x").alias("intercept"))
    best = best_model_per_uid(fit_all(pts, *keys, "uid", x="x", y="error"), *keys, "uid").select(*keys, "uid", F.col("model").alias("kind"))
    joined = line.join(found.select(*keys, "uid", "top", "base_linear_b1", "target_linear_b1", "base_model", "target_model"), [*keys, "uid"]).join(best, [*keys, "uid"], "left")
    tol = F.abs(0.05 * F.col("top"))
    diff = F.col("target_linear_b1") - F.col("base_linear_b1")
    grown = F.when(F.col("base_model") == F.col("target_model"), F.coalesce("kind", F.lit("quadratic"))).otherwise(F.col("target_model"))
    kind = F.when(F.abs(diff) <= 1e-9 * (1 + F.abs("base_linear_b1")), "constant").when((F.abs(F.col("slope") - diff) <= 1e-6 * (1 + F.abs(diff))) & (F.abs("intercept") <= tol), "linear").otherwise(grown)
    return joined.select(*keys, "uid", F.upper(kind).alias("change_type"))


RESIDUAL = 1e8


def polynomial_type(pts: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The lowest degree up to 3 whose least-squares residual on the linear error is small.

    The points are evenly numbered, so polynomials orthogonal over them are known beforehand and
    each degree takes its own share off the sum of squares: five sums a function, no equations.
    """
    at = [(i - (POINTS - 1) / 2) / (POINTS / 2) for i in range(POINTS)]
    m2, m4 = (sum(x**p for x in at) / POINTS for p in (2, 4))
    u = (F.col("i") - (POINTS - 1) / 2) / (POINTS / 2)
    basis = (F.lit(1.0), u, u * u - m2, u * u * u - m4 / m2 * u)
    y = F.col("linear_error")
    share = lambda p: F.sum(p * y) * F.sum(p * y) / F.sum(p * p)
    sums = pts.groupBy(*keys, "uid").agg(F.sum(y * y).alias("yy"), *[share(p).alias(f"c{d}") for d, p in enumerate(basis)])
    kind, rest = F.lit("CUBIC"), [F.col("yy") - reduce(lambda t, c: t + c, [F.col(f"c{d}") for d in range(k + 1)]) for k in range(3)]
    for label, left in reversed(list(zip(("CONSTANT", "LINEAR", "QUADRATIC"), rest, strict=True))):
        kind = F.when(left < RESIDUAL, label).otherwise(kind)
    return sums.select(*keys, "uid", kind.alias("change_type"))


def integral_comparison(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Relative difference of the areas under the best curves."""
    both = join_models(baseline, target, *keys)
    area = lambda p: integral_param(*[F.col(f"{p}_{c}") for c in ("model", "b0", "b1", "b2", "x_start", "x_end")])
    both = both.withColumn("base_area", area("base")).withColumn("target_area", area("target"))
    rate = F.coalesce(safe_div(F.col("target_area") - F.col("base_area"), F.col("base_area")), F.lit(0.0))
    return both.select(*keys, "uid", "base_area", "target_area", F.round(rate, 2).alias("rate"), classify_change(rate, *INTEGRAL).alias("result"))


def integral_comparison_nonparam(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """The same over bucketed models, by the points of their steps, after equalising their lengths."""
    on = [*keys, "uid"]
    both = align_nonparam(baseline, target, *keys)
    grid = lambda c: F.transform(c, lambda y, i: F.struct((F.col("x_start") + i * (F.col("x_end") - F.col("x_start")) / F.greatest(F.size(c) - 1, F.lit(1))).alias("x"), y.alias("y")))
    both = both.withColumn("base_area", integral_points(grid(F.col("base_stats")))).withColumn("target_area", integral_points(grid(F.col("target_stats"))))
    rate = F.coalesce(safe_div(F.col("target_area") - F.col("base_area"), F.col("base_area")), F.lit(0.0))
    return both.select(*on, F.round(rate, 2).alias("rate"), classify_change(rate, *INTEGRAL).alias("result"))


def align_nonparam(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """(keys, uid, x_start, x_end, base_stats, target_stats): both sides cut to the shorter one's length.

    A target regressogram is better refitted first, with ``regressogram(buckets=<column of baseline counts>)``.
    """
    on = [*keys, "uid"]
    b = baseline.select(*on, "x_start", "x_end", F.col("bucket_stats").alias("bs"))
    both = b.join(target.select(*on, F.col("bucket_stats").alias("ts")), on)
    n = F.least(F.size("bs"), F.size("ts"))
    return both.select(*on, "x_start", "x_end", F.slice("bs", 1, n).alias("base_stats"), F.slice("ts", 1, n).alias("target_stats"))


def local_statistics(baseline: DataFrame, target: DataFrame, *keys: str, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(changes, intervals): eight statistics per block of both series; blocks by scores, functions by mean error."""
    on = [*keys, "uid", "block"]
    b, t = (local_windows(p, *keys, "uid", x=x, y=y) for p in (baseline, target))
    edges = t.select(*on, "x_start", "x_end", *[F.col(s).alias(f"t_{s}") for s in STATISTICS])
    both = b.select(*on, *STATISTICS).join(edges, on)
    errors = [F.when(F.col(s) == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col(f"t_{s}") - F.col(s), F.col(s)), F.lit(0.0))) for s in STATISTICS]

    def score(e: Column) -> Column:
        size = F.abs(e)
        return F.when(size <= STATISTIC[0], 0.0).otherwise(F.signum(e) * F.when(size <= STATISTIC[1], 0.5).otherwise(1.0))

    total = reduce(lambda a, c: a + c, map(score, errors))
    blocks = both.select(*on, "x_start", "x_end", (reduce(lambda a, c: a + c, errors) / len(STATISTICS)).alias("rate"), classify_change(total, *STATISTICS_CHANGED, scale=len(STATISTICS)).alias("result"))
    rate = F.avg("rate")
    changes = blocks.groupBy(*keys, "uid").agg(F.round(rate, 2).alias("rate"), classify_change(rate, *STATISTIC).alias("result"))
    return changes, merge_intervals(blocks, *keys, "uid")


MZS_FACTOR, MZS_CUTOFF, IQR_CUTOFF, STD_CUTOFF = 0.6745, 3.5, 1.5, 2.0


def exclusive_diff(baseline: DataFrame, target: DataFrame, *keys: str, compat: bool = False) -> DataFrame:
    """(keys, uid, location, base, target, delta, share): exclusive times in ms, delta and its percentage of the target's total."""
    agg = lambda df: df.groupBy(*keys, "uid", "location").agg((F.sum("exclusive") / NS_PER_MS).alias("exclusive"))
    both = join_baseline_target(agg(baseline), agg(target), *keys, compat=compat)
    both = both.withColumn("delta", F.coalesce("target", F.lit(0.0)) - F.coalesce("base", F.lit(0.0)))
    total = both.groupBy(*keys).agg(F.sum("target").alias("all_target")) if keys else both.agg(F.sum("target").alias("all_target"))
    joined = both.join(total, list(keys)) if keys else both.join(total)
    return joined.withColumn("share", F.coalesce(F.try_divide(100 * F.col("delta"), F.col("all_target")), F.lit(0.0))).drop("all_target")


def exclusive_time_outliers(diff: DataFrame, *keys: str, cut_off: float = 0.0, compat: bool = False) -> DataFrame:
    """Severity of each function's delta among all deltas of its pair.

    Two passes: quartiles and the median, then the median deviation; then the deviation of
    what neither test flagged. All are aggregates per pair, joined back.
    """
    back = lambda df, about: df.join(about, list(keys)) if keys else df.join(about)
    q = F.percentile("delta", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = back(diff, diff.groupBy(*keys).agg(q.alias("q")))
    d = d.withColumns({"q1": F.col("q")[0], "med": F.col("q")[1], "q3": F.col("q")[2]}).drop("q").withColumn("iqr", F.col("q3") - F.col("q1"))
    d = d.withColumn("ad", F.abs(F.col("delta") - F.col("med")))
    d = back(d, d.groupBy(*keys).agg(F.percentile("ad", F.lit(0.5)).alias("mad")))
    d = d.withColumn("mzs", F.when(F.col("mad") == 0, F.when(F.col("ad") > 0, float("inf")).otherwise(0.0)).otherwise(MZS_FACTOR * F.try_divide("ad", "mad")))
    low, high = F.col("delta") < F.col("q1") - IQR_CUTOFF * F.col("iqr"), F.col("delta") > F.col("q3") + IQR_CUTOFF * F.col("iqr")
    over = F.try_divide(F.col("delta"), F.col("iqr")) - F.col("q3") if compat else F.try_divide(F.col("delta") - F.col("q3"), F.col("iqr"))
    under = F.try_divide(F.col("q1") - F.col("delta"), F.col("iqr"))
    d = d.withColumn("iqr_flag", low | high).withColumn("iqr_multiple", F.when(low, under).when(high, over)).withColumn("mzs_flag", F.col("mzs") > MZS_CUTOFF)
    rest = d.where("NOT mzs_flag AND NOT iqr_flag")
    spread = rest.groupBy(*keys).agg(F.stddev_samp("delta").alias("std"))
    d = d.join(spread, list(keys), "left") if keys else d.join(spread)
    d = d.withColumn("std_multiple", F.try_divide("delta", "std")).withColumn("std_flag", F.coalesce(F.abs("std_multiple") > STD_CUTOFF, F.lit(False)))
    named = lambda prefix: F.when(F.col("delta") > 0, prefix + "Degradation").otherwise(prefix + "Optimization")
    result = F.when(F.col("mzs_flag"), named("Severe")).when(F.col("iqr_flag"), named("")).when(F.col("std_flag"), named("Maybe")).otherwise("NoChange")
    new = F.when(F.col("base").isNull(), "NotInBaseline").when(F.col("target").isNull(), "NotInTarget")
    by_iqr = F.col("mzs_flag") | F.col("iqr_flag")
    kind, confidence = F.when(by_iqr, "IQR_multiple").otherwise("StdDev_multiple"), F.when(by_iqr, F.col("iqr_multiple")).otherwise(F.col("std_multiple"))
    shown = d.where(F.abs("share") >= cut_off)
    return shown.select(
        *keys, "uid", "location", F.round("base", 3).alias("base"), F.round("target", 3).alias("target"), F.col("delta").alias("rate"), F.col("share").alias("rate_relative"),
        F.coalesce(new, result).alias("result"), kind.alias("confidence_type"), F.round(confidence, 2).alias("confidence"),
    )


def outlier_report(baseline: DataFrame, target: DataFrame, *keys: str, **options) -> DataFrame:
    """Functions and location totals in one list."""
    diff = exclusive_diff(baseline, target, *keys)
    rows = exclusive_time_outliers(diff, *keys, **options)
    total = total_by_location(diff, *keys)
    total = total.select(
        *keys, F.lit(None).cast("string").alias("uid"), "location", F.round("base", 3).alias("base"), F.round("target", 3).alias("target"), F.col("delta").alias("rate"),
        F.col("share").alias("rate_relative"), "result", F.lit("N/A").alias("confidence_type"), F.lit(None).cast("double").alias("confidence"),
    )
    return rows.unionByName(total)


LEAST_MODEL = 0.15
#: Strategies that are two others, one after the other.
BOTH = {"best-both": ("best-param", "best-nonparam"), "all-models": ("all-param", "all-nonparam")}


def _is_param() -> Column:
    return F.col("b0").isNotNull()


def any_integral_comparison(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Relative difference of the areas under models of any kind, one a function and side: curves by antiderivative, buckets by their points."""
    step = F.try_divide(F.col("x_end") - F.col("x_start"), (F.size("bucket_stats") - 1).cast("double"))
    points = F.transform("bucket_stats", lambda y, i: F.struct((F.col("x_start") + i * F.coalesce(step, F.lit(0.0))).alias("x"), y.alias("y")))
    curve = integral_param(*[F.col(c) for c in ("model", "b0", "b1", "b2", "x_start", "x_end")])
    area = F.when(_is_param(), curve).otherwise(integral_points(points))
    side = lambda m, p: m.select(*keys, "uid", F.col("model").alias(f"{p}_model"), area.alias(f"{p}_area"))
    both = side(baseline, "base").join(side(target, "target"), [*keys, "uid"])
    rate = F.coalesce(safe_div(F.col("target_area") - F.col("base_area"), F.col("base_area")), F.lit(0.0))
    return both.select(*keys, "uid", "base_model", "target_model", F.round(rate, 2).alias("rate"), classify_change(rate, *INTEGRAL).alias("result"))


def run_with_models(baseline: DataFrame, target: DataFrame, *keys: str, strategy: str = "best-param", check=None) -> DataFrame:
    """A check over models of sufficient fit, chosen by strategy.

    ``best-param`` and ``best-nonparam`` compare each function's best model of the group, ``all-`` those of
    equal kind (then ``kind`` is a key), ``best-model`` the best of both groups, which may differ in
    kind; ``best-both`` and ``all-models`` are both groups' rows (keys, strategy, uid, rate, result).
    ``check``, for parametric models, takes two frames and keys (default: ``integral_comparison``).
    """
    if strategy in BOTH:
        parts = [run_with_models(baseline, target, *keys, strategy=s, check=check).select(*keys, F.lit(s).alias("strategy"), "uid", "rate", "result") for s in BOTH[strategy]]
        return parts[0].unionByName(parts[1])
    which, group = strategy.split("-")
    if which not in ("best", "all") or group not in ("param", "nonparam", "model") or strategy == "all-model":
        raise ValueError(f"unknown strategy: {strategy}")
    fits = F.col("r_square") >= LEAST_MODEL
    if group == "model":
        best = lambda m: best_model_per_uid(m.where(fits), *keys, "uid")
        return any_integral_comparison(best(baseline), best(target), *keys)
    of_group = _is_param() if group == "param" else F.col("bucket_stats").isNotNull()
    b, t = baseline.where(fits & of_group), target.where(fits & of_group)
    check = integral_comparison_nonparam if group == "nonparam" else check or integral_comparison
    if which == "best":
        return check(best_model_per_uid(b, *keys, "uid"), best_model_per_uid(t, *keys, "uid"), *keys)
    by_kind = lambda m: m.withColumn("kind", F.col("model"))
    return check(by_kind(b), by_kind(t), *keys, "kind")


def check_history(pairs: DataFrame, rows: DataFrame, check, *, id_col: str = "profile_id") -> DataFrame:
    """One job over all (baseline_id, target_id) pairs: ``check(baseline, target, 'pair_id')`` on rows of both sides."""
    p = pairs.withColumn("pair_id", F.concat_ws("..", "baseline_id", "target_id"))
    side = lambda c: rows.join(p.select("pair_id", F.col(c).alias(id_col)), id_col)
    return check(side("baseline_id"), side("target_id"), "pair_id")


def check_profiles(baseline: DataFrame, target: DataFrame, check, *keys: str) -> DataFrame:
    """One check, given as a function or by its name, over two sides."""
    return (CHECKS[check] if isinstance(check, str) else check)(baseline, target, *keys)


#: Checks by name, for rules and plug-ins.
CHECKS = {
    "average_amount_threshold": average_amount_threshold,
    "best_model_order_equality": best_model_order_equality,
    "polynomial_regression": lambda b, t, *k: general_detection(b, t, *k, kind="polynomial_regression"),
    "linear_regression": lambda b, t, *k: general_detection(b, t, *k, kind="linear_regression"),
    "fast_check": lambda b, t, *k: general_detection(b, t, *k, kind="fast_check"),
    "integral_comparison": integral_comparison,
    "local_statistics": lambda b, t, *k: local_statistics(b, t, *k)[0],
    "exclusive_time_outliers": outlier_report,
}


@contextmanager
def registered_check(name: str, check) -> Iterator[None]:
    """Inside, ``name`` is a check: a function of two frames and key names that returns changes."""
    register_check(name, check)
    try:
        yield
    finally:
        del CHECKS[name]


def register_check(name: str, check) -> None:
    """Add a check under a free name."""
    if name in CHECKS:
        raise ValueError(f"there is a check of this name: {name}")
    CHECKS[name] = check


def diff_report(baseline: DataFrame, target: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Ranked trace totals of both sides, marked by side; with run headers when profiles are given."""
    from profloom.operators.aggregates import trace_totals

    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("amount"), "uid", "trace"))
    one = lambda df, side: trace_totals(df).withColumn("side", F.lit(side))
    both = one(baseline, "baseline").unionByName(one(target, "target")).withColumn("rank", rank)
    if profiles is None:
        return both
    return both.join(profiles.select("side", "cmd", "workload", "collector"), "side", "left")
