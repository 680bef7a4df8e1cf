"""Parametric models of cost by size, fitted as grouped aggregates.

A fit is sums, and sums add up: one partial and final aggregation fits every model of every
group, so a hot function costs no more than its rows. Points with x or y outside a model's
domain are skipped for that model alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.functions.scalars import TINY, model_value
from profloom.operators import scan
from profloom.operators.graph import keep
from profloom.operators.windows import best_model_per_uid

MIN_POINTS = 3
#: Slope (as an angle over 90) from which a constant is judged by the slope and not by its lack.
FLAT = 0.01
#: Determinant of the parabola, as a share of the fourth moment, that rounding alone can leave.
UNDETERMINED = 1e-10
#: A prime and a primitive root of it: multiplying ordinals by a power of the root shuffles them.
PRIME, ROOT = 2_147_483_647, 16_807


@dataclass(frozen=True)
class Kind:
    """A model that is a line through (f_x(x), f_y(y)), whose intercept and slope f_a and f_b turn into b0 and b1.

    All four map Columns to Columns; a null f_x or f_y leaves a point out.
    """

    name: str
    f_x: Callable[[Column], Column]
    f_y: Callable[[Column], Column]
    f_a: Callable[[Column], Column] = lambda a: a
    f_b: Callable[[Column], Column] = lambda b: b


def _positive(f):
    return lambda c: F.when(c > 0, f(c))


def _same(c: Column) -> Column:
    return c


def _power_of_ten(c: Column) -> Column:
    return F.pow(F.lit(10.0), c)


LINES = (
    Kind("linear", _same, _same),
    Kind("logarithmic", _positive(F.ln), _same),
    Kind("power", _positive(F.log10), _positive(F.log10), _power_of_ten),
    Kind("exponential", _same, _positive(F.log10), _power_of_ten, _power_of_ten),
)
#: Models that are derived from the moments of the linear one.
DERIVED = ("constant", "quadratic")


def _lines(kinds: tuple[str | Kind, ...] | None) -> tuple[Kind, ...]:
    """The lines that the wanted kinds need; none named: all of the library's."""
    if kinds is None:
        return LINES
    own = tuple(k for k in kinds if isinstance(k, Kind))
    names = {k for k in kinds if not isinstance(k, Kind)}
    if unknown := names - {k.name for k in LINES} - {*DERIVED}:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    return tuple(k for k in LINES if k.name in names or k.name == "linear" and names & {*DERIVED}) + own


def moments(points: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount", kinds: tuple[str | Kind, ...] | None = None) -> DataFrame:
    """(keys, a struct per line): number, means and central sums of each line's transformed points, in one aggregation.

    ``suu``, ``svv`` and ``suv`` are sums of squares and products about the means; the linear one
    also has ``s3``, ``s4`` and ``suuv``, if a parabola is wanted. They come from variance,
    covariance, skewness and kurtosis, which add up without large cancelling sums.
    """
    pts = points.select(*keys, F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    parabola = kinds is None or "quadratic" in kinds
    sums = []
    for k in _lines(kinds):
        u, v = k.f_x(F.col("x")), k.f_y(F.col("y"))
        ok = u.isNotNull() & v.isNotNull()
        u, v, at = F.when(ok, u), F.when(ok, v), F.when(ok, F.col("x"))
        n = F.count(u)
        parts = {"n": n, "mu": F.avg(u), "mv": F.avg(v), "suu": n * F.var_pop(u), "svv": n * F.var_pop(v), "suv": n * F.covar_pop(u, v), "lo": F.min(at), "hi": F.max(at)}
        if k.name == "linear" and parabola:
            s2 = n * F.var_pop(u)
            parts |= {"s3": F.skewness(u) * s2 * F.sqrt(F.var_pop(u)), "s4": (F.kurtosis(u) + 3) * s2 * F.var_pop(u), "suuv": n * F.covar_pop(u * u, v) - 2 * F.avg(u) * n * F.covar_pop(u, v)}
            parts |= {c: F.when(s2 > 0, parts[c]).otherwise(0.0) for c in ("s3", "s4")}
        sums.append(F.struct(*[c.alias(name) for name, c in parts.items()]).alias(k.name))
    return pts.groupBy(*keys).agg(*sums)


def models_of(sums: DataFrame, *keys: str, kinds: tuple[str | Kind, ...] | None = None, method: str = "full") -> DataFrame:
    """(keys, model, method, r_square, x_start, x_end, b0, b1, b2, n): the models that ``moments`` determine."""
    wanted = {k.name if isinstance(k, Kind) else k for k in kinds} if kinds is not None else {k.name for k in LINES} | {*DERIVED}
    lines = _lines(kinds)
    found = [_line(k) for k in lines if k.name in wanted]
    found += [_flat()] if "constant" in wanted else []
    found += [_parabola()] if "quadratic" in wanted else []
    rows = sums.select(*keys, F.explode(F.filter(F.array(*found), lambda f: f.r_square.isNotNull() & (f.n >= MIN_POINTS))).alias("f"))
    return rows.select(*keys, "f.*").withColumn("method", F.lit(method))


def fit_all(
    points: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount", method: str = "full", kinds: tuple[str | Kind, ...] | None = None
) -> DataFrame:
    """(keys, model, method, r_square, x_start, x_end, b0, b1, b2, n): every model of every group, or those of ``kinds``.

    One scan and one aggregation of the sums that the wanted kinds need. The parabola is left out
    where fewer than three distinct sizes leave it undetermined.
    """
    return models_of(moments(points, *keys, x=x, y=y, kinds=kinds), *keys, kinds=kinds, method=method)


def _model(model: str, r2, lo, hi, b0, b1, b2, n) -> Column:
    of = lambda c, name: c.cast("double").alias(name)
    return F.struct(F.lit(model).alias("model"), of(r2, "r_square"), of(lo, "x_start"), of(hi, "x_end"), of(b0, "b0"), of(b1, "b1"), of(b2, "b2"), n.alias("n"))


def _straight(m: Column) -> tuple[Column, Column, Column]:
    """(intercept, slope, r2) of a line's moments; r2 is 1 for a flat series, all are null without two sizes."""
    slope = F.when(m.suu > 0, F.try_divide(m.suv, m.suu))
    r2 = F.when(m.svv > 0, F.try_divide(m.suv * m.suv, m.suu * m.svv)).otherwise(1.0)
    return m.mv - slope * m.mu, slope, F.when(slope.isNotNull(), r2)


def _line(kind: Kind) -> Column:
    m = F.col(kind.name)
    intercept, slope, r2 = _straight(m)
    return _model(kind.name, r2, m.lo, m.hi, kind.f_a(intercept), kind.f_b(slope), F.lit(None), m.n)


def _flat() -> Column:
    """The constant model of a linear fit."""
    m = F.col("linear")
    _, slope, r2 = _straight(m)
    turn = F.atan2(F.abs(slope * m.hi), F.abs(m.hi - m.lo)) / 90
    fits = F.when(turn > FLAT, r2 * (1 - turn)).otherwise(1 - r2)
    return _model("constant", F.when(slope.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), fits))), m.lo, m.hi, m.mv, F.lit(0.0), F.lit(None), m.n)


def _parabola() -> Column:
    m = F.col("linear")
    det = m.s4 - F.try_divide(m.suu * m.suu, m.n) - F.try_divide(m.s3 * m.s3, m.suu)
    d = F.when(det > UNDETERMINED * m.s4, F.try_divide(m.suuv - F.try_divide(m.s3 * m.suv, m.suu), det))
    e = F.try_divide(m.suv - m.s3 * d, m.suu)
    r2 = F.when(d.isNotNull(), F.try_divide(e * m.suv + d * m.suuv, m.svv))
    return _model("quadratic", r2, m.lo, m.hi, m.mv - m.suu * d / m.n - e * m.mu + d * m.mu * m.mu, e - 2 * d * m.mu, d, m.n)


def _shifted(m: Column, cu: Column, cv: Column, high: bool) -> list[Column]:
    """Sums of powers and products about (cu, cv) from the central ones: these add up over parts."""
    d, e = m.mu - cu, m.mv - cv
    out = {"n": m.n, "u": m.n * d, "v": m.n * e, "uu": m.suu + m.n * d * d, "vv": m.svv + m.n * e * e, "uv": m.suv + m.n * d * e}
    if high:
        out |= {
            "u3": m.s3 + 3 * d * m.suu + m.n * d * d * d, "u4": m.s4 + 4 * d * m.s3 + 6 * d * d * m.suu + m.n * d * d * d * d,
            "uuv": m.suuv + 2 * d * m.suv + e * m.suu + m.n * d * d * e,
        }
    return [c.alias(name) for name, c in out.items()]


def _central(s: Column, cu: Column, cv: Column, high: bool) -> Column:
    """The moments back from sums about (cu, cv)."""
    d, e = F.try_divide(s.u, s.n), F.try_divide(s.v, s.n)
    suu, suv = F.greatest(F.lit(0.0), s.uu - s.n * d * d), s.uv - s.n * d * e
    out = {"n": s.n, "mu": cu + d, "mv": cv + e, "suu": suu, "svv": F.greatest(F.lit(0.0), s.vv - s.n * e * e), "suv": suv, "lo": s.lo, "hi": s.hi}
    if high:
        out |= {
            "s3": s.u3 - 3 * d * suu - s.n * d * d * d, "s4": s.u4 - 4 * d * s.u3 + 6 * d * d * s.uu - 3 * s.n * d * d * d * d,
            "suuv": s.uuv - 2 * d * suv - e * suu - s.n * d * d * e,
        }
    return F.struct(*[c.alias(name) for name, c in out.items()])


def merged_moments(parts: DataFrame, *keys: str, part: str = "part", kinds: tuple[str | Kind, ...] | None = None) -> DataFrame:
    """``moments`` of each part together with all parts before it, for ``parts(keys, part, a struct per line)``.

    The parts' sums are moved to one centre a group, added up by a running sum over the few rows
    of a group, and moved back. Points are read once, however many prefixes there are.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    out = parts
    for k in _lines(kinds):
        m = F.col(k.name)
        high = k.name == "linear" and "s3" in out.schema[k.name].dataType.names
        out = out.withColumn("_cu", F.try_divide(F.sum(m.n * m.mu).over(group), F.sum(m.n).over(group))).withColumn("_cv", F.try_divide(F.sum(m.n * m.mv).over(group), F.sum(m.n).over(group)))
        out = out.withColumn("_s", F.struct(*_shifted(m, F.col("_cu"), F.col("_cv"), high)))
        names = out.schema["_s"].dataType.names
        running = F.struct(*[F.sum(F.col("_s")[c]).over(upto).alias(c) for c in names], F.min(m.lo).over(upto).alias("lo"), F.max(m.hi).over(upto).alias("hi"))
        out = out.withColumn("_s", running).withColumn(k.name, _central(F.col("_s"), F.col("_cu"), F.col("_cv"), high)).drop("_s", "_cu", "_cv")
    return out


def fit(points: DataFrame, kind: str | Kind, *keys: str, **axes: str) -> DataFrame:
    return fit_all(points, *keys, **axes, kinds=(kind,))


def fit_interval(points: DataFrame, steps: int, *keys: str, x: str = "structure_unit_size", y: str = "amount", crowd: int | None = None) -> DataFrame:
    """Best model of each of ``steps`` equal parts along x."""
    parts = scan.dealt(points, steps, *keys, order=[x, y], crowd=crowd)
    return best_model_per_uid(fit_all(parts, *keys, "part", x=x, y=y, method="interval"), *keys, "part")


def prefix_fits(
    points: DataFrame, steps: int, *keys: str, x: str = "structure_unit_size", y: str = "amount", ordinal: str = "order", seed: int = 1, crowd: int | None = None
) -> DataFrame:
    """Every model on the first 1, 2, ... ``steps`` parts of the points in seeded random order, as (keys, step, model, ...).

    The order is that of the products of the ordinal with powers of a primitive root, modulo a prime.
    """
    column = F.col(f"`{ordinal}`").cast("long")
    factor = pow(ROOT, seed, PRIME)
    parts = scan.dealt(points, steps, *keys, order=[F.pmod(F.pmod(column, F.lit(PRIME)) * factor, F.lit(PRIME)), column], crowd=crowd)
    sums = moments(parts, *keys, "part", x=x, y=y)
    every = sums.select(*keys).distinct().withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(steps))))  # a part may be empty
    named = sums.select(*[F.col(c).alias(f"_m_{c}") if c in (*keys, "part") else F.col(c) for c in sums.columns])
    full = every.join(named, scan.same_keys(every, named, (*keys, "part"), "_m_"), "left").drop(*[f"_m_{c}" for c in (*keys, "part")])
    grown = merged_moments(full, *keys).withColumnRenamed("part", "step")
    return models_of(grown, *keys, "step")


def fit_initial_guess(points: DataFrame, steps: int, *keys: str, **options) -> DataFrame:
    """The kind that fits the first part best, fitted to all points."""
    fits = keep(prefix_fits(points, steps, *keys, **options))
    guess = best_model_per_uid(fits.where("step = 1"), *keys).select(*keys, "model")
    return _whole(fits, guess, steps, *keys).withColumn("method", F.lit("initial_guess"))


def _whole(fits: DataFrame, chosen: DataFrame, steps: int, *keys: str) -> DataFrame:
    """The fits of the last step whose kind was ``chosen``."""
    named = chosen.select(*[F.col(k).alias(f"_c_{k}") for k in (*keys, "model")])
    return fits.join(named, scan.same_keys(fits, named, (*keys, "model"), "_c_")).where(F.col("step") == steps).select(*[c for c in fits.columns if c != "step"])


def fit_iterative(points: DataFrame, steps: int, *keys: str, **options) -> DataFrame:
    """Of all kinds, always advance the one that fits best so far; the first to see all points wins.

    A kind waits at its worst fit until no other is better, so the first to arrive is the one
    whose worst fit over all steps is best; ties go by name. A kind without a fit at some step has none.
    """
    fits = keep(prefix_fits(points, steps, *keys, **options))
    worst = F.when(F.count("*") == steps, F.min("r_square")).otherwise(float("-inf"))
    raced = fits.groupBy(*keys, "model").agg(worst.alias("worst"))
    won = raced.groupBy(*keys).agg(F.min_by("model", F.struct((-F.col("worst")).alias("w"), "model")).alias("model"))
    return _whole(fits, won, steps, *keys).withColumn("method", F.lit("iterative"))


#: Segments that are sent to every task; where more are open, none holds a large share of a group.
_BROADCAST = 100_000


def _inside(rows: DataFrame, segments: DataFrame, keys: tuple[str, ...], level: int, few: bool) -> DataFrame:
    """Numbered rows inside ``segments(keys, segment, lo, n, rows)``, halved ``level`` times, with ``segment``, ``lo`` and ``n``.

    Both meet in 2^level equal bins of a group's numbers; a segment reaches into three at most.
    """
    bin_ = lambda at: F.floor(at / F.col("rows") * float(2**level))  # noqa: E731  (grows with the number, so a segment's bins lie between those of its ends)
    spread = segments.withColumn("_bin", F.explode(F.sequence(bin_(F.col("lo")), bin_(F.col("lo") + F.col("n") - 1)))).drop("rows")
    named = spread.select(*[F.col(c).alias(f"_s_{c}") if c in (*keys, "_bin") else F.col(c) for c in spread.columns])
    named, rows = F.broadcast(named) if few else named, rows.withColumn("_bin", bin_(F.col("row")))
    found = rows.join(named, scan.same_keys(rows, named, ("_bin", *keys), "_s_")).where("row >= lo AND row < lo + n")
    return found.drop("_bin", *[f"_s_{c}" for c in ("_bin", *keys)])


def fit_bisection(points: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount", crowd: int | None = None) -> DataFrame:
    """Segments along x, halved while a half's best kind differs from the whole's; too small halves keep the whole.

    Points are put in order and numbered once: a segment is a range of numbers, so a round only
    adds up its halves, until none splits: at most log2 of the largest group. The numbered points
    are written again only when less than half of them are still in open segments.
    """
    seg, of = [*keys, "segment"], [*keys, "half"]
    rows = keep(scan.numbered(points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")), *keys, order=["x", "y"], crowd=crowd))
    first = F.expr("(n + 1) div 2")
    open_ = keep(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("rows").alias("rows")).select(*keys, F.lit("0").alias("segment"), F.lit(0).cast("long").alias("lo"), "n", "rows"))
    best = keep(best_model_per_uid(fit_all(rows.withColumn("segment", F.lit("0")), *seg, x="x", y="y", method="bisection"), *seg))
    count = open_.agg(F.count("*").alias("segments"), F.sum("n").alias("n")).first()
    stored, done, level = count.n, None, 0
    while True:
        halves = _inside(rows, open_, keys, level, count.segments <= _BROADCAST)
        halves = halves.withColumn("half", F.concat("segment", F.when(F.col("row") < F.col("lo") + first, ".1").otherwise(".2")))
        fits = best_model_per_uid(fit_all(halves.select(*of, "x", "y"), *of, x="x", y="y", method="bisection"), *of)
        fits = keep(fits.withColumn("segment", F.regexp_extract("half", r"^(.*)\.[12]$", 1)))
        two = fits.groupBy(*seg).agg(F.collect_set("model").alias("kinds"), F.count("*").alias("k")).where("k = 2")
        split = keep(best.select(*seg, "model").join(two, seg).where(~((F.size("kinds") == 1) & F.array_contains("kinds", F.col("model")))).select(*seg))
        if split.isEmpty():
            return best if done is None else done.unionByName(best)
        closed = best.join(split, seg, "left_anti")
        done = closed if done is None else done.unionByName(closed)
        best = fits.join(split, seg, "left_semi").drop("segment").withColumnRenamed("half", "segment").select(best.columns)
        child = lambda name, lo, n: F.struct(F.concat("segment", F.lit(name)).alias("segment"), lo.alias("lo"), n.alias("n"))
        both = F.array(child(".1", F.col("lo"), first), child(".2", F.col("lo") + first, F.col("n") - first))
        open_ = keep(open_.join(split, seg, "left_semi").select(*keys, "rows", F.explode(both).alias("s")).select(*keys, "s.*", "rows"))
        count, level = open_.agg(F.count("*").alias("segments"), F.sum("n").alias("n")).first(), level + 1
        if 2 * count.n < stored:
            rows, stored = keep(_inside(rows, open_, keys, level, count.segments <= _BROADCAST).drop("segment", "lo", "n")), count.n


def model_points(models: DataFrame, n: int, *keep: str) -> DataFrame:
    """(keep, i, x, y): n evenly spaced points of each curve over its range; x = 0 is moved to a tiny value."""
    step = F.try_divide(F.col("x_end") - F.col("x_start"), F.lit(n - 1))
    rows = models.select(*keep, "model", "b0", "b1", "b2", "x_start", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    at = F.col("x_start") + F.col("i") * F.coalesce("step", F.lit(0.0))
    rows = rows.withColumn("x", F.when(at == 0, F.lit(TINY)).otherwise(at))
    return rows.select(*keep, "i", "x", model_value(F.col("model"), F.col("b0"), F.col("b1"), F.col("b2"), F.col("x")).alias("y"))


def bucket_points(models: DataFrame, *keep: str) -> DataFrame:
    """(keep, bucket, x_start, x_end, y): the steps of bucketed models."""
    rows = models.select(*keep, F.col("x_start").alias("lo"), F.col("x_end").alias("hi"), F.size("bucket_stats").alias("n"), F.posexplode("bucket_stats").alias("bucket", "y"))
    width = (F.col("hi") - F.col("lo")) / F.col("n")
    return rows.select(*keep, "bucket", (F.col("lo") + F.col("bucket") * width).alias("x_start"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("x_end"), "y")


def scatter_slices(points: DataFrame, models: DataFrame, x: str = "structure_unit_size", y: str = "amount") -> tuple[DataFrame, DataFrame]:
    """Points of uids with more than one row, and models grouped by uid and range."""
    n = F.count("*").over(Window.partitionBy("uid"))
    pts = points.withColumn("n", n).where("n > 1").select("uid", F.col(x).alias("x"), F.col(y).alias("y"))
    kinds = models.groupBy("uid", "x_start", "x_end").agg(F.sort_array(F.collect_list("model")).alias("models"))
    return pts, kinds
