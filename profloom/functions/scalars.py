"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from profloom.schema import SEVERITY

#: Stands for zero in divisions and on model abscissas.
TINY = 1e-6
#: Model kinds in the order that ties of fit go by, and in the order of growth.
MODEL_ORDER = ("exponential", "linear", "logarithmic", "power", "quadratic", "constant")
GROWTH = ("constant", "logarithmic", "linear", "quadratic", "power", "exponential")


def safe_div(a: Column, b: Column) -> Column:
    return a / F.when(b == 0, F.lit(TINY)).otherwise(b)


def in_abs_range(value: Column, bound: Column) -> Column:
    return value.between(-F.abs(bound), F.abs(bound))


def in_rel_range(value: Column, of: Column, share: float) -> Column:
    return F.abs(value).between((1 - share) * F.abs(of), (1 + share) * F.abs(of))


def model_value(model: Column, b0: Column, b1: Column, b2: Column, x: Column) -> Column:
    """y of a fitted curve at x; null where the kind is unknown or x is outside its domain."""
    return (
        F.when(model == "constant", b0)
        .when(model == "linear", b0 + b1 * x)
        .when(model == "logarithmic", b0 + b1 * F.ln(x))
        .when(model == "quadratic", b0 + b1 * x + b2 * x * x)
        .when(model == "power", b0 * F.pow(x, b1))
        .when(model == "exponential", b0 * F.pow(b1, x))
    )


def integral_param(model: Column, b0: Column, b1: Column, b2: Column, lo: Column, hi: Column) -> Column:
    """Definite integral of a fitted curve from its antiderivative; lo = 0 is moved off the pole."""
    lo = F.when(lo == 0, F.lit(TINY)).otherwise(lo)
    hi = F.when(hi == 0, F.lit(TINY)).otherwise(hi)
    span = hi - lo
    power = F.when(b1 == -1, b0 * (F.ln(hi) - F.ln(lo))).otherwise(F.try_divide(b0 * (F.pow(hi, b1 + 1) - F.pow(lo, b1 + 1)), b1 + 1))
    base = F.ln(b1)
    exponential = F.when(F.abs(b1 - 1) < 1e-12, b0 * span).otherwise(F.try_divide(b0 * (F.pow(b1, hi) - F.pow(b1, lo)), base))
    return (
        F.when(model == "constant", b0 * span)
        .when(model == "linear", b0 * span + b1 * (hi * hi - lo * lo) / 2)
        .when(model == "logarithmic", b0 * span + b1 * (hi * F.ln(hi) - hi - lo * F.ln(lo) + lo))
        .when(model == "quadratic", b0 * span + b1 * (hi * hi - lo * lo) / 2 + b2 * (F.pow(hi, F.lit(3)) - F.pow(lo, F.lit(3))) / 3)
        .when(model == "power", power)
        .when(model == "exponential", exponential)
    )


def integral_points(points: Column) -> Column:
    """Composite Simpson over points (x, y) sorted by x; an even number of points takes the mean of the
    two ways to leave one interval to the trapezoid rule. Uneven spacing is allowed; under two points: 0."""

    def simpson(lo: Column, last: Column) -> Column:
        def part(acc: Column, i: Column) -> Column:
            p, q, r = (F.get(points, i + k) for k in (0, 1, 2))
            h0, h1 = q["x"] - p["x"], r["x"] - q["x"]
            h, prod, ratio = h0 + h1, h0 * h1, F.try_divide(h0, h1)
            area = h / 6 * (p["y"] * (2 - F.try_divide(F.lit(1.0), ratio)) + q["y"] * F.try_divide(h * h, prod) + r["y"] * (2 - ratio))
            return acc + F.coalesce(area, F.lit(0.0))

        return F.when(last - lo >= 2, F.aggregate(F.sequence(lo, last - 2, F.lit(2)), F.lit(0.0), part)).otherwise(F.lit(0.0))

    def trapezoid(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, i + 1)
        return (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2

    n = F.size(points)
    even = (simpson(F.lit(0), n - 2) + trapezoid(n - 2) + trapezoid(F.lit(0)) + simpson(F.lit(1), n - 1)) / 2
    return F.when(n < 2, F.lit(0.0)).when(n % 2 == 1, simpson(F.lit(0), n - 1)).otherwise(even)


def classify_change(diff: Column, no_change: float, change: float, scale: float = 1.0) -> Column:
    size = F.abs(diff)
    named = lambda kind: F.when(diff < 0, kind + "Optimization").otherwise(kind + "Degradation")
    return F.when(size <= no_change * scale, "NoChange").when(size <= change * scale, named("Maybe")).otherwise(named(""))


def severity(result: Column) -> Column:
    return reduce(lambda acc, kv: F.when(result == kv[0], kv[1]).otherwise(acc), SEVERITY.items(), F.lit(None).cast("int"))


def switch_cost(a: Column, b: Column) -> Column:
    """1 - 2 |common words| / (|words a| + |words b|); words are parted by underscores."""
    x, y = (F.array_distinct(F.split(F.coalesce(c, F.lit("")), "_")) for c in (a, b))
    return 1 - 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


#: Bounds from tight to loose.
COMPLEXITY = ("O(1)", "O(n^1)", "O(n^2)", "O(n^3)", "O(n^4)")


def complexity_rank(bound: Column) -> Column:
    """Position of a bound among the known classes; any other is above all of them."""
    return reduce(lambda acc, kv: F.when(bound == kv[1], kv[0]).otherwise(acc), enumerate(COMPLEXITY), F.lit(len(COMPLEXITY)))


_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_INNER = r"\([^()]*\)"
#: A power's base (a logarithm, a sum in parentheses, a name, a number) and its exponent.
_FACTOR = rf"(log[0-9]*{_INNER}|{_INNER}|[a-z_][a-z_0-9]*|{_NUMBER})(?:\^([a-z_0-9.]+|{_INNER}))?"


def _factors(term: Column, sums) -> Column:
    """Growth of a product: exponents of its powers add up. ``sums`` gives that of a sum in parentheses."""

    def one(f: Column) -> Column:
        base, power = F.regexp_extract(f, f"^{_FACTOR}$", 1), F.regexp_extract(f, f"^{_FACTOR}$", 2)
        exponent = F.when(power == "", 1.0).otherwise(F.regexp_replace(power, r"[()]", "").try_cast("double"))
        inner = sums(F.regexp_extract(base, r"^\((.*)\)$", 1))
        number, log = base.rlike(f"^{_NUMBER}$"), base.rlike(r"^log([0-9]*\(|$)")
        grows = F.lit(1).cast("int")
        return (
            F.when(number, F.struct(F.when(exponent.isNull() & (base.cast("double") > 1), grows).otherwise(0).alias("exponential"), F.lit(0.0).alias("degree"), F.lit(0.0).alias("logs")))
            .when(exponent.isNull(), F.struct(grows.alias("exponential"), F.lit(0.0).alias("degree"), F.lit(0.0).alias("logs")))
            .when(log, F.struct(F.lit(0).alias("exponential"), F.lit(0.0).alias("degree"), F.when((base == "log") | F.regexp_extract(base, r"\((.*)\)", 1).rlike("[a-z]"), exponent).otherwise(0.0).alias("logs")))
            .when(base.startswith("("), F.struct(inner["exponential"].alias("exponential"), (inner["degree"] * exponent).alias("degree"), (inner["logs"] * exponent).alias("logs")))
            .otherwise(F.struct(F.lit(0).alias("exponential"), exponent.alias("degree"), F.lit(0.0).alias("logs")))
        )

    found = F.transform(F.regexp_extract_all(term, F.lit(_FACTOR), F.lit(0)), one)
    nothing = F.struct(F.lit(0).alias("exponential"), F.lit(0.0).alias("degree"), F.lit(0.0).alias("logs"))
    add = lambda a, f: F.struct(F.greatest(a["exponential"], f["exponential"]).alias("exponential"), (a["degree"] + f["degree"]).alias("degree"), (a["logs"] + f["logs"]).alias("logs"))
    return F.aggregate(found, nothing, add)


def _terms(text: Column) -> Column:
    """The terms of a sum; those in parentheses stay together."""
    return F.regexp_extract_all(text, F.lit(rf"(?:{_INNER}|[^-+()])+"), F.lit(0))


def bound_growth(bound: Column) -> Column:
    """(exponential, degree, logs) of a cost bound such as ``O(3*n^2 + n*log(m))``; structs order as the bounds grow.

    Sums, products, powers, logarithms and ``max(a, b)`` of numbers and names, with parentheses that
    hold no others but logarithms; every name counts as a size. Null for what does not fit this.
    """
    text = F.regexp_replace(F.lower(bound), r"\s+|^o\(|\)\s*$", "")
    text = F.when(F.lower(F.trim(bound)).rlike(r"^o\(.*\)$"), text).otherwise(F.regexp_replace(F.lower(bound), r"\s+", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\*\*", "^"), r"max\(", "(")
    text = F.regexp_replace(text, ",", "+")
    logs = F.regexp_replace(text, r"log[0-9]*\([^()]*[a-z][^()]*\)", "log")  # inside parentheses a logarithm is a word
    flat = F.when(logs.rlike(r"\([^()]*log[^()]*\)"), logs).otherwise(text)
    nothing = F.struct(F.lit(0).alias("exponential"), F.lit(0.0).alias("degree"), F.lit(0.0).alias("logs"))
    inner = lambda f: F.array_max(F.transform(_terms(f), lambda t: _factors(t, lambda _: nothing)))
    whole = F.array_max(F.transform(_terms(flat), lambda t: _factors(t, inner)))
    sound = flat.rlike(rf"^-?{_FACTOR}(?:[-+*]{_FACTOR})*$")
    return F.when(sound, whole)


def complexity_of(bound: Column) -> Column:
    """The class of a bound by its greatest term: ``O(1)``, ``O(n^k)``, with a factor of ``log(n)^j``, or ``O(c^n)``; null if it cannot be read."""
    g = bound_growth(bound)
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    power = F.when(g["degree"] > 0, F.concat(F.lit("n^"), short(g["degree"])))
    logs = F.when(g["logs"] > 0, F.concat(F.lit("log(n)"), F.when(g["logs"] != 1, F.concat(F.lit("^"), short(g["logs"]))).otherwise("")))
    poly = F.concat(F.lit("O("), F.coalesce(F.nullif(F.concat_ws(" ", power, logs), F.lit("")), F.lit("1")), F.lit(")"))
    return F.when(g["exponential"] > 0, "O(c^n)").otherwise(F.when(g.isNotNull(), poly))


def growth_rank(model: Column) -> Column:
    return reduce(lambda acc, kv: F.when(model == kv[1], kv[0]).otherwise(acc), enumerate(GROWTH), F.lit(None).cast("int"))


def model_rank(model: Column) -> Column:
    return reduce(lambda acc, kv: F.when(model == kv[1], kv[0]).otherwise(acc), enumerate(MODEL_ORDER), F.lit(len(MODEL_ORDER)))


def funcs(trace: Column) -> Column:
    return F.transform(trace, lambda f: f["func"])


def short_trace(names: Column) -> Column:
    """All frames, or first -> ... -> last when there are more than three."""
    n = F.size(names)
    return F.when(n > 3, F.concat_ws(" -> ", F.get(names, F.lit(0)), F.lit("..."), F.get(names, n - 1))).otherwise(F.array_join(names, " -> "))


def trace_steps(names: Column, uid: Column) -> Column:
    """Frames and function, each indented by its depth."""
    return F.transform(F.array_append(names, uid), lambda f, i: F.concat(F.repeat(F.lit(" "), i), f))
