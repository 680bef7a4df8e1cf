"""Non-parametric models: regressograms, moving averages as models, kernel estimators.

Kernel weights depend on x alone, so points collapse to (x, count, sum of y) first: pairs are
pairs of distinct sizes, not of measurements.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators import scan
from profloom.operators.graph import keep
from profloom.operators.joins import self_pairs
from profloom.operators.windows import moving_average

BUCKET_RULES = ("auto", "doane", "fd", "rice", "scott", "sqrt", "sturges")


def _bucket_width(rule: str) -> Column:
    """Bin width by the textbook rules from n, range, deviation, quartiles and skewness."""
    n, span = F.col("n"), F.col("hi") - F.col("lo")
    sturges = span / (F.log2(n) + 1)
    fd = 2 * (F.col("q3") - F.col("q1")) / F.cbrt(n)
    if rule == "sturges":
        return sturges
    if rule == "fd":
        return fd
    if rule == "auto":
        return F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    if rule == "sqrt":
        return span / F.sqrt(n)
    if rule == "rice":
        return span / (2 * F.cbrt(n))
    if rule == "scott":
        return F.cbrt(24 * math.sqrt(math.pi) / n) * F.col("std")
    if rule == "doane":
        g = F.sqrt(F.try_divide(6.0 * (n - 2), (n + 1) * (n + 3)))
        return F.when((n > 2) & (F.col("std") > 0), span / (1 + F.log2(n) + F.log2(1 + F.try_divide(F.abs(F.col("skew")), g)))).otherwise(F.lit(0.0))
    raise ValueError(f"unknown bucket rule: {rule}")


def regressogram(
    points: DataFrame, *keys: str, buckets: int | str | Column = "auto", stat: str = "mean", x: str = "structure_unit_size", y: str = "amount", compat: bool = True
) -> DataFrame:
    """(keys, x_start, x_end, y_start, buckets, bucket_stats, r_square): a step function of equal-width bins.

    A rule gives a width; ``compat`` takes its integer part as the number of buckets, otherwise
    the range is divided by it. Empty bins are 0.
    """
    pts = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))
    about = pts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("std"), F.skewness("x").alias("skew"), q.alias("q"), F.min("y").alias("y_start"), F.avg("y").alias("my")
    )
    about = about.withColumn("q1", F.col("q")[0]).withColumn("q3", F.col("q")[1])
    if isinstance(buckets, str):
        width = _bucket_width(buckets)
        count = F.floor(width) if compat else F.ceil(F.try_divide(F.col("hi") - F.col("lo"), width))
    else:
        count = buckets if isinstance(buckets, Column) else F.lit(buckets)
    about = about.withColumn("b", F.greatest(F.lit(1), F.coalesce(count, F.lit(1)).cast("int"))).select(*keys, "lo", "hi", "b", "y_start", "my")
    joined = pts.join(about, list(keys)) if keys else pts.join(about)
    at = F.floor(F.try_divide((F.col("x") - F.col("lo")) * F.col("b"), F.col("hi") - F.col("lo"))).cast("int")
    joined = joined.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.col("b") - 1))
    value = F.avg("y") if stat == "mean" else F.percentile("y", F.lit(0.5))
    v = F.col("y") - F.col("my")
    bins = joined.groupBy(*keys, "lo", "hi", "b", "y_start", "my", "bin").agg(value.alias("v"), F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(v * v).alias("tss"))
    sse = F.col("syy") - 2 * F.col("v") * F.col("sy") + F.col("n") * F.col("v") * F.col("v")
    dense = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: F.coalesce(F.try_element_at("stats", i), F.lit(0.0)))
    found = bins.groupBy(*keys, "lo", "hi", "b", "y_start").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("stats"), F.sum(sse).alias("sse"), F.sum("tss").alias("tss"))
    return found.select(
        *keys, F.col("lo").alias("x_start"), F.col("hi").alias("x_end"), "y_start", F.col("b").alias("buckets"), dense.alias("bucket_stats"), (1 - F.try_divide(F.col("sse"), F.col("tss"))).alias("r_square"),
    )


def moving_average_model(points: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount", window: int = 5, length: int | None = None, **options) -> DataFrame:
    """A moving average as one model row per group; positions without an average count as 0.

    ``bucket_stats`` is the whole curve, which one task must hold. With ``length`` the curve comes
    in pieces of so many positions at most, a row each, numbered by ``piece``; all else in these
    rows is the whole group's.
    """
    fit = F.coalesce("average", F.lit(0.0))
    stats = F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "fit"))), lambda p: p["fit"])
    sums = [F.min(x).alias("x_start"), F.max(x).alias("x_end"), F.sum((F.col(y) - F.col("fit")) * (F.col(y) - F.col("fit"))).alias("sse")]
    r_square = (1 - F.try_divide(F.col("sse"), F.col("tss"))).alias("r_square")
    if length is None:
        rows = moving_average(points, *keys, x=x, y=y, window=window, **options).withColumn("fit", fit)
        found = rows.groupBy(*keys).agg(*sums, stats.alias("bucket_stats"), (F.count(y) * F.var_pop(y)).alias("tss"))
        return found.select(*keys, "x_start", "x_end", "bucket_stats", F.lit(window).alias("window_width"), r_square)
    if options.get("method") == "ema":
        rows = moving_average(points, *keys, x=x, y=y, window=window, **options)
        rows = scan.numbered(rows, *keys, order=[x, y], crowd=options.get("crowd")).withColumnRenamed("row", "_row")
    else:
        rows = moving_average(points, *keys, x=x, y=y, window=window, row="_row", **options)
    stats = F.transform(F.array_sort(F.collect_list(F.struct("_row", "fit"))), lambda p: p["fit"])
    rows = rows.withColumn("fit", fit).withColumn("piece", F.expr(f"_row div {length}"))
    pieces = keep(rows.groupBy(*keys, "piece").agg(*sums, stats.alias("bucket_stats"), F.count(y).alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy")))
    group = Window.partitionBy(*keys)  # of a row per piece, without the curve
    off = F.col("my") - F.try_divide(F.sum(F.col("n") * F.col("my")).over(group), F.sum("n").over(group))
    about = pieces.drop("bucket_stats").withColumn("tss", F.col("n") * (F.col("vy") + off * off))
    about = about.groupBy(*keys).agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"), F.sum("sse").alias("sse"), F.sum("tss").alias("tss"))
    about = about.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "x_start", "x_end", F.lit(window).alias("window_width"), r_square)
    curve = pieces.select(*keys, "piece", "bucket_stats")
    return curve.join(about, scan.same_keys(curve, about, keys, "_of_")).select(*keys, "piece", "x_start", "x_end", "bucket_stats", "window_width", "r_square")


#: Reach of each kernel in bandwidths; beyond it the normal ones are under 1e-16 of their top, too little for a double's sum.
REACH = {"epanechnikov": 1.0, "tricube": 1.0, "normal": 8.6, "epanechnikov4": 1.0, "normal4": 8.6}


def kernel(kind: str, u: Column) -> Column:
    """Kernel weights at u = (x - centre) / bandwidth, by their definitions; order-4 kernels may be negative."""
    inside = lambda e: F.when(F.abs(u) < 1, e).otherwise(F.lit(0.0))
    normal = F.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    if kind == "epanechnikov":
        return inside(0.75 * (1 - u * u))
    if kind == "tricube":
        return inside(70 / 81 * F.pow(1 - F.pow(F.abs(u), F.lit(3)), F.lit(3)))
    if kind == "normal":
        return normal
    if kind == "epanechnikov4":
        return inside(15 / 32 * (3 - 10 * u * u + 7 * F.pow(u, F.lit(4))))
    if kind == "normal4":
        return (3 - u * u) / 2 * normal
    raise ValueError(f"unknown kernel: {kind}")


def distinct_sizes(points: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount") -> DataFrame:
    """(keys, i, x, m, sy, syy): points collapsed by x; i numbers the sizes of a group."""
    pts = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    found = pts.groupBy(*keys, "x").agg(F.count("*").alias("m"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    return found.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("x")))


def bandwidth(points: DataFrame, *keys: str, rule: str = "scott", x: str = "structure_unit_size") -> DataFrame:
    """(keys, h) by Scott's or Silverman's rule."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    found = points.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), q.alias("q"))
    spread = F.col("s") if rule == "scott" else F.least(F.col("s"), (F.col("q")[1] - F.col("q")[0]) / 1.349)
    return found.select(*keys, ((1.059 if rule == "scott" else 0.9) * spread * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))


def kernel_estimate(sizes: DataFrame, *keys: str, h: float, kind: str = "epanechnikov", order: int = 0) -> DataFrame:
    """(keys, i, x, estimate) of distinct sizes: local constant (0), local linear (1) or a higher local polynomial."""
    pairs = _size_pairs(sizes, keys, h * REACH[kind])
    d = F.col("xj") - F.col("xi")
    pairs = pairs.withColumn("w", kernel(kind, d / h)).withColumn("d", d)
    moment = lambda p: F.sum(F.col("w") * F.col("m") * F.pow(F.col("d"), F.lit(p))).alias(f"s{p}")
    cross = lambda p: F.sum(F.col("w") * F.col("sy") * F.pow(F.col("d"), F.lit(p))).alias(f"t{p}")
    sums = pairs.groupBy(*keys, "i", F.col("xi").alias("x")).agg(*[moment(p) for p in range(2 * order + 1)], *[cross(p) for p in range(order + 1)])
    constant = F.try_divide(F.col("t0"), F.col("s0"))
    if order == 0:
        return sums.select(*keys, "i", "x", constant.alias("estimate"))
    if order == 1:
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.when(F.abs(det) > 1e-12, det))
        return sums.select(*keys, "i", "x", F.coalesce(line, constant).alias("estimate"))
    types = {f.name: f.dataType.simpleString() for f in sums.schema}

    def solve(batches):
        import numpy as np

        for pdf in batches:
            a = np.array([[pdf[f"s{p + q}"] for q in range(order + 1)] for p in range(order + 1)], float).transpose(2, 0, 1)
            b = np.array([pdf[f"t{p}"] for p in range(order + 1)], float).T
            pdf["estimate"] = [np.linalg.lstsq(m, v, rcond=None)[0][0] for m, v in zip(a, b, strict=True)]
            yield pdf[[*keys, "i", "x", "estimate"]]

    return sums.mapInPandas(solve, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "i int, x double, estimate double"]))


def _size_pairs(sizes: DataFrame, keys: tuple[str, ...], width: float | None) -> DataFrame:
    named = sizes.select(*keys, F.col("i").alias("j"), "m", "sy")
    return self_pairs(sizes.withColumn("y", F.lit(0.0)), *keys, width=width).drop("yi", "yj").join(named, [*keys, "j"])


def kernel_model(points: DataFrame, *keys: str, h: float, kind: str = "normal", order: int = 0, **axes: str) -> DataFrame:
    """(keys, x_start, x_end, bandwidth, bucket_stats, r_square): a kernel estimate as one model row."""
    sizes = distinct_sizes(points, *keys, **axes).cache()
    both = sizes.join(kernel_estimate(sizes, *keys, h=h, kind=kind, order=order).select(*keys, "i", "estimate"), [*keys, "i"])
    e = F.col("estimate")
    sse = F.sum(F.col("syy") - 2 * e * F.col("sy") + F.col("m") * e * e)
    n, total = F.sum("m"), F.sum("sy")
    tss = F.sum("syy") - total * total / n
    stats = F.transform(F.array_sort(F.collect_list(F.struct("x", "estimate"))), lambda p: p["estimate"])
    return both.groupBy(*keys).agg(F.min("x").alias("x_start"), F.max("x").alias("x_end"), F.lit(h).alias("bandwidth"), stats.alias("bucket_stats"), (1 - F.try_divide(sse, tss)).alias("r_square"))


#: Terms of the expansion of a block's weights, and bandwidths beyond which a normal weight is left out.
TERMS, FAR = 20, 9
#: Weight of all others below which a point has no neighbours.
ALONE = 1e-9


def gauss_sums(sizes: DataFrame, *keys: str) -> DataFrame:
    """(keys, h, i, a, b): sums of exp(-d^2 / 2h^2) times sy, and times m, at each of ``sizes(keys, h, i, x, m, sy)``.

    Blocks one bandwidth wide keep moments about their centres; a size meets the blocks within
    ``FAR`` bandwidths and evaluates their Hermite expansions, so work is linear in sizes. With |v| <= 1/2
    the terms left out are under 1.1 * 2^-20 / sqrt(20!) = 7e-16 of a block's weight, and weights beyond
    the reach under 3e-18.
    """
    at = F.col("x") / F.col("h")
    rows = sizes.withColumn("block", F.floor(at))
    v = at - F.col("block") - 0.5
    term = lambda c, p: F.sum(F.col(c) * F.pow(v, F.lit(p)) / float(math.factorial(p)))
    blocks = rows.groupBy(*keys, "h", "block").agg(F.array(*[term("m", p) for p in range(TERMS)]).alias("mm"), F.array(*[term("sy", p) for p in range(TERMS)]).alias("ms"))
    near = rows.select(*keys, "h", "i", at.alias("at"), F.explode(F.sequence(F.col("block") - FAR - 1, F.col("block") + FAR + 1)).alias("block"))
    met = near.join(blocks, [*keys, "h", "block"]).select(*keys, "h", "i", (F.col("at") - F.col("block") - 0.5).alias("u"), "mm", "ms")
    n = len(keys)

    def evaluate(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            u = batch.column(n + 2).to_numpy()
            moments = [np.asarray(batch.column(n + k).flatten()).reshape(-1, TERMS) for k in (3, 4)]
            older, newer = np.zeros(len(u)), np.exp(-u * u / 2)  # the polynomials of degree -1 and 0, times the weight
            sums = np.zeros((2, len(u)))
            for p in range(TERMS):
                for k in (0, 1):
                    sums[k] += newer * moments[k][:, p]
                older, newer = newer, u * newer - p * older
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(sums[1]), pa.array(sums[0])], [*batch.schema.names[: n + 2], "a", "b"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*keys, "h", "i").schema)
    return met.mapInArrow(evaluate, f"{types}, a double, b double").groupBy(*keys, "h", "i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _leave_one_out(sizes: DataFrame, keys: tuple[str, ...], grid: list[float]) -> DataFrame:
    """(keys, h, mse): mean squared error of the normally weighted mean of all other points, for each bandwidth.

    Points whose others weigh less than ``ALONE`` together are left out.
    """
    rows = sizes.withColumn("h", F.explode(F.array(*map(F.lit, grid))))
    sums = gauss_sums(rows, *keys)
    rest = F.col("b") - 1
    c, d = 1 + F.try_divide(F.lit(1.0), rest), F.try_divide(F.col("a"), rest)
    err = c * c * F.col("syy") - 2 * c * d * F.col("sy") + F.col("m") * d * d
    joined = sums.join(rows.select(*keys, "h", "i", "m", "sy", "syy"), [*keys, "h", "i"]).where(rest > ALONE)
    return joined.groupBy(*keys, "h").agg((F.sum(err) / F.sum("m")).alias("mse"))


def _best_of_grid(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return found.groupBy(*keys).agg(F.min_by("h", F.struct("mse", "h")).alias("h"), F.min("mse").alias("mse"))


def bandwidth_by_cv(points: DataFrame, *keys: str, grid: list[float], x: str = "structure_unit_size", y: str = "amount") -> DataFrame:
    """(keys, h, mse): the normal-kernel bandwidth of least leave-one-out error on a grid."""
    return _best_of_grid(_leave_one_out(distinct_sizes(points, *keys, x=x, y=y), keys, grid), keys)


def bandwidth_by_samples(
    points: DataFrame, *keys: str, grid: list[float], samples: int, ordinal: str = "order", median: bool = False, x: str = "structure_unit_size", y: str = "amount"
) -> DataFrame:
    """(keys, h): the mean or median over disjoint samples of each one's best bandwidth, told in spreads of the sample and scaled to all points.

    The grid holds factors of the rule-of-thumb bandwidth, spread times n^(-1/5), of each sample.
    """
    pts = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.pmod(F.xxhash64(F.col(ordinal)), F.lit(samples)).alias("sample")).where("x IS NOT NULL AND y IS NOT NULL")
    of = (*keys, "sample")
    rule = F.stddev_samp("x") * F.pow(F.count("x"), F.lit(-0.2))
    unit = pts.groupBy(*of).agg(rule.alias("unit")).where("unit > 0")
    scaled = pts.join(unit, list(of)).withColumn("x", F.col("x") / F.col("unit"))
    best = _best_of_grid(_leave_one_out(distinct_sizes(scaled, *of, x="x", y="y"), of, grid), of)
    factor = F.median("h") if median else F.avg("h")
    return best.groupBy(*keys).agg(factor.alias("factor")).join(pts.groupBy(*keys).agg(rule.alias("unit")), list(keys)).select(*keys, (F.col("factor") * F.col("unit")).alias("h"))


def kernel_ridge_grid(points: DataFrame, *keys: str, gammas: list[float], **axes: str) -> DataFrame:
    """(keys, gamma, mse): the radial-basis width of least leave-one-out error."""
    width = {g: 1 / math.sqrt(2 * g) for g in gammas}
    found = _leave_one_out(distinct_sizes(points, *keys, **axes), keys, list(width.values()))
    gamma = F.element_at(F.create_map(*[F.lit(v) for g, h in width.items() for v in (h, g)]), F.col("h"))
    found = found.withColumn("gamma", gamma)
    return found.groupBy(*keys).agg(F.min_by("gamma", F.struct("mse", "gamma")).alias("gamma"), F.min("mse").alias("mse"))


def kernel_ridge_model(points: DataFrame, *keys: str, gammas: list[float], **axes: str) -> DataFrame:
    """(keys, x_start, x_end, gamma, bucket_stats, r_square): the radial-basis mean of the best width as one model row."""
    best = kernel_ridge_grid(points, *keys, gammas=gammas, **axes).select(*keys, "gamma", (1 / F.sqrt(2 * F.col("gamma"))).alias("h"))
    sizes = distinct_sizes(points, *keys, **axes).join(best, list(keys))
    both = sizes.join(gauss_sums(sizes, *keys).select(*keys, "i", F.try_divide("a", "b").alias("estimate")), [*keys, "i"])
    e = F.col("estimate")
    sse = F.sum(F.col("syy") - 2 * e * F.col("sy") + F.col("m") * e * e)
    n, total = F.sum("m"), F.sum("sy")
    tss = F.sum("syy") - total * total / n
    stats = F.transform(F.array_sort(F.collect_list(F.struct("x", "estimate"))), lambda p: p["estimate"])
    return both.groupBy(*keys, "gamma").agg(F.min("x").alias("x_start"), F.max("x").alias("x_end"), stats.alias("bucket_stats"), (1 - F.try_divide(sse, tss)).alias("r_square"))
