"""Window operators: running series, moving averages, rankings within groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.functions.scalars import integral_points, model_rank
from profloom.operators import scan
from profloom.operators.graph import keep

#: Longest truncated window of an exponential mean that is built from array functions.
LONGEST_EMA = 512


def accumulate_flow(series: DataFrame, by: str = "by", x: str = "x", value: str = "value") -> DataFrame:
    w = Window.partitionBy(by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("accumulated", F.sum(value).over(w))


def weights(kind: str, n: int) -> list[float]:
    """Symmetric window weights by their textbook definitions."""
    if n == 1:
        return [1.0]
    m = n - 1
    cos = lambda i, k: math.cos(2 * math.pi * k * i / m)
    centred = [abs(2 * i / m - 1) for i in range(n)]
    if kind == "boxcar":
        return [1.0] * n
    if kind == "triang":
        return [1 - abs((2 * i - m) / (n if n % 2 == 0 else n + 1)) for i in range(n)]
    if kind == "bartlett":
        return [1 - u for u in centred]
    if kind == "parzen":
        half = n / 2
        return [1 - 6 * (u**2) * (1 - u) if u <= 0.5 else 2 * (1 - u) ** 3 for u in (abs(i - m / 2) / half for i in range(n))]
    if kind == "bohman":
        return [0.0 if u >= 1 else (1 - u) * math.cos(math.pi * u) + math.sin(math.pi * u) / math.pi for u in centred]
    if kind == "barthann":
        return [0.62 - 0.48 * abs(i / m - 0.5) + 0.38 * math.cos(2 * math.pi * (i / m - 0.5)) for i in range(n)]
    # Coefficients of the cosine-sum windows.
    sums = {"hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411)}
    return [sum((-1) ** k * a * cos(i, k) for k, a in enumerate(sums[kind])) for i in range(n)]


def moving_average(
    df: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount", method: str = "sma", window: int = 5, center: bool = True,
    min_periods: int | None = None, window_type: str | None = None, alpha: float | None = None, eps: float = 1e-12, row: str | None = None, crowd: int | None = None,
) -> DataFrame:
    """``average`` beside each point of a group sorted by (x, y), by rows.

    ``sma`` (plain, or weighted by ``window_type``), ``smm`` (median) and ``ema`` (adjusted
    exponential weights of ``alpha``; points without y are left out). Null where fewer than
    ``min_periods`` points are in the frame. ``row`` names a column for the points' numbers, from 0
    (not for ``ema``). Groups of more than ``crowd`` rows are spread over tasks.
    """
    least = window if min_periods is None else min_periods
    ahead = (window - 1) // 2 if center and method != "ema" else 0
    over = {"order": [x, y], "name": "average", "crowd": crowd}
    frame = over | {"before": window - 1 - ahead, "after": ahead, "row": row}
    enough = lambda value: lambda w: F.when(F.count(y).over(w) >= least, value(w))
    if method == "sma" and window_type is None:
        return scan.framed(df, *keys, **frame, value=enough(lambda w: F.avg(y).over(w)))
    if method == "sma":
        wt = weights(window_type, window)
        products = lambda w: F.zip_with(F.collect_list(y).over(w), F.array(*map(F.lit, wt)), lambda v, k: v * k)
        least = window
        return scan.framed(df, *keys, **frame, value=enough(lambda w: F.aggregate(products(w), F.lit(0.0), lambda t, v: t + v) / sum(wt)))
    if method == "smm":
        return scan.framed(df, *keys, **frame, value=enough(lambda w: F.percentile(y, F.lit(0.5)).over(w)))
    if method != "ema":
        raise ValueError(f"unknown moving average: {method}")
    seen = F.col("row") + 1 >= least
    keep = max(1, math.ceil(math.log(eps) / math.log(1 - alpha))) if alpha < 1 else 1
    calm, hot = scan.split_crowded(df, *keys, crowd=crowd) if keep <= LONGEST_EMA else (None, df)
    out = None
    if calm is not None:
        fold = lambda a, v: F.struct((a["s"] * (1 - alpha) + v).alias("s"), (a["w"] * (1 - alpha) + 1).alias("w"))
        line = Window.partitionBy(*keys).orderBy(x, y)
        terms = F.collect_list(y).over(line.rowsBetween(-(keep - 1), 0))
        mean = F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), fold, lambda a: a["s"] / a["w"])
        out = calm.where(F.col(y).isNotNull()).withColumn("average", F.when(F.row_number().over(line) >= least, mean))
    if hot is None:
        return out
    spread = scan.decayed(hot, *keys, value=y, alpha=alpha, **over).withColumn("average", F.when(seen, F.col("average"))).drop("row", "rows")
    return spread if out is None else out.unionByName(spread)


def ema_alpha(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    """The smoothing factor of whichever decay is given; each is checked for its range."""
    if com is not None and com >= 0:
        return 1 / (1 + com)
    if span is not None and span >= 1:
        return 2 / (span + 1)
    if halflife is not None and halflife > 0:
        return 1 - math.exp(math.log(0.5) / halflife)
    if alpha is not None and 0 < alpha <= 1:
        return alpha
    raise ValueError("decay is missing or out of range")


#: Share of the x range that the first width takes, how fast it shrinks, and the fit at which it stops.
FIRST_WIDTH, SHRINK, FITS = 0.05, 0.15, 0.88


def next_width(width: int, r_square: float) -> int:
    """The next width to try: less by what the fit lacks, by one at least and nine tenths at most."""
    return max(1, width - max(1, int(min(0.9 * width - 1, SHRINK * (width - 1) * (FITS - r_square)))))


def auto_window(df: DataFrame, *keys: str, x: str = "structure_unit_size", y: str = "amount", stretch: int = 100_000, crowd: int | None = None) -> DataFrame:
    """(keys, width, r_square): the width, from 5 % of the x range down, whose centred mean first fits well enough, and its fit.

    A group of up to ``stretch`` points is one array and settled at once. A larger one is rows of
    ``stretch`` points and their running sums; a round tries one width for all groups still open:
    each row meets the rows that hold the sums at both ends of its windows, and adds its squared
    errors. Nothing larger than a few rows comes together, however wide the window. Once no width
    reaches beyond the next row, a row is kept with its two neighbours, and rounds move no points.
    """
    pts = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.select(*keys).schema)
    named = [F.col(k).alias(f"_i_{k}") for k in keys]
    info = keep(pts.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(FIRST_WIDTH * (F.max("x") - F.min("x"))).cast("int")).alias("width"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread")))
    info = info.select(*named, "width", "mean", "spread")
    rows = keep(scan.stretches(pts, *keys, order=["x", "y"], value="y", length=stretch, crowd=crowd))
    small = rows.where(F.col("rows") <= stretch)
    small = small.join(info, scan.same_keys(small, info, keys, "_i_")).select(*keys, "width", "mean", "ys")
    found = small.mapInArrow(_narrow(len(keys)), f"{types}, width int, r_square double")
    large = rows.where(F.col("rows") > stretch)
    if large.isEmpty():
        return found
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    large = large.join(info, scan.same_keys(large, info, keys, "_i_"))
    large = large.withColumn("ys", F.transform("ys", lambda v: v - F.col("mean")))
    large = keep(large.withColumn("ahead", F.coalesce(F.sum(F.aggregate("ys", F.lit(0.0), lambda a, v: a + v)).over(before), F.lit(0.0))).select(*keys, "rows", "stretch", "ys", "ahead", "width", "spread"))
    open_ = keep(large.groupBy(*keys, "rows", "spread").agg(F.first("width").alias("width")))
    held = large.drop("width", "spread")
    near = None
    while not open_.isEmpty():
        if near is None and open_.where(F.col("width") > 2 * stretch).isEmpty():  # and widths only shrink
            near = keep(_with_neighbours(held, keys))
        tried = keep(_squared_errors(held, open_, keys, stretch) if near is None else _near_errors(near, open_, keys, stretch))
        r2 = F.when(F.col("spread") > 0, 1 - F.col("sse") / (F.col("rows") * F.col("spread"))).otherwise(1.0)
        tried = tried.withColumn("r_square", r2)
        # as in next_width; integer division of positive numbers drops the fraction
        change = F.greatest(F.lit(1), F.least(0.9 * F.col("width") - 1, SHRINK * (F.col("width") - 1) * (FITS - F.col("r_square"))).cast("int"))
        tried = tried.withColumn("next", F.greatest(F.lit(1), F.col("width") - change))
        done = (F.col("r_square") >= FITS) | (F.col("next") == F.col("width"))
        found = found.unionByName(tried.where(done).select(*keys, "width", "r_square"))
        open_ = keep(tried.where(~done).select(*keys, "rows", "spread", F.col("next").alias("width")))
    return found


def _fit_of_width(sums, ys, width: int):
    """Squared errors of the centred mean; ``sums``: those of the first 0, 1, ... values."""
    import numpy as np

    n = len(ys)
    ahead = (width - 1) // 2
    i = np.arange(n)
    hi, lo = np.minimum(i + ahead + 1, n), np.maximum(i - (width - 1 - ahead), 0)
    return float(((ys - (sums[hi] - sums[lo]) / (hi - lo)) ** 2).sum())


def _narrow(n_keys: int):
    """Settle groups that are one array: rows (keys, width, mean, ys)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            widths, fits = [], []
            for width, mean, ys in zip(*(batch.column(n_keys + i) for i in range(3)), strict=True):
                ys, width = np.asarray(ys.values) - mean.as_py(), width.as_py()
                sums, total = np.concatenate(([0.0], np.cumsum(ys))), float((ys * ys).sum())
                while True:
                    r2 = 1 - _fit_of_width(sums, ys, width) / total if total else 1.0
                    if r2 >= FITS or (to := next_width(width, r2)) == width:
                        break
                    width = to
                widths.append(width)
                fits.append(r2)
            names = [*batch.schema.names[:n_keys], "width", "r_square"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(widths, pa.int32()), pa.array(fits, pa.float64())], names)

    return run


def _squared_errors(rows: DataFrame, open_: DataFrame, keys: tuple[str, ...], stretch: int) -> DataFrame:
    """``open_`` with ``sse``, the squared errors of its ``width``, over ``rows(keys, rows, stretch, ys, ahead)``."""
    widths = open_.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "width", "spread")
    here = rows.join(widths, scan.same_keys(rows, widths, keys, "_w_")).drop(*[f"_w_{k}" for k in keys])
    ahead, last = F.expr("(width - 1) div 2"), F.floor((F.col("rows") - 1) / stretch)
    begin = F.col("stretch") * stretch
    up, down = F.floor((begin + ahead + 1) / stretch), F.floor((begin - (F.col("width") - 1 - ahead)) / stretch)
    inside = lambda c: F.least(last, F.greatest(F.lit(0), c))
    wanted = F.array_distinct(F.array(*[inside(c) for c in (up, up + 1, down, down + 1)]))
    needs = here.select(*keys, "rows", "width", "spread", F.col("stretch").alias("target"), F.explode(wanted).alias("source"))
    held = rows.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("stretch").alias("_s_source"), "ys", "ahead")
    met = needs.join(held, scan.same_keys(needs, held, (*keys, "source"), "_s_")).groupBy(*keys, "rows", "width", "spread", "target").agg(F.collect_list(F.struct("source", "ys", "ahead")).alias("parts"))
    own = rows.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("stretch").alias("_o_target"), F.col("ys").alias("own"))
    met = met.join(own, scan.same_keys(met, own, (*keys, "target"), "_o_")).select(*keys, "rows", "width", "spread", "target", "parts", "own")
    return _errors_of(met, keys, stretch)


def _with_neighbours(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rows, target, parts): each row's points and sums and those of the rows before and behind it."""
    last = F.max("stretch").over(Window.partitionBy(*keys))
    ends = rows.select(*keys, "stretch").withColumn("last", last).where(F.col("stretch") == F.col("last")).select(*[F.col(k).alias(f"_e_{k}") for k in keys], "last")
    ends = F.broadcast(ends)  # a row per group of more than a stretch
    targets = F.filter(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1), lambda t: t.between(0, F.col("last")))
    sent = rows.join(ends, scan.same_keys(rows, ends, keys, "_e_")).select(*keys, "rows", F.struct(F.col("stretch").alias("source"), "ys", "ahead").alias("part"), F.explode(targets).alias("target"))
    return sent.groupBy(*keys, "rows", "target").agg(F.collect_list("part").alias("parts"))


def _near_errors(near: DataFrame, open_: DataFrame, keys: tuple[str, ...], stretch: int) -> DataFrame:
    """``_squared_errors`` for widths of up to two stretches, over rows with their neighbours."""
    widths = F.broadcast(open_.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "width", "spread"))
    met = near.join(widths, scan.same_keys(near, widths, keys, "_w_"))
    own = F.filter("parts", lambda p: p["source"] == F.col("target"))[0]["ys"]
    return _errors_of(met.select(*keys, "rows", "width", "spread", "target", "parts", own.alias("own")), keys, stretch)


def _errors_of(met: DataFrame, keys: tuple[str, ...], stretch: int) -> DataFrame:
    """(keys, rows, width, spread, sse) of rows that have met the parts that hold their sums."""
    at = len(keys)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            errors = []
            for n, width, target, parts, ys in zip(*(batch.column(at + i) for i in (0, 1, 3, 4, 5)), strict=True):
                n, width, target, ys = n.as_py(), width.as_py(), target.as_py(), np.asarray(ys.values)
                sums = {}
                for p in parts:
                    values = np.asarray(p["ys"].values)
                    sums[p["source"].as_py()] = p["ahead"].as_py() + np.concatenate(([0.0], np.cumsum(values)))

                def of(j, sums=sums):
                    """The sum of the first ``j`` values."""
                    block = np.minimum(j // stretch, max(sums))
                    out = np.empty(len(j))
                    for k in np.unique(block):
                        mine = block == k
                        out[mine] = sums[int(k)][j[mine] - int(k) * stretch]
                    return out

                half = (width - 1) // 2
                i = target * stretch + np.arange(len(ys))
                hi, lo = np.minimum(i + half + 1, n), np.maximum(i - (width - 1 - half), 0)
                errors.append(float(((ys - (of(hi) - of(lo)) / (hi - lo)) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 3], pa.array(errors, pa.float64())], [*batch.schema.names[: at + 3], "sse"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*keys, "rows", "width", "spread").schema)
    return met.mapInArrow(run, f"{types}, sse double").groupBy(*keys, "rows", "width", "spread").agg(F.sum("sse").alias("sse"))


def trace_sequence(records: DataFrame, step: Column | int = 1) -> DataFrame:
    """Ordinal of each record of a (tid, probe), counted in sampling steps."""
    w = Window.partitionBy("tid", "probe_id").orderBy("timestamp")
    return records.withColumn("sequence", (F.row_number().over(w) - 1) * (step if isinstance(step, Column) else F.lit(step)))


def best_model_per_uid(models: DataFrame, *keys: str) -> DataFrame:
    """The model of greatest R2 of each group; models that fit nothing are dropped, ties (to nine digits) go by kind.

    Over two sizes a line and its logarithmic form fit alike, and rounding alone must not choose.
    """
    w = Window.partitionBy(*keys).orderBy(F.round("r_square", 9).desc(), model_rank(F.col("model")))
    return models.where("r_square > 0").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


DENSITY, LEAST_POINTS = 0.05, 2


def local_windows(points: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, block, x_start, x_end, eight statistics) of blocks of 5 % of a group's points each."""
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(x)
    size = F.floor(F.count("*").over(group) * DENSITY).cast("int")
    sized = points.withColumn("size", F.when(size >= LEAST_POINTS, size).otherwise(F.count("*").over(group).cast("int")))
    blocks = sized.withColumn("block", F.floor((F.row_number().over(order) - 1) / F.col("size")).cast("int"))
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    pts = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    found = blocks.groupBy(*keys, "block").agg(
        F.min(x).alias("x_start"), F.max(x).alias("x_end"), pts.alias("pts"), F.avg(y).alias("avg"), F.max(y).alias("max"), F.min(y).alias("min"), F.sum(y).alias("sum"), q.alias("q")
    )
    return found.select(
        *keys, "block", "x_start", "x_end", integral_points(F.col("pts")).alias("int"), "avg", F.col("q")[1].alias("med"), "max", "min", "sum", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3")
    )


def merge_intervals(intervals: DataFrame, *keys: str) -> DataFrame:
    """Neighbouring intervals of equal result as one, with the mean rate; NoChange is dropped."""
    w = Window.partitionBy(*keys).orderBy("x_start")
    fresh = F.coalesce(F.lag("result").over(w) != F.col("result"), F.lit(True)).cast("int")
    islands = intervals.withColumn("fresh", fresh)
    islands = islands.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*keys, "island", "result").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"), F.avg("rate").alias("rate"))
    return merged.where("result <> 'NoChange'").drop("island")


def percent_of_total(df: DataFrame, *keys: str, value: str = "amount") -> DataFrame:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumn("percent", 100 * F.col(value) / F.sum(value).over(w))


def sort_and_split(df: DataFrame, n: int, *keys: str, x: str = "structure_unit_size", y: str = "amount") -> DataFrame:
    """Points of a group sorted by x and dealt into n nearly equal parts, numbered from 1."""
    return scan.dealt(df, n, *keys, order=[x, y])
