"""Running values and frames over the ordered rows of a group, for groups of any size.

A window partitioned by the group's keys puts a whole group into one task. Groups of more than
``CROWD`` rows are instead range-partitioned by key and order (Spark samples the bounds); each
block runs its own scan, one row per block and group carries the blocks' totals forward, and
the carry is joined back. Frames of bounded width get a halo: rows near the edge of a stretch
are copied to the stretches whose frames reach them. Smaller groups take the plain window.
Both ways give the same rows; null keys are keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators.graph import keep

#: Rows of a group that one task may take.
CROWD = 1_000_000


def same_keys(a: DataFrame, b: DataFrame, keys: tuple[str, ...], prefix: str) -> Column:
    """Null-safe equality of keys, those of ``b`` under a prefix."""
    return reduce(lambda c, k: c & a[k].eqNullSafe(b[prefix + k]), keys, F.lit(True))


def split_crowded(df: DataFrame, *keys: str, crowd: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups that fit a task, rows of the others; None where there are none).

    The crowded groups' keys, at most a row per ``crowd`` rows, are broadcast: a shuffle by key
    would bring each of these groups together in one task.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (crowd or CROWD))
    big = keep(sizes.select(*[F.col(k).alias(f"_big_{k}") for k in keys], F.col("_n")))
    if big.isEmpty():
        return df, None
    big = F.broadcast(big)
    on = same_keys(df, big, keys, "_big_")
    return df.join(big, on, "left_anti"), df.join(big, on, "left_semi")


def _blocks(df: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """Rows with the number of their range partition, in which earlier rows of a group have lower numbers."""
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_id", F.monotonically_increasing_id())  # spreads what ties
    return keep(dealt.repartitionByRange(parts, *keys, *order, "_id").withColumn("_block", F.spark_partition_id()))


def _carry(rows: DataFrame, blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``blocks(_block, keys, ...)`` joined back to their rows."""
    named = blocks.select(*[F.col(c).alias(f"_at_{c}") if c in (*keys, "_block") else F.col(c) for c in blocks.columns])
    joined = rows.join(named, same_keys(rows, named, ("_block", *keys), "_at_"))
    return joined.drop("_block", "_id", *[f"_at_{c}" for c in ("_block", *keys)])


def _before(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, *keys: str, order: list, crowd: int | None = None) -> DataFrame:
    """``df`` with ``row``, counted from 0 in ``order``, and ``rows``, the size of the group."""
    calm, hot = split_crowded(df, *keys, crowd=crowd)
    group = Window.partitionBy(*keys)
    out = calm.withColumn("row", (F.row_number().over(group.orderBy(*order)) - 1).cast("long")).withColumn("rows", F.count("*").over(group))
    if hot is None:
        return out
    rows = _blocks(hot, keys, order)
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_block", *keys).orderBy(*order, "_id")) - 1)
    sizes = rows.groupBy("_block", *keys).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_block", *keys, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_ahead"), F.sum("_n").over(group).alias("rows"))
    spread = _carry(rows, sizes, keys).withColumn("row", F.col("_in") + F.col("_ahead"))
    return out.unionByName(spread.select(*out.columns))


def last_known(df: DataFrame, *keys: str, order: list, value: str, name: str, crowd: int | None = None) -> DataFrame:
    """``df`` with ``name``: the newest non-null ``value`` up to each row."""
    calm, hot = split_crowded(df, *keys, crowd=crowd)
    line = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = calm.withColumn(name, F.last(value, ignorenulls=True).over(line))
    if hot is None:
        return out
    rows = _blocks(hot, keys, order)
    local = Window.partitionBy("_block", *keys).orderBy(*order, "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last(value, ignorenulls=True).over(local))
    at = F.struct(*[F.col(c) if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)], "_id")
    ends = rows.groupBy("_block", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("_end"))
    ends = ends.select("_block", *keys, F.last("_end", ignorenulls=True).over(_before(keys)).alias("_known"))
    return out.unionByName(_carry(rows, ends, keys).withColumn(name, F.coalesce("_own", "_known")).select(*out.columns))


def framed(df: DataFrame, *keys: str, order: list, before: int, after: int, name: str, value: Callable[..., Column], row: str | None = None, crowd: int | None = None) -> DataFrame:
    """``df`` with ``name``: ``value(frame)`` over the ``before`` rows ahead of each row, itself and the ``after`` behind it.

    ``row`` names a column for the rows' numbers, from 0, if they are wanted.
    """
    calm, hot = split_crowded(df, *keys, crowd=crowd)
    line = Window.partitionBy(*keys).orderBy(*order)
    out = calm.withColumn(name, value(line.rowsBetween(-before, after)))
    if row is not None:
        out = out.withColumn(row, (F.row_number().over(line) - 1).cast("long"))
    if hot is None:
        return out
    stretch = max(crowd or CROWD, before + after, 1)
    own, at = F.floor(F.col("row") / stretch), F.col("row") % stretch
    halo = F.array(own, F.when(at < after, own - 1), F.when(stretch - at <= before, own + 1))
    rows = numbered(hot, *keys, order=order, crowd=crowd).withColumn("_own", own).withColumn("_stretch", F.explode(F.array_compact(halo)))
    frame = Window.partitionBy(*keys, "_stretch").orderBy("row").rowsBetween(-before, after)
    spread = rows.withColumn(name, value(frame)).where(F.col("_own") == F.col("_stretch"))
    spread = spread if row is None else spread.withColumn(row, F.col("row"))
    return out.unionByName(spread.select(*out.columns))


def dealt(df: DataFrame, n: int, *keys: str, order: list, name: str = "part", crowd: int | None = None) -> DataFrame:
    """``df`` with ``name``: the rows of a group in ``order`` in ``n`` nearly equal parts, from 1; the first ones take what is over."""
    size, more = F.expr(f"rows div {n}"), F.col("rows") % n
    large = more * (size + 1)
    part = F.when(F.col("row") < large, F.expr(f"row div (rows div {n} + 1)") + 1).otherwise(more + F.try_divide(F.col("row") - large, size).cast("long") + 1)
    return numbered(df, *keys, order=order, crowd=crowd).withColumn(name, part.cast("int")).drop("row", "rows")


def decayed(df: DataFrame, *keys: str, order: list, value: str, alpha: float, name: str, crowd: int | None = None) -> DataFrame:
    """Rows with a ``value`` and their number, and ``name``: the adjusted exponential mean of all rows up to each.

    The recurrence s = (1 - alpha) s + y composes over stretches: a stretch starts from nothing and
    then takes, faded, what the two before it ended with. A stretch is so long that what stood
    three before it has faded by 10^-24.
    """
    import math

    known = numbered(df.where(F.col(value).isNotNull()), *keys, order=order, crowd=crowd)
    if alpha == 1:
        return known.withColumn(name, F.col(value).cast("double"))
    fade = -math.log(1 - alpha)
    length = max(1, math.ceil(math.log(1e12) / fade))
    faded = lambda n: F.exp(-fade * n)
    rows = known.withColumn("_stretch", F.expr(f"row div {length}")).withColumn("_in", F.col("row") % length)
    frame = Window.partitionBy(*keys, "_stretch").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", faded(F.col("_in")) * F.sum(F.col(value) * F.exp(fade * F.col("_in"))).over(frame))
    ends = rows.where(F.col("_in") == length - 1).select(*keys, "_stretch", "_own")
    for k in (1, 2):
        named = ends.select(*[F.col(c).alias(f"_to_{c}") for c in keys], (F.col("_stretch") + k).alias("_to__stretch"), F.col("_own").alias(f"_end{k}"))
        rows = rows.join(named, same_keys(rows, named, ("_stretch", *keys), "_to_"), "left").drop(*[f"_to_{c}" for c in ("_stretch", *keys)])
    total = F.col("_own") + faded(F.col("_in") + 1) * (F.coalesce("_end1", F.lit(0.0)) + faded(F.lit(length)) * F.coalesce("_end2", F.lit(0.0)))
    weight = -F.expm1(-fade * (F.col("row") + 1)) / alpha
    return rows.withColumn(name, total / weight).select(*known.columns, name)


def stretches(df: DataFrame, *keys: str, order: list, value: str, length: int, crowd: int | None = None) -> DataFrame:
    """(keys, rows, stretch, ys): the values of a group in order, ``length`` to a row."""
    rows = numbered(df, *keys, order=order, crowd=crowd).withColumn("stretch", F.expr(f"row div {length}"))
    ys = F.transform(F.array_sort(F.collect_list(F.struct("row", F.col(value).cast("double").alias("y")))), lambda p: p["y"])
    return rows.groupBy(*keys, "rows", "stretch").agg(ys.alias("ys"))
