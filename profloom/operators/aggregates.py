"""Aggregations over resources, models and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators.windows import best_model_per_uid

AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "count": F.count,
    "nunique": F.count_distinct,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "min": F.min,
    "max": F.max,
}


def aggregate_by(df: DataFrame, func: str, of: str, per: str, by: str) -> DataFrame:
    """(per, by, value): one of the aggregates of ``of`` for each pair of keys."""
    return df.groupBy(F.col(f"`{per}`").alias("per"), F.col(f"`{by}`").alias("by")).agg(AGGREGATES[func](F.col(f"`{of}`")).alias("value"))


def flow(df: DataFrame, func: str, of: str, through: str, by: str) -> DataFrame:
    """(by, x, value): the aggregate along an integer axis, dense over its whole range, gaps as 0."""
    x = F.col(f"`{through}`").cast("int")
    found = df.groupBy(F.col(f"`{by}`").alias("by"), x.alias("x")).agg(AGGREGATES[func](F.col(f"`{of}`")).alias("value"))
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("x"))
    grid = df.select(F.col(f"`{by}`").alias("by")).distinct().join(span)  # keys of the result times its own axis
    return grid.join(found, ["by", "x"], "left").select("by", "x", F.coalesce("value", F.lit(0)).alias("value"))


def mean_amount_by_uid(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "uid").agg(F.coalesce(F.avg("amount"), F.lit(0.0)).alias("average"))


NS_PER_MS = 1e6


def exclusive_by_function(df: DataFrame, *keys: str, exclusive: str = "exclusive") -> DataFrame:
    """Exclusive time per function and location in ms."""
    return df.groupBy(*keys, "uid", "location").agg((F.sum(exclusive) / NS_PER_MS).alias("exclusive"))


def total_by_location(diff: DataFrame, *keys: str) -> DataFrame:
    """Sums per location of a joined baseline and target, and the sign of the whole."""
    total = diff.groupBy(*keys, "location").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("base", "target", "delta", "share")])
    return total.withColumn("result", F.when(F.col("share") > 0, "TotalDegradation").otherwise("TotalOptimization"))


def trace_totals(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, uid, trace, amount, percent): cost of each trace and its share of everything, in percent."""
    total = df.groupBy(*keys, "uid", "trace").agg(F.sum("amount").alias("amount"))
    return total.withColumn("percent", F.round(100 * F.col("amount") / F.sum("amount").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))), 2))


def function_stats(df: DataFrame, *keys: str, sample: str | None = None, exclusive: str = "exclusive") -> DataFrame:
    """Per function: count corrected for sampling, sampled count, totals, extremes, mean and quartiles."""
    step = F.max(sample) if sample else F.lit(1)
    q = F.percentile("amount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.groupBy(*keys, "uid").agg(
        F.count("*").alias("sampled_count"), step.cast("bigint").alias("step"), F.sum("amount").alias("total"), F.sum(exclusive).alias("total_exclusive"),
        F.min("amount").alias("min"), F.max("amount").alias("max"), F.avg("amount").alias("avg"), q.alias("q"),
    )
    return found.select(
        *keys, "uid", (F.col("sampled_count") + (F.col("sampled_count") - 1) * (F.col("step") - 1)).alias("count"), "sampled_count", "total", "total_exclusive", "min", "max", "avg",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )


def function_stats_levels(df: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Statistics per (tid, uid) and, with a null tid, per uid over all threads.

    ``parents(pid)`` are processes that spawn others; the global level leaves them out.
    """
    alone = df if parents is None else df.join(parents.select("pid").distinct(), "pid", "left_anti")
    per = function_stats(df, "tid", exclusive="amount")
    everywhere = function_stats(alone, exclusive="amount").withColumn("tid", F.lit(None).cast(df.schema["tid"].dataType))
    return per.unionByName(everywhere)


def profiles_per_type(catalog: DataFrame) -> DataFrame:
    """(version, type, n): profiles of each type and, with a null type, all of the version."""
    return catalog.rollup("version", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3").select("version", "type", "n")


def changes_per_result(changes: DataFrame) -> DataFrame:
    return changes.groupBy("version", "result").agg(F.count("*").alias("n"))


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def hotspot_coverage(calls: DataFrame) -> DataFrame:
    """Per thread: time spent in calls that call nothing, and how many functions those are."""
    leaves = calls.where(~F.col("has_children"))
    return leaves.groupBy("tid").agg(F.sum("amount").alias("hotspot_time"), F.count_distinct("uid").alias("hotspots"))


def level_exclusive(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tid", "depth").agg(F.sum("exclusive").alias("exclusive"))


def best_model_counts(models: DataFrame, least: float = 0.5) -> DataFrame:
    """(model, n): how often each kind fits best; ``undefined`` where the best R2 is not above ``least``."""
    best = best_model_per_uid(models, "uid")
    return best.groupBy(F.when(F.col("r_square") > least, F.col("model")).otherwise("undefined").alias("model")).agg(F.count("*").alias("n"))


def degradation_ratio(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(F.avg((F.col("result") == "Degradation").cast("double")).alias("ratio"))


def snapshots_dense(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per snapshot from 0 to the last one; empty snapshots have nulls (0 rows)."""
    found = df.groupBy("snapshot").agg(F.count("*").alias("n"), *aggregates)
    axis = df.agg(F.max("snapshot").alias("hi")).where("hi IS NOT NULL").select(F.explode(F.sequence(F.lit(0), "hi")).alias("snapshot"))
    return axis.join(found, "snapshot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
