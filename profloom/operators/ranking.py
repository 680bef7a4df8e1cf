"""Sorts, limits, top-k, joins by rank, set operations and the catalogue's lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators.aggregates import profiles_per_type, trace_totals

#: Attributes that profiles can be sorted by.
SORT_KEYS = ("time", "workload", "collector", "cmd", "type", "checksum", "profile_id", "version")


def top_n_records(df: DataFrame, n: int = 10, *keys: str) -> DataFrame:
    """The n greatest (uid, trace) totals of each group (of all rows without keys), with their rank."""
    total = trace_totals(df, *keys)
    if not keys:  # the limit first, so that only n rows meet in one task
        total = total.orderBy(F.desc("amount"), "uid", "trace").limit(n)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("amount"), "uid", "trace")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def zip_topn(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Ranked records of both sides, the i-th beside the i-th."""
    side = lambda df, p: df.select(*keys, "rank", *[F.col(c).alias(f"{p}_{c}") for c in ("uid", "trace", "amount", "percent")])
    return side(baseline, "base").join(side(target, "target"), [*keys, "rank"], "full_outer")


def compare_top_n(baseline: DataFrame, target: DataFrame, n: int = 10) -> DataFrame:
    """Rank-aligned difference of the greatest records of two profiles."""
    both = zip_topn(top_n_records(baseline, n), top_n_records(target, n))
    return both.withColumn("delta", F.coalesce("target_amount", F.lit(0.0)) - F.coalesce("base_amount", F.lit(0.0)))


def zip_traces(df: DataFrame, a: str, b: str) -> DataFrame:
    """(position, a frame, b frame, a in b, b in a): two traces side by side."""
    n = F.greatest(F.size(a), F.size(b))
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    x, y = F.get(a, F.col("i")), F.get(b, F.col("i"))
    return rows.withColumns({"frame_a": x, "frame_b": y, "a_in_b": F.coalesce(F.array_contains(b, x), F.lit(False)), "b_in_a": F.coalesce(F.array_contains(a, y), F.lit(False))})


def sort_profiles(profiles: DataFrame, key: str = "time") -> DataFrame:
    return profiles.orderBy(F.desc(key if key in SORT_KEYS else "time"))


def nth_profile(profiles: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    """Profiles number lo (to hi) of each version, counted from 0 by time."""
    w = Window.partitionBy("version").orderBy("time", "profile_id")
    return profiles.withColumn("nth", F.row_number().over(w) - 1).where(F.col("nth").between(lo, lo if hi is None else hi))


def find_profile(profiles: DataFrame, name: str) -> DataFrame:
    keys = [k for k in ("profile_id", "checksum", "path") if k in profiles.columns]
    cond = F.lit(False)
    for k in keys:
        cond = cond | (F.col(k) == name)
    return profiles.where(cond)


def scan_catalog(profiles: DataFrame, version: str | None = None) -> DataFrame:
    """Profiles of a version (a pruned partition), or those not yet assigned to one."""
    return profiles.where(F.col("version").isNull() if version is None else F.col("version") == version)


def sort_table(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(f"`{key}`").asc() if ascending else F.col(f"`{key}`").desc())


def order_by_delta(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("delta"))


def sort_changes(changes: DataFrame) -> DataFrame:
    return changes.orderBy("location", "type", "cmdstr")


def version_log(versions: DataFrame, profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """(checksum, date, n_profiles, changes): one ``+`` per degradation and ``-`` per optimization."""
    counts = profiles_per_type(profiles).where("type IS NULL").select(F.col("version").alias("checksum"), F.col("n").alias("n_profiles"))
    signs = changes.groupBy(F.col("version").alias("checksum")).agg(
        F.count_if(F.col("result").isin("Degradation", "SevereDegradation")).cast("int").alias("up"), F.count_if(F.col("result").isin("Optimization", "SevereOptimization")).cast("int").alias("down")
    )
    joined = versions.join(counts, "checksum", "left").join(signs, "checksum", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("checksum", "date", zero("n_profiles").alias("n_profiles"), F.concat(F.repeat(F.lit("+"), zero("up")), F.repeat(F.lit("-"), zero("down"))).alias("changes"))


def pending_status(profiles: DataFrame) -> DataFrame:
    """Pending profiles by time, each with the number of its type."""
    pending = scan_catalog(profiles)
    return pending.withColumn("of_type", F.count("*").over(Window.partitionBy("type"))).orderBy("time")


def common_uids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("uid").intersect(b.select("uid"))


def uids_of(df: DataFrame) -> DataFrame:
    return df.select("uid").distinct()


def new_or_deleted(base: Column, target: Column) -> Column:
    return base.isNull() | target.isNull()


def sync_catalog(catalog: DataFrame, objects: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose object is there, and entries for objects that no entry lists; one per version and key."""
    listed = catalog.join(objects.select(key).distinct(), key, "left_semi")
    fresh = objects.join(catalog.select(key).distinct(), key, "left_anti")
    return listed.unionByName(fresh, allowMissingColumns=True).dropDuplicates(["version", key])
