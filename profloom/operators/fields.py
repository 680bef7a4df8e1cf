"""Fields, paths and filters of resource tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.schema import DEPENDENT, INDEPENDENT

#: Parts of a function's identity in the order that they are joined in.
UID_ORDER = (("bin",), ("file", "source", "package"), ("module",), ("class", "struct", "structure"), ("func", "function"), ("line",), ("instruction",))


def _frame_text(parts: list[str]):
    return lambda x: F.concat_ws(":", *[x[k].cast("string") for k in parts])


def flatten_fields(df: DataFrame) -> DataFrame:
    """Structs become ``parent:child`` columns and one joined text; arrays of structs join frames by ``,``."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            out.append(F.concat_ws(":", *[c[k.name].cast("string") for k in f.dataType]).alias(f.name))
            out.extend(c[k.name].alias(f"{f.name}:{k.name}") for k in f.dataType)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(F.array_join(F.transform(c, _frame_text(f.dataType.elementType.names)), ",").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(c.cast("array<string>"), ",").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def uid_order(parts: Column) -> Column:
    """The parts of a uid map joined by ``:``, by role, unknown keys last by name."""
    rank = lambda key: reduce(lambda acc, kv: F.when(key.isin(*kv[1]), kv[0]).otherwise(acc), enumerate(UID_ORDER), F.lit(len(UID_ORDER)))
    ranked = F.array_sort(F.transform(F.map_entries(parts), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(ranked, lambda e: e["v"]), ":")


def field_names(df: DataFrame) -> DataFrame:
    """Names of the columns that hold a value somewhere, and of the keys of ``extra``."""
    plain = [c for c in df.columns if c != "extra"]
    used = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in plain])
    found = used.select(F.explode(F.map_filter(F.create_map(*[x for c in plain for x in (F.lit(c), F.col(f"`{c}`"))]), lambda _, n: n > 0)).alias("field", "n")).select("field")
    if "extra" in df.columns:
        found = found.union(df.select(F.explode(F.map_keys("extra")).alias("field")).distinct())
    return found.distinct()


def numeric_fields(df: DataFrame) -> DataFrame:
    """Fields whose values are numbers in every row that has them."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]))
    long = df.select(F.explode(pairs).alias("field", "value")).where(F.col("value").isNotNull())
    good = long.groupBy("field").agg(F.bool_and(F.col("value").try_cast("double").isNotNull()).alias("ok"))
    return good.where("ok").select("field")


def key_values(df: DataFrame, path: str) -> DataFrame:
    """Values at a path: ``a:b`` goes into a struct, ``a::b`` over every element of an array."""
    head, *rest = path.split("::")
    pick = lambda c, keys: reduce(lambda x, k: x[k], keys, c)
    first, *inner = head.split(":")
    c = pick(F.col(f"`{first}`"), inner)
    for step in rest:
        df = df.select(F.explode(c).alias("__at"))
        c = pick(F.col("__at"), step.split(":"))
    return df.select(c.alias("value"))


def unique_values(df: DataFrame, path: str, ordinal: str | None = None) -> DataFrame:
    """Distinct values at a plain path; with ``ordinal``, also where each was first seen."""
    if ordinal is None:
        return key_values(df, path).distinct()
    return df.groupBy(F.col(path).alias("value")).agg(F.min(F.col(f"`{ordinal}`")).alias("first_seen"))


def filter_and_or(df: DataFrame, filters: list[tuple[str, object]]) -> DataFrame:
    """Filters on one key are alternatives, different keys must all hold; compared as text."""
    by: dict[str, list[str]] = {}
    for key, value in filters:
        by.setdefault(key, []).append(str(value))
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{k}`").cast("string").isin(*v) for k, v in by.items()], F.lit(True)))


def filter_or(df: DataFrame, filters: list[tuple[str, object]]) -> DataFrame:
    """Rows that any one of the filters fits; no filter keeps all."""
    if not filters:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.col(f"`{k}`").cast("string") == str(v) for k, v in filters]))


PARAMETRIC = ("constant", "linear", "logarithmic", "quadratic", "power", "exponential")
NON_PARAMETRIC = ("regressogram", "moving_average", "kernel_regression")


def models_by_group(models: DataFrame, group: str = "model") -> DataFrame:
    """All models, ``param`` or ``nonparam`` ones."""
    if group == "param":
        return models.where(F.col("model").isin(*PARAMETRIC))
    return models.where(F.col("model").isin(*NON_PARAMETRIC)) if group == "nonparam" else models


def model_of(models: DataFrame, kind: str, uid: str) -> DataFrame:
    """The model of a kind of one function; of several, the best fit on the least range."""
    return models.where((F.col("model") == kind) & (F.col("uid") == uid)).orderBy(F.desc("r_square"), "x_start", "x_end").limit(1)


def drop_allocator_frames(df: DataFrame, names: list[str], sources: list[str]) -> DataFrame:
    """Traces without frames of the given functions or source suffixes; the uid is the first frame left."""
    bad = lambda f: f["func"].isin(*names) | reduce(lambda a, b: a | b, [f["source"].endswith(s) for s in sources], F.lit(False))
    kept = df.withColumn("trace", F.filter("trace", lambda f: ~F.coalesce(bad(f), F.lit(False))))
    return kept.withColumn("uid", F.get("trace", F.lit(0))["func"])


def exclude_allocations(df: DataFrame, names: list[str], suffix: str | None = None) -> DataFrame:
    """Rows with a uid that is not listed and whose source does not end as given."""
    kept = df.where(F.col("uid").isNotNull() & ~F.col("uid").isin(*names))
    return kept if suffix is None else kept.where(~F.coalesce(F.get("trace", F.lit(0))["source"].endswith(suffix), F.lit(False)))


def location_filter(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("location").rlike(pattern))


def rule_applicable(rules: DataFrame, profiles: DataFrame, apply: str = "all") -> DataFrame:
    """(profile_id, method) of the checks whose rule fits a profile; null rule keys fit anything.

    ``rules``: ordinal, method, collector, type, cmd, postprocessor. ``apply='first'`` keeps the first fit.
    """
    any_or = lambda r, p: F.col(r).isNull() | (F.col(r) == F.col(p))
    r = rules.select("ordinal", "method", *[F.col(c).alias(f"r_{c}") for c in ("collector", "type", "cmd", "postprocessor")])
    fits = any_or("r_collector", "collector") & any_or("r_type", "type") & any_or("r_cmd", "cmd")
    fits &= F.col("r_postprocessor").isNull() | F.array_contains("postprocessors", F.col("r_postprocessor"))
    found = profiles.join(F.broadcast(r), fits).groupBy("profile_id", "method").agg(F.min("ordinal").alias("ordinal"))  # rules are a short configuration
    if apply == "first":
        first = Window.partitionBy("profile_id").orderBy("ordinal")
        found = found.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return found.select("profile_id", "method")


def default_variables(columns: list[str]) -> tuple[str | None, str | None]:
    """First listed independent and dependent field that exists."""
    return next((c for c in INDEPENDENT if c in columns), None), next((c for c in DEPENDENT if c in columns), None)


def compatible_profiles(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """(baseline_id, target_id): same type, cmd, workload and collector, baseline's postprocessors among the target's."""
    keys = ["type", "cmd", "workload", "collector"]
    b = baseline.select(*keys, F.col("profile_id").alias("baseline_id"), F.col("postprocessors").alias("bp"))
    t = target.select(*keys, F.col("profile_id").alias("target_id"), F.col("postprocessors").alias("tp"))
    return b.join(t, keys).where(F.size(F.array_except("bp", "tp")) == 0).select("baseline_id", "target_id")
