"""Writers and keyed updates of the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from profloom.functions.scalars import severity
from profloom.operators.fields import flatten_fields
from profloom.operators.traces import folded_lines


def content_checksum(df: DataFrame) -> DataFrame:
    """(profile_id, checksum): SHA-1 over a profile's rows, whatever their order."""
    rows = df.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.sha1(F.to_json(F.struct(*df.columns))))).alias("rows"))
    return rows.select("profile_id", F.sha1(F.array_join("rows", "").cast("binary")).alias("checksum"))


def write_resources(df: DataFrame, path: str) -> None:
    """Append resources by version; rows of a version and function lie together for pruning and scans."""
    df.repartition("version").sortWithinPartitions("version", "uid").write.mode("append").partitionBy("version").parquet(path)


def write_catalog(entries: DataFrame, path: str) -> None:
    """Append catalogue entries by version; a scan of one version reads its folder only."""
    entries.repartition("version").write.mode("append").partitionBy("version").parquet(path)


def register_profile(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalogue with new entries; an entry with the same version, path and time is there already."""
    keys = ["version", "path", "time"]
    return catalog.unionByName(fresh.dropDuplicates(keys).join(catalog.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def deregister_profile(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """The catalogue without the entries whose checksum or path is listed in ``keys(key)``."""
    k = keys.select("key").distinct()
    return catalog.join(k.withColumnRenamed("key", "checksum"), "checksum", "left_anti").join(k.withColumnRenamed("key", "path"), "path", "left_anti").select(*catalog.columns)


def _latest(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several frames, the last frame that has a key wins."""
    marked = [b.withColumn("__batch", F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    w = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__batch")


def upsert_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return _latest([stored, fresh], ["version", "location", "type", "cmdstr"])


_CHANGE = r"^(\S+) at (.+?)(?: \((\S+) -> (\S+)\))?: (\S+)% ?(?:with confidence (\S+) = ([0-9.eE+-]+))?(?: by (\S+))?(?: in (.+))?$"


def change_lines(changes: DataFrame) -> DataFrame:
    """One text line per change; the form that ``parse_changes`` reads."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    body = F.concat_ws(
        "", "result", F.lit(" at "), "location", F.lit(" ("), text("from_baseline"), F.lit(" -> "), text("to_target"), F.lit("): "), text("rate"), F.lit("%"),
        F.when(F.col("confidence_type").isNotNull(), F.concat(F.lit(" with confidence "), "confidence_type", F.lit(" = "), text("confidence"))), F.lit(" by "), text("type"), F.lit(" in "), text("cmdstr"),
    )
    return changes.select(body.alias("value"))


def parse_changes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, rejected lines)."""
    m = lambda g: F.nullif(F.nullif(F.regexp_extract("value", _CHANGE, g), F.lit("")), F.lit("-"))
    fits = F.col("value").rlike(_CHANGE)
    good = lines.where(fits).select(
        m(1).alias("result"), m(2).alias("location"), m(3).alias("from_baseline"), m(4).alias("to_target"), m(5).try_cast("double").alias("rate"), m(6).alias("confidence_type"),
        m(7).try_cast("double").alias("confidence"), m(8).alias("type"), m(9).alias("cmdstr"),
    )
    return good.where(severity(F.col("result")).isNotNull()), lines.where(~fits | severity(F.regexp_extract("value", _CHANGE, 1)).isNull())


def write_folded(df: DataFrame, path: str) -> None:
    folded_lines(df).write.mode("overwrite").text(path)


def table_of(df: DataFrame, columns: list[str], path: str | None = None, sort: str | None = None, form: str = "csv") -> DataFrame:
    """Chosen columns, sorted; also written in the form if a path is given."""
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    out = out.orderBy(F.col(f"`{sort}`")) if sort else out
    if path is not None:
        out.write.mode("overwrite").option("header", True).format(form).save(path)
    return out


def _nan_for_missing(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{f.name}`").cast("double"), F.lit(float("nan"))).alias(f.name) if isinstance(f.dataType, NumericType) else F.col(f"`{f.name}`") for f in df.schema])


def resource_frame(df: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Resources as one flat frame: every field a column, ``snapshots`` the number of the snapshot (0 without one), NaN for numbers that a resource lacks."""
    rows = df if snapshot in df.columns else df.withColumn(snapshot, F.lit(0))
    flat = _nan_for_missing(flatten_fields(rows.withColumn(snapshot, F.coalesce(snapshot, F.lit(0)))))
    return flat.withColumn(snapshot, F.col(f"`{snapshot}`").cast("int")).withColumnRenamed(snapshot, "snapshots")


def model_frame(models: DataFrame) -> DataFrame:
    """Model rows as one flat frame, with NaN for coefficients and statistics that a kind lacks."""
    return _nan_for_missing(flatten_fields(models))


def save_stats(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return _latest([stored, fresh], ["version", "name", "stat_id"])


def update_stats(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Map values are extended, the fresh side wins per key; other ids are added."""
    keys = ["version", "name", "stat_id"]
    both = stored.withColumnRenamed("value", "a").join(fresh.withColumnRenamed("value", "b"), keys, "full_outer")
    kept = F.map_filter("a", lambda k, _: ~F.map_contains_key("b", k))
    return both.select(*keys, F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.map_concat(kept, "b")).alias("value"))


def delete_stats(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.select("version", "name", "stat_id"), ["version", "name", "stat_id"], "left_anti")
