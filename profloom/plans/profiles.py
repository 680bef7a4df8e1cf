"""Queries over stored profiles: layout and scans, tables and frames, model strategies, checks by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profloom.operators import checks, fields, models, nonparam, ranking
from profloom.plans import sql
from profloom.plans.catalog import E, O, P, S, query, rounded
from profloom.plans.reports import _SHAPED, _SHAPED_XY, _shaped
from profloom.plans.streams import workdir
from profloom.plans.views import EVENTS, ORDERS, PROFILES, SALES
from profloom.sources import sinks

# layout


@query(f"SELECT version, count(*) AS n, 1 AS files FROM {EVENTS} GROUP BY version")
def write_resources(spark, sf_dir):
    """Resources written by version and read back; each version's rows lie in one folder."""
    path = f"{workdir(spark)}/{uuid.uuid4().hex}"
    sinks.write_resources(E(spark, sf_dir), path)
    rows = spark.read.parquet(path).select(F.date_format("version", "yyyy-MM-dd").alias("version"), F.regexp_extract("_metadata.file_path", "(version=[^/]*)", 1).alias("folder"))
    return rows.groupBy("version").agg(F.count("*").alias("n"), F.countDistinct("folder").cast("int").alias("files"))


@query(f"SELECT profile_id, type, cmd FROM {PROFILES} WHERE version = '2024-01-10'")
def scan_catalog(spark, sf_dir):
    """The entries of one version, out of a catalogue stored by version: other folders are not read."""
    path = f"{workdir(spark)}/{uuid.uuid4().hex}"
    entries = P(spark, sf_dir)
    sinks.write_catalog(entries, path)
    return ranking.scan_catalog(spark.read.schema(entries.schema).parquet(path), "2024-01-10").select("profile_id", "type", "cmd")


# tables and frames


@query(f"SELECT uid, 'structure_unit_size' AS independent, 'amount' AS dependent, round(corr(structure_unit_size, amount), 4) AS r, count(*) AS n FROM {SALES} GROUP BY uid")
def default_variables(spark, sf_dir):
    """How the variables that are taken by default hang together."""
    rows = S(spark, sf_dir)
    x, y = fields.default_variables(rows.columns)
    found = rows.groupBy("uid").agg(F.corr(F.col(f"`{x}`"), F.col(f"`{y}`")).alias("r"), F.count("*").alias("n"))
    return rounded(found.select("uid", F.lit(x).alias("independent"), F.lit(y).alias("dependent"), "r", "n"))


@query(f"SELECT version, uid, round(sum(amount), 4) AS amount FROM {EVENTS} GROUP BY ALL")
def sort_table(spark, sf_dir):
    totals = E(spark, sf_dir).groupBy("version", "uid").agg(F.sum("amount").alias("amount"))
    return ranking.sort_table(rounded(totals), "amount", ascending=False)


@query(f"SELECT uid, location, round(delta, 3) AS delta FROM {sql._EXCLUSIVE}")
def order_by_delta(spark, sf_dir):
    from profloom.plans.catalog import _exclusive

    return ranking.order_by_delta(rounded(checks.exclusive_diff(*_exclusive(spark, sf_dir)), 3)).select("uid", "location", "delta")


@query(f"""SELECT "order", uid, snapshot AS snapshots, round(amount, 4) AS amount, 'NaN'::DOUBLE AS price, NULL AS trace FROM {EVENTS} UNION ALL
  SELECT "order", uid, 0, 'NaN'::DOUBLE, round(amount, 4), trace FROM {ORDERS}""")
def resource_frame(spark, sf_dir):
    """Resources of two collectors in one frame; what one of them lacks is NaN."""
    e = E(spark, sf_dir).select("order", "uid", "snapshot", "amount")
    o = O(spark, sf_dir).select("order", "uid", F.col("amount").alias("price"), F.transform("trace", lambda f: F.struct(f["func"])).alias("trace"))
    frame = sinks.resource_frame(e.unionByName(o, allowMissingColumns=True))
    return rounded(frame.select(F.col("order").cast("long").alias("order"), "uid", "snapshots", "amount", "price", F.nullif("trace", F.lit("")).alias("trace")))


@query(f"SELECT uid, model, round(b0, 4) AS b0, coalesce(round(b2, 4), 'NaN'::DOUBLE) AS b2 FROM {sql.models(sql._XY, 'uid')}")
def model_frame(spark, sf_dir):
    return rounded(sinks.model_frame(models.fit_all(S(spark, sf_dir), "uid")).select("uid", "model", "b0", "b2"))


# checks by name and model strategies


@query(f"""SELECT b.uid, b.m AS base, t.m AS target, CASE WHEN t.m > b.m THEN 'Degradation' WHEN t.m < b.m THEN 'Optimization' ELSE 'NoChange' END AS result FROM
  (SELECT uid, max(amount) AS m FROM {SALES} WHERE profile_id = 'baseline' GROUP BY uid) b JOIN (SELECT uid, max(amount) AS m FROM {SALES} WHERE profile_id = 'target' GROUP BY uid) t USING (uid)""")
def registered_check(spark, sf_dir):
    """A check of the user's own: each function's dearest call."""

    def dearest(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
        top = lambda rows, c: rows.groupBy(*keys, "uid").agg(F.max("amount").alias(c))
        both = top(baseline, "base").join(top(target, "target"), [*keys, "uid"])
        result = F.when(F.col("target") > F.col("base"), "Degradation").when(F.col("target") < F.col("base"), "Optimization").otherwise("NoChange")
        return both.withColumn("result", result)

    rows = S(spark, sf_dir)
    with checks.registered_check("dearest", dearest):
        return checks.check_profiles(rows.where("profile_id = 'baseline'"), rows.where("profile_id = 'target'"), "dearest")


def _of_both_groups(spark, sf_dir: str) -> list[DataFrame]:
    """Each side's curves and an eight-step regressogram of each function."""
    x = F.col("structure_unit_size")
    more = F.when(F.expr("profile_id = 'target' AND uid < 'N'"), 1.3).otherwise(1.0)
    rows = S(spark, sf_dir).withColumn("amount", x * x * more + F.col("amount") / 10000)
    steps = nonparam.regressogram(rows, "profile_id", "uid", buckets=8).withColumn("model", F.lit("regressogram"))
    steps = steps.select("profile_id", "uid", "model", "r_square", "x_start", "x_end", "bucket_stats")
    return [curves.unionByName(steps.where(F.col("profile_id") == side).drop("profile_id"), allowMissingColumns=True) for curves, side in zip(_shaped(spark, sf_dir), ("baseline", "target"), strict=True)]


_STEPS = f"""(WITH a AS (SELECT profile_id, uid, min(x) AS lo, max(x) AS hi, avg(y) AS my FROM {_SHAPED_XY} GROUP BY ALL),
  p AS (SELECT profile_id, uid, y, my, least(floor((x - lo) * 8 / (hi - lo)), 7)::INT AS bin FROM {_SHAPED_XY} JOIN a USING (profile_id, uid)), b AS (SELECT profile_id, uid, bin, avg(y) AS v FROM p GROUP BY ALL),
  r AS (SELECT profile_id, uid, 1 - sum((y - v) ** 2) / sum((y - my) ** 2) AS r_square FROM p JOIN b USING (profile_id, uid, bin) GROUP BY ALL),
  s AS (SELECT profile_id, uid, list(coalesce(v, 0) ORDER BY k) AS s FROM a CROSS JOIN (SELECT unnest(range(0, 8)) AS k) LEFT JOIN b USING (profile_id, uid) WHERE bin = k OR bin IS NULL GROUP BY ALL)
  SELECT profile_id, uid, 'regressogram' AS model, r_square, lo AS x_start, hi AS x_end, s FROM a JOIN r USING (profile_id, uid) JOIN s USING (profile_id, uid))"""
_AREA_OF_STEPS = """(({x}.x_end - {x}.x_start) / 7 * (({s}[1] + 4 * {s}[2] + 2 * {s}[3] + 4 * {s}[4] + 2 * {s}[5] + 4 * {s}[6] + {s}[7]) / 3 + ({s}[7] + {s}[8]) / 2
  + ({s}[1] + {s}[2]) / 2 + ({s}[2] + 4 * {s}[3] + 2 * {s}[4] + 4 * {s}[5] + 2 * {s}[6] + 4 * {s}[7] + {s}[8]) / 3) / 2)"""
_RATED = "round(round(rate, 2), 2) AS rate, " + sql._CLASS.format("rate", 0.1, 0.25) + " AS result"
_NONPARAM = f"""(SELECT uid, ({_AREA_OF_STEPS.format(x='b', s='t.s')} - {_AREA_OF_STEPS.format(x='b', s='b.s')}) / {_AREA_OF_STEPS.format(x='b', s='b.s')} AS rate
  FROM (SELECT * FROM {_STEPS} WHERE profile_id = 'baseline' AND r_square >= 0.15) b JOIN (SELECT * FROM {_STEPS} WHERE profile_id = 'target' AND r_square >= 0.15) t USING (uid))"""


@query(f"SELECT uid, {_RATED} FROM {_NONPARAM}")
def run_with_nonparam_models(spark, sf_dir):
    return rounded(checks.run_with_models(*_of_both_groups(spark, sf_dir), strategy="best-nonparam"), 2)


def _best_param_sql() -> str:
    from profloom.plans.reports import _FIT, _compared

    return f"(SELECT uid, rate FROM {_compared(_FIT.format(sql._best(_SHAPED, 'profile_id, uid')), 'b.uid = t.uid')})"


@query(f"SELECT 'best-param' AS strategy, uid, {_RATED} FROM {_best_param_sql()} UNION ALL SELECT 'best-nonparam', uid, {_RATED} FROM {_NONPARAM}")
def run_with_both_models(spark, sf_dir):
    return rounded(checks.run_with_models(*_of_both_groups(spark, sf_dir), strategy="best-both"), 2)


@query(sql.KERNEL_RIDGE_MODEL)
def kernel_ridge_model(spark, sf_dir):
    found = nonparam.kernel_ridge_model(S(spark, sf_dir), "uid", gammas=[0.001, 0.01, 0.1, 1.0])
    stats = F.col("bucket_stats")
    return rounded(found.select("uid", "gamma", "x_start", "x_end", F.size(stats).alias("points"), F.array_min(stats).alias("lowest"), F.array_max(stats).alias("highest"), "r_square"))
