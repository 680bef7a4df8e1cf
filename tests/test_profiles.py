"""Layout, tables, frames, checks by name and model strategies."""

import math

import pytest
from pyspark.sql import functions as F

from profloom.operators import checks, fields, ranking
from profloom.sources import sinks


def test_a_version_is_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", f"v{i % 4}", "time", i) for i in range(40)], "profile_id string, version string, type string, n int").repartition(6)
    sinks.write_catalog(rows, str(tmp_path / "c"))
    sinks.write_catalog(rows.where("n = 1").withColumn("profile_id", F.lit("late")), str(tmp_path / "c"))
    stored = spark.read.schema(rows.schema).parquet(str(tmp_path / "c"))
    found = ranking.scan_catalog(stored, "v1")
    assert sorted(r.profile_id for r in found.collect()) == sorted(["late", *[f"p{i}" for i in range(1, 40, 4)]])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "(version#" in plan
    read = found.select("_metadata.file_path").distinct().collect()
    assert len(read) == 2 and all("/version=v1/" in r.file_path for r in read)
    assert ranking.scan_catalog(rows.withColumn("version", F.when(F.col("n") > 37, F.col("version")))).count() == 38


def test_resources_lie_by_version_and_function(spark, tmp_path):
    rows = spark.createDataFrame([(f"v{i % 3}", f"u{i % 5}", float(i)) for i in range(60)], "version string, uid string, amount double").repartition(4)
    sinks.write_resources(rows, str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert sorted(map(tuple, stored.select("version", "uid", "amount").collect())) == sorted(map(tuple, rows.collect()))
    one = [r.uid for r in stored.where("version = 'v2'").select("uid").collect()]
    assert one == sorted(one)
    assert "PushedFilters: [IsNotNull(uid), EqualTo(uid,u1)]" in stored.where("uid = 'u1'")._jdf.queryExecution().executedPlan().toString()


def test_orders(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", -1.0), ("c", 7.0)], "uid string, delta double").repartition(3)
    assert [r.uid for r in ranking.sort_table(df, "delta").collect()] == ["b", "a", "c"]
    assert [r.uid for r in ranking.sort_table(df, "uid", ascending=False).collect()] == ["c", "b", "a"]
    assert [r.uid for r in ranking.order_by_delta(df).collect()] == ["c", "a", "b"]


def test_default_variables():
    assert fields.default_variables(["uid", "amount", "snapshot", "order"]) == ("snapshot", "amount")
    assert fields.default_variables(["structure_unit_size", "order"]) == ("structure_unit_size", None)
    assert fields.default_variables([]) == (None, None)


def test_frames(spark):
    df = spark.createDataFrame([("a", 1, None, ("f", 3)), ("b", None, 2.5, None)], "uid string, snapshot int, amount double, src struct<file:string,line:int>")
    rows = {r.uid: r for r in sinks.resource_frame(df).collect()}
    assert (rows["a"].snapshots, rows["b"].snapshots) == (1, 0) and math.isnan(rows["a"].amount) and rows["b"].amount == 2.5
    assert rows["a"]["src:file"] == "f" and rows["a"]["src:line"] == 3 and math.isnan(rows["b"]["src:line"])
    assert {r.snapshots for r in sinks.resource_frame(df.drop("snapshot")).collect()} == {0}
    model = spark.createDataFrame([("linear", 1.0, None), ("quadratic", 1.0, 2.0)], "model string, b0 double, b2 double")
    assert [math.isnan(r.b2) for r in sinks.model_frame(model).orderBy("model").collect()] == [True, False]


def test_checks_by_name(spark):
    a = spark.createDataFrame([("f", 1.0), ("g", 1.0)], "uid string, amount double")
    b = spark.createDataFrame([("f", 9.0), ("g", 1.0)], "uid string, amount double")
    assert {r.uid: r.result for r in checks.check_profiles(a, b, "average_amount_threshold").collect()} == {"f": "Degradation", "g": "NoChange"}
    same = lambda x, y, *k: x.join(y, "uid").select("uid")
    with checks.registered_check("same", same):
        assert checks.check_profiles(a, b, "same").count() == 2
        with pytest.raises(ValueError):
            checks.register_check("same", same)
    assert "same" not in checks.CHECKS
    assert checks.check_profiles(a, b, same).count() == 2


MODEL = "uid string, model string, r_square double, x_start double, x_end double, b0 double, b1 double, b2 double, bucket_stats array<double>"


def test_strategies(spark):
    base = [("f", "linear", 0.9, 0.0, 8.0, 1.0, 2.0, None, None), ("f", "constant", 0.3, 0.0, 8.0, 5.0, 0.0, None, None), ("f", "regressogram", 0.5, 0.0, 8.0, None, None, None, [1.0, 1.0, 1.0]),
            ("g", "linear", 0.4, 0.0, 4.0, 2.0, 0.0, None, None), ("g", "regressogram", 0.8, 0.0, 4.0, None, None, None, [2.0, 2.0, 2.0]), ("h", "linear", 0.1, 0.0, 1.0, 1.0, 1.0, None, None)]
    target = [("f", "linear", 0.9, 0.0, 8.0, 2.0, 4.0, None, None), ("f", "constant", 0.3, 0.0, 8.0, 5.0, 0.0, None, None), ("f", "regressogram", 0.5, 0.0, 8.0, None, None, None, [1.0, 1.0, 1.0, 1.0]),
              ("g", "linear", 0.9, 0.0, 4.0, 2.2, 0.0, None, None), ("g", "regressogram", 0.7, 0.0, 4.0, None, None, None, [3.0, 3.0, 3.0]), ("h", "linear", 0.9, 0.0, 1.0, 1.0, 1.0, None, None)]
    b, t = (spark.createDataFrame(rows, MODEL) for rows in (base, target))
    rows = lambda s, *c: sorted(tuple(r[x] for x in c) for r in checks.run_with_models(b, t, strategy=s).collect())
    assert rows("best-param", "uid", "rate", "result") == [("f", 1.0, "Degradation"), ("g", 0.1, "MaybeDegradation")]
    assert rows("all-param", "uid", "kind", "rate") == [("f", "constant", 0.0), ("f", "linear", 1.0), ("g", "linear", 0.1)]
    assert rows("best-nonparam", "uid", "rate") == [("f", 0.0), ("g", 0.5)]
    assert rows("all-nonparam", "uid", "kind", "rate") == [("f", "regressogram", 0.0), ("g", "regressogram", 0.5)]
    # the best of all kinds: a regressogram against a line
    assert rows("best-model", "uid", "base_model", "target_model", "rate") == [("f", "linear", "linear", 1.0), ("g", "regressogram", "linear", 0.1)]
    assert [r[:2] for r in rows("best-both", "strategy", "uid", "rate")] == [("best-nonparam", "f"), ("best-nonparam", "g"), ("best-param", "f"), ("best-param", "g")]
    assert len(rows("all-models", "strategy", "uid", "rate")) == 5
    with pytest.raises(ValueError):
        checks.run_with_models(b, t, strategy="best-guess")
