"""Scans over crowded groups give what plain windows give, and what pandas gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profloom.operators import joins, models, nonparam, scan, windows

CROWD = 40


@pytest.fixture(scope="module")
def series(spark):
    """One crowded function, some small ones and one without a name; ties in x and y, missing y."""
    r = np.random.default_rng(11)
    rows = []
    for uid, n in (("hot", 700), ("b", 30), ("c", 3), (None, 90), ("one", 1)):
        x = r.integers(0, max(2, n // 2), n).astype(float)
        y = np.where(r.random(n) < 0.3, 5.0, np.sin(x / 20) * 40 + r.normal(size=n))
        rows += [(uid, i, float(a), None if uid == "hot" and i % 97 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "uid string, id long, x double, y double").repartition(5)
    df.cache().count()
    yield df
    df.unpersist()


def rows_of(df, *columns):
    return sorted(((*[("" if v is None else round(v, 9) if isinstance(v, float) else v) for v in r],) for r in df.select(*columns).collect()), key=str)


def test_numbers_and_parts(series):
    plain = rows_of(scan.numbered(series, "uid", order=["x", "id"]), "uid", "id", "row", "rows")
    assert rows_of(scan.numbered(series, "uid", order=["x", "id"], crowd=CROWD), "uid", "id", "row", "rows") == plain
    for n in (1, 4, 50):
        ntile = series.withColumn("part", F.expr(f"ntile({n}) over (partition by uid order by x, id)"))
        assert rows_of(scan.dealt(series, n, "uid", order=["x", "id"], crowd=CROWD), "uid", "id", "part") == rows_of(ntile, "uid", "id", "part")


def test_ties_are_spread(spark):
    same = spark.range(4000).select(F.lit("a").alias("uid"), F.lit(1.0).alias("x"))
    found = scan.numbered(same, "uid", order=["x"], crowd=10)
    assert sorted(r.row for r in found.collect()) == list(range(4000))
    blocks = scan._blocks(same, ("uid",), ["x"]).groupBy("_block").count().collect()
    assert len(blocks) > 4 and max(b["count"] for b in blocks) < 2000


@pytest.mark.parametrize("options", [{"window": 4}, {"window": 5, "window_type": "triang"}, {"window": 7, "method": "smm", "center": False, "min_periods": 2}, {"window": 121, "min_periods": 1}])
def test_frames_reach_over_stretches(series, options):
    of = lambda crowd: rows_of(windows.moving_average(series.withColumn("k", F.col("x") * 1000 + F.col("id")), "uid", x="k", y="y", crowd=crowd, **options), "uid", "id", "average")
    assert of(CROWD) == of(None)


@pytest.mark.parametrize("alpha", [1.0, 0.6, 0.05, 0.003])
@pytest.mark.parametrize("crowd", [None, CROWD])
def test_exponential_means_are_those_of_pandas(series, alpha, crowd):
    found = windows.moving_average(series.withColumn("k", F.col("x") * 1000 + F.col("id")), "uid", x="k", y="y", method="ema", alpha=alpha, window=3, crowd=crowd)
    got = {(r.uid, r.id): r.average for r in found.collect()}
    pdf = series.where("y IS NOT NULL").toPandas()
    assert len(got) == len(pdf)
    for uid, g in pdf.groupby("uid", dropna=False):
        g = g.assign(k=g.x * 1000 + g.id).sort_values("k")
        for i, v in zip(g.id, g.y.ewm(alpha=alpha, min_periods=3).mean(), strict=True):
            mine = got[None if pd.isna(uid) else uid, i]
            assert (mine is None and np.isnan(v)) or mine == pytest.approx(v, rel=1e-9, abs=1e-9)


def automatic(g):
    """The rule, point by point."""
    g = g.sort_values(["x", "y"])
    total = ((g.y - g.y.mean()) ** 2).sum()
    width = max(1, int(0.05 * (g.x.max() - g.x.min())))
    while True:
        r2 = 1 - ((g.y - g.y.rolling(width, center=True, min_periods=1).mean()) ** 2).sum() / total if total > 0 else 1.0
        less = max(1, int(min(0.9 * width - 1, 0.15 * (width - 1) * (0.88 - r2))))
        if r2 >= 0.88 or max(1, width - less) == width:
            return width, r2
        width = max(1, width - less)


@pytest.mark.parametrize("stretch", [100_000, 64])
def test_auto_window_is_the_rule(series, stretch):
    wide = series.withColumn("x", F.col("x") * 3).withColumn("y", F.when(F.col("y").isNotNull(), 30 * F.sin(F.col("x") / 60) + F.hash("id") % 1000 / 70))
    found = {r.uid: (r.width, r.r_square) for r in windows.auto_window(wide, "uid", x="x", y="y", stretch=stretch, crowd=CROWD).collect()}
    pdf = wide.where("y IS NOT NULL").toPandas()
    wanted = {None if pd.isna(uid) else uid: automatic(g) for uid, g in pdf.groupby("uid", dropna=False)}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in wanted.items()} and max(v[0] for v in found.values()) > 1
    assert all(found[k][1] == pytest.approx(wanted[k][1], abs=1e-9) for k in wanted)


def test_nearest_version_of_a_crowded_group(spark):
    r = np.random.default_rng(2)
    v = [(k, int(t), f"c{i}") for i, (k, t) in enumerate(zip(r.choice(["a", "b"], 300, p=[0.9, 0.1]), r.integers(0, 5000, 300), strict=True))]
    w = [(str(k), int(t)) for k, t in zip(r.choice(["a", "b"], 900, p=[0.9, 0.1]), r.integers(0, 5000, 900), strict=True)]
    known = spark.createDataFrame([(str(k), t, c) for k, t, c in v], "uid string, date long, checksum string")
    wanted = spark.createDataFrame(w, "uid string, date long")
    plain = rows_of(joins.nearest_version(wanted, known, "uid"), "uid", "date", "checksum")
    assert rows_of(joins.nearest_version(wanted, known, "uid", crowd=50), "uid", "date", "checksum") == plain
    slow = sorted(((k, t, max(((d, c) for q, d, c in v if q == k and d <= t), default=(0, ""))[1]) for k, t in w), key=str)
    assert plain == slow


def fits_of(df, *keys):
    return {tuple(r[k] for k in keys): (r.n, r.r_square, r.b0, r.b1, r.b2) for r in df.collect()}


@pytest.mark.parametrize("crowd", [None, CROWD])
def test_prefix_fits_are_fits_of_prefixes(spark, crowd):
    r = np.random.default_rng(8)
    rows = [(u, i, float(x), float(3 + 2 * x + 0.02 * x * x + r.normal())) for u, n in (("a", 300), ("b", 9), ("c", 2)) for i, x in enumerate(r.integers(1, 60, n) + 1000)]
    pts = spark.createDataFrame(rows, "uid string, order long, x double, y double").repartition(3)
    merged = fits_of(models.prefix_fits(pts, 5, "uid", x="x", y="y", crowd=crowd), "uid", "step", "model")
    order = F.pmod(F.col("order") * 16807, F.lit(2_147_483_647))
    parts = scan.dealt(pts, 5, "uid", order=[order])
    grown = parts.withColumn("step", F.explode(F.sequence("part", F.lit(5))))
    direct = fits_of(models.fit_all(grown, "uid", "step", x="x", y="y"), "uid", "step", "model")
    assert merged.keys() == direct.keys() and len({k[0] for k in direct}) == 2
    for k, v in direct.items():
        for a, b in zip(merged[k], v, strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-5, abs=1e-6), k


def test_the_race_goes_to_the_best_worst_fit(spark):
    r = np.random.default_rng(5)
    rows = [(f"f{u}", i, float(x), float(abs(r.normal()) + [x, x * x, np.log(x), 1.0][u % 4] * r.random())) for u in range(12) for i, x in enumerate(r.integers(1, 40, 60))]
    pts = spark.createDataFrame(rows, "uid string, order long, x double, y double")
    curves = {}
    for f in models.prefix_fits(pts, 6, "uid", x="x", y="y").collect():
        curves.setdefault(f.uid, {}).setdefault(f.model, {})[f.step] = f.r_square
    found = {f.uid: (f.model, f.method) for f in models.fit_iterative(pts, 6, "uid", x="x", y="y").collect()}
    for uid, curve in curves.items():
        at = dict.fromkeys(curve, 1)
        while True:
            best = max(sorted(at), key=lambda m: curve[m].get(at[m], float("-inf")))  # noqa: B023
            if at[best] == 6:
                break
            at[best] += 1
        assert found[uid] == (best, "iterative")


def test_kinds_of_ones_own(spark):
    pts = spark.createDataFrame([("a", float(x), 2 + 3 * float(x) ** 0.5) for x in range(1, 20)], "uid string, x double, y double")
    root = models.Kind("root", F.sqrt, lambda y: y, f_b=lambda b: b * 2)
    found = {f.model: f for f in models.fit_all(pts, "uid", x="x", y="y", kinds=(root, "constant", "quadratic")).collect()}
    assert set(found) == {"root", "constant", "quadratic"}
    assert (found["root"].b0, found["root"].b1, found["root"].r_square) == pytest.approx((2, 6, 1))
    assert {f.model for f in models.fit_all(pts, "uid", x="x", y="y").collect()} == {"linear", "logarithmic", "power", "exponential", "constant", "quadratic"}
    with pytest.raises(ValueError):
        models.fit(pts, "cubic", "uid", x="x", y="y")


def operators_of(df):
    """The operators of a plan, without what a checkpoint or cache inside it has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_crowded_groups_are_told_apart_without_a_shuffle_by_key(spark, series):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        calm, hot = scan.split_crowded(series, "uid", crowd=CROWD)
        for part in (calm, hot):
            assert "BroadcastHashJoin" in operators_of(part) and "SortMergeJoin" not in operators_of(part)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert calm.count() + hot.count() == series.count()
    assert not {r.uid for r in calm.select("uid").distinct().collect()} & {r.uid for r in hot.select("uid").distinct().collect()}


@pytest.mark.parametrize("options", [{}, {"method": "ema", "alpha": 0.3}])
def test_curve_in_pieces_is_the_whole_curve(series, options):
    wide = series.where("uid IS NOT NULL").withColumn("k", F.col("x") * 1000 + F.col("id"))
    whole = {r.uid: r for r in nonparam.moving_average_model(wide.where("y IS NOT NULL"), "uid", x="k", y="y", window=3, **options).collect()}
    pieces = nonparam.moving_average_model(wide.where("y IS NOT NULL"), "uid", x="k", y="y", window=3, length=50, crowd=CROWD, **options).orderBy("piece").collect()
    assert max(len(r.bucket_stats) for r in pieces) == 50
    for uid, w in whole.items():
        mine = [r for r in pieces if r.uid == uid]
        assert [v for r in mine for v in r.bucket_stats] == pytest.approx(w.bucket_stats, abs=1e-9)
        assert {(r.x_start, r.x_end, r.window_width) for r in mine} == {(w.x_start, w.x_end, w.window_width)}
        assert all(r.r_square == pytest.approx(w.r_square, abs=1e-9) for r in mine)


def test_narrow_rounds_move_no_points(spark, series):
    """Rows with their neighbours give the errors that rows give which look up their sums, without a shuffle of points."""
    pts = series.where("uid = 'hot' AND y IS NOT NULL").select("uid", "x", "y")
    rows = scan.stretches(pts, "uid", order=["x", "y"], value="y", length=64, crowd=CROWD)
    rows = rows.withColumn("ahead", F.expr("coalesce(sum(aggregate(ys, 0D, (a, v) -> a + v)) over (partition by uid order by stretch rows between unbounded preceding and 1 preceding), 0D)")).cache()
    near = windows._with_neighbours(rows, ("uid",)).cache()
    for width in (1, 2, 63, 64, 127, 128):
        open_ = spark.createDataFrame([("hot", width, 1.0)], "uid string, width int, spread double")
        wanted = windows._squared_errors(rows, open_, ("uid",), 64).collect()
        found = windows._near_errors(near, open_, ("uid",), 64)
        assert [r.sse for r in found.collect()] == pytest.approx([r.sse for r in wanted], rel=1e-12)
    assert "SortMergeJoin" not in operators_of(found) and operators_of(found).count("MapInArrow") >= 1


def test_bisection_numbers_the_points_once(series, monkeypatch):
    calls, numbered = [], scan.numbered
    monkeypatch.setattr(scan, "numbered", lambda *a, **k: calls.append(a) or numbered(*a, **k))
    found = models.fit_bisection(series, "uid", x="x", y="y", crowd=CROWD).collect()
    assert max(r.segment.count(".") for r in found) > 2
    assert len(calls) == 1


@pytest.mark.parametrize(("crowd", "few"), [(CROWD, 100_000), (CROWD, 0), (None, 0)])
def test_bisection_is_the_same_by_any_way(series, monkeypatch, crowd, few):
    rows = lambda df: sorted((str(r.uid), r.segment, r.model, r.n, r.x_start, r.x_end) for r in df.collect())
    wanted = rows(models.fit_bisection(series, "uid", x="x", y="y"))
    monkeypatch.setattr(models, "_BROADCAST", few)
    assert rows(models.fit_bisection(series, "uid", x="x", y="y", crowd=crowd)) == wanted
