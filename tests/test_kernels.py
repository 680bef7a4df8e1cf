"""Sums of normal weights by expansions, and what is chosen with them, against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profloom.operators import nonparam


def points(seed, n, span, digits=1):
    r = np.random.default_rng(seed)
    x = np.round(r.random(n) * span - span / 3, digits)
    return x, np.sin(x / 3) * 5 + r.normal(size=n)


def left_out(x, y, h):
    w = np.exp(-((x[:, None] - x[None, :]) ** 2) / (2 * h * h))
    np.fill_diagonal(w, 0)
    some = w.sum(1) > 1e-9
    return float(((y[some] - (w @ y)[some] / w.sum(1)[some]) ** 2).mean())


@pytest.fixture(scope="module")
def data(spark):
    sets = {"a": points(1, 300, 40), "b": points(2, 40, 9), "c": (np.array([0.0, 500.0, 500.0, 501.0]), np.array([1.0, 2.0, 3.0, 4.0]))}
    rows = [(u, i, float(p), float(q)) for u, (x, y) in sets.items() for i, (p, q) in enumerate(zip(x, y, strict=True))]
    return sets, spark.createDataFrame(rows, "uid string, order long, x double, y double").repartition(3)


@pytest.mark.parametrize("h", [0.05, 1.0, 30.0])
def test_sums_are_those_of_all_pairs(data, h):
    sets, df = data
    sizes = nonparam.distinct_sizes(df, "uid", x="x", y="y").withColumn("h", F.lit(h))
    at = {(r.uid, r.i): r for r in sizes.collect()}
    found = nonparam.gauss_sums(sizes, "uid").collect()
    assert len(found) == len(at)
    for r in found:
        x, y = sets[r.uid]
        w = np.exp(-((x - at[r.uid, r.i].x) ** 2) / (2 * h * h))
        assert r.b == pytest.approx(w.sum(), rel=1e-12) and r.a == pytest.approx((w * y).sum(), rel=1e-9, abs=1e-9)


def test_bandwidths_are_those_of_least_error(data):
    sets, df = data
    grid = [0.1, 0.7, 2.0, 9.0]
    found = {r.uid: (r.h, r.mse) for r in nonparam.bandwidth_by_cv(df, "uid", grid=grid, x="x", y="y").collect()}
    for uid, (x, y) in sets.items():
        mse, h = min((left_out(x, y, h), h) for h in grid)
        assert found[uid] == pytest.approx((h, mse))
    gammas = [0.01, 0.3, 4.0]
    ridge = {r.uid: (r.gamma, r.mse) for r in nonparam.kernel_ridge_grid(df, "uid", gammas=gammas, x="x", y="y").collect()}
    for uid, (x, y) in sets.items():
        mse, gamma = min((left_out(x, y, (1 / (2 * g)) ** 0.5), g) for g in gammas)
        assert ridge[uid] == pytest.approx((gamma, mse))


def test_a_ridge_is_a_model_row(data):
    sets, df = data
    r = next(r for r in nonparam.kernel_ridge_model(df, "uid", gammas=[0.01, 0.3, 4.0], x="x", y="y").collect() if r.uid == "a")
    x, y = sets["a"]
    w = np.exp(-r.gamma * (x[:, None] - x[None, :]) ** 2)
    fit = w @ y / w.sum(1)
    order = np.unique(x, return_index=True)[1]
    assert r.bucket_stats == pytest.approx(fit[order].tolist()) and (r.x_start, r.x_end) == (x.min(), x.max())
    assert r.r_square == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("median", [False, True])
def test_bandwidths_of_samples(data, spark, median):
    sets, df = data
    grid = [0.2, 0.5, 1.0]
    marked = df.withColumn("sample", F.pmod(F.xxhash64("order"), F.lit(3))).where("uid = 'a'")
    factors = []
    for s in range(3):
        rows = marked.where(F.col("sample") == s).orderBy("order").collect()
        x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
        unit = x.std(ddof=1) * len(x) ** -0.2
        factors.append(min((left_out(x / unit, y, h), h) for h in grid)[1])
    x = sets["a"][0]
    wanted = (np.median(factors) if median else np.mean(factors)) * x.std(ddof=1) * len(x) ** -0.2
    found = nonparam.bandwidth_by_samples(df.where("uid = 'a'"), "uid", grid=grid, samples=3, median=median, x="x", y="y").first()
    assert found.h == pytest.approx(wanted)
