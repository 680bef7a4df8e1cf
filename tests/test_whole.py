"""Registered queries and closures take all of their input."""

import random

import pytest

from profloom.operators import aggregates, graph, joins, models
from pyspark.sql import functions as F

def test_empty_snapshots_have_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0), (4, 5.0)], "snapshot int, amount double")
    found = sorted(tuple(r) for r in aggregates.snapshots_dense(rows, F.sum("amount").alias("amount")).select("snapshot", "n", "amount").collect())
    assert found == [(0, 0, None), (1, 2, 5.0), (2, 0, None), (3, 0, None), (4, 1, 5.0)]


def test_bisection_goes_below_an_eighth(spark):
    rows = [("f", float(x), 5.0 if x < 500 else 5.0 + (x - 500) ** 2) for x in range(1, 513)]
    found = models.fit_bisection(spark.createDataFrame(rows, "uid string, structure_unit_size double, amount double"), "uid").collect()
    assert max(r.segment.count(".") for r in found) > 3
    assert sum(r.n for r in found) == 512


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8])
def test_locations_match_like_all_pairs(spark, least):
    r = random.Random(5)
    name = lambda: "".join(r.choice("abcd/") for _ in range(r.randrange(1, 16)))
    base = {name() for _ in range(120)} | {"read_the_file", "xy", "/u/lib/one"}
    target = {"".join(c for c in x if r.random() > 0.1) + r.choice(["", "q", "dd"]) for x in base} | {"my_read_the_file", "zy"}
    target = {r.choice(["", "k", "ab"]) + x for x in target if x}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    alike = {(a, b): 1 - distance(a, b) / max(len(a), len(b)) for a in base - target for b in target - base}
    alike = {k: v for k, v in alike.items() if v >= least}
    best_b, best_t = {}, {}
    for (a, b), v in sorted(alike.items(), key=lambda x: (-x[1], x[0])):
        best_b.setdefault(a, b)
        best_t.setdefault(b, a)
    wanted = {(a, b) for a, b in best_b.items() if best_t[b] == a}
    frame = lambda names: spark.createDataFrame([(x,) for x in sorted(names)], "location string")
    found = {(x.base, x.target) for x in joins.match_locations(frame(base), frame(target), least).collect()}
    assert found == wanted
    assert any(a[:2] != b[:2] for a, b in found)


def test_levels_have_no_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_DEPTH", 3, raising=False)
    edges = [("main", "f0"), *((f"f{i}", f"f{i + 1}") for i in range(6))]
    found = {r.func: r.level for r in graph.graph_levels(spark.createDataFrame(edges, "caller string, callee string")).collect()}
    assert found == {"main": 0, **{f"f{i}": i + 1 for i in range(7)}}


def test_local_cubic_is_weighted_least_squares(spark):
    import numpy as np

    from profloom.operators import nonparam

    r = random.Random(3)
    rows = [("f", float(x), r.random() * 10 + x * x / 50) for x in range(1, 41) for _ in range(r.randrange(1, 4))]
    sizes = nonparam.distinct_sizes(spark.createDataFrame(rows, "uid string, structure_unit_size double, amount double"), "uid")
    found = {p.x: p.estimate for p in nonparam.kernel_estimate(sizes, "uid", h=9.0, kind="tricube", order=3).collect()}
    x, y = (np.array([p[i] for p in rows]) for i in (1, 2))
    for at, estimate in found.items():
        u = np.abs((x - at) / 9.0)
        w = np.where(u < 1, (1 - u**3) ** 3, 0.0)
        assert abs(np.polyfit(x - at, y, 3, w=np.sqrt(w))[-1] - estimate) < 1e-6
    assert len(found) == 40


def test_model_of_takes_the_best_fit(spark):
    from profloom.operators import fields

    rows = [("f", "linear", 0.2, 1.0, 9.0), ("f", "linear", 0.7, 1.0, 5.0), ("f", "power", 0.9, 1.0, 9.0), ("g", "linear", 0.99, 1.0, 9.0)]
    found = fields.model_of(spark.createDataFrame(rows, "uid string, model string, r_square double, x_start double, x_end double"), "linear", "f").collect()
    assert [(r.r_square, r.x_end) for r in found] == [(0.7, 5.0)]
