"""Ancestors by chains against a walk of the graph."""

import random

import pytest

from profloom.operators import joins


def history(r, n, branches):
    """Versions with their parents: mostly the last one or a branch's tip, some merges."""
    tips, out = ["v0"], {"v0": []}
    for i in range(1, n):
        name = f"v{i}"
        if r.random() < branches:
            parents = r.sample(list(out), min(len(out), r.choice([1, 1, 2, 3])))
            tips.append(name)
        else:
            k = r.randrange(len(tips))
            parents = [tips[k]] + ([r.choice(tips)] if r.random() < branches else [])
            tips[k] = name
        out[name] = list(dict.fromkeys(parents))
    return out


def walk(parents, v):
    seen, todo = set(), [v]
    while todo:
        for p in parents.get(todo.pop(), []):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("branches", [0.0, 0.1, 0.5])
def test_ancestor_baselines_are_a_walk(spark, branches):
    r = random.Random(int(branches * 10) + 3)
    parents = history(r, 70, branches)
    parents["v3"] = [*parents["v3"], "before"]  # a version that only stands as a parent
    entries = [(f"p{i}", r.choice([*parents, "before"]), r.choice(["a", "b"]), r.sample(["x", "y"], r.randrange(3))) for i in range(90)]
    versions = spark.createDataFrame(list(parents.items()), "checksum string, parents array<string>").repartition(3)
    profiles = spark.createDataFrame([(*e[:2], "time", e[2], "w", "c", e[3]) for e in entries], "profile_id string, version string, type string, cmd string, workload string, collector string, postprocessors array<string>")
    found = sorted((x.target_id, x.baseline_id) for x in joins.ancestor_baselines(profiles, versions, profiles).collect())
    above = {v: walk(parents, v) for v in [*parents, "before"]}
    assert found == sorted((t[0], b[0]) for t in entries for b in entries if b[1] in above[t[1]] and t[2] == b[2] and set(b[3]) <= set(t[3]))


def test_chains_and_steps_of_a_merge(spark):
    parents = {"a": [], "b": ["a"], "c": ["b"], "x": ["b"], "y": ["x"], "m": ["c", "y"], "n": ["m"]}
    versions = spark.createDataFrame(list(parents.items()), "checksum string, parents array<string>")
    places = joins.chain_cover(versions)
    assert {x.version: (x.chain, x.pos) for x in places.collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "m": ("a", 3), "n": ("a", 4), "x": ("x", 0), "y": ("x", 1)}
    assert sorted(tuple(x) for x in joins.chain_steps(versions, places).select("chain", "pos", "to", "top").collect()) == [("a", 3, "x", 1), ("x", 0, "a", 1)]


def test_a_long_history(spark):
    """A hundred thousand versions; a table of all ancestors would have five thousand million rows."""
    n = 100_000
    parents = "filter(array(if(id > 0, id - 1, null), if(id % 1000 = 0 AND id > 0, id - 1000, null)), x -> x IS NOT NULL)"
    rows = spark.range(n).selectExpr("cast(id as string) AS checksum", f"transform({parents}, x -> cast(x as string)) AS parents")
    head = ["'time' AS type", "'c' AS cmd", "'w' AS workload", "'x' AS collector", "array('p') AS postprocessors"]
    profiles = spark.range(0, n, 10_000).selectExpr("concat('p', id) AS profile_id", "cast(id as string) AS version", *head)
    assert joins.ancestor_baselines(profiles, rows, profiles).count() == 45
