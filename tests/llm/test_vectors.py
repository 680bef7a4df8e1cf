import brute
import numpy as np

from profloom.llm import op02_cover_tree


def test_cover_tree_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op02_cover_tree, "BLOCK", 60)
    monkeypatch.setattr(op02_cover_tree, "LEAF", 8)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(15, 5))
    rows = {i: (base[i % 15] + rng.normal(size=5) * rng.choice([0.01, 0.1, 0.3, 0.6])).tolist() for i in range(300)}
    rows |= {300 + i: rows[i] for i in range(30)} | {330 + i: [2 * z for z in rows[i]] for i in range(10)}
    rows |= {500: None, 501: [0.0] * 5, 502: [1.0, None, 1.0, 1.0, 1.0], 503: [float("nan")] * 5, 504: [float("inf"), 1.0, 1.0, 1.0, 1.0], 505: [], 506: [1.0, 2.0]}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], "vec_id long, embedding array<double>, n int").repartition(3)
    found = op02_cover_tree.near_dedup(df).collect()
    assert {r.id: (r.n_links, r.component_id) for r in found} == brute.cosine_links(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op02_cover_tree.near_dedup(df).collect() == []
    df = spark.createDataFrame([(1, None), (None, [1.0]), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.id, r.n_links, r.component_id) for r in op02_cover_tree.near_dedup(df).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_very_large_and_very_small_vectors(spark):
    rows = [[1.0, 1.0], [1e200, 1e200], [2e200, 2e200], [1e200, 1e200], [1e-200, 1e-200], [5e-324, 5e-324], [1e308, -1e308]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    found = {r.id: (r.n_links, r.component_id) for r in op02_cover_tree.near_dedup(df).collect()}
    assert found == {i: (5, 0) for i in range(6)} | {6: (0, 6)}


def test_repeated_rows_are_one_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted((r.id, r.n_links, r.component_id) for r in op02_cover_tree.near_dedup(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def _shuffled(spark):
    """Bytes that the session's tasks have written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(60_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_pairs_of_blocks_are_not_written(spark, monkeypatch):
    monkeypatch.setattr(op02_cover_tree, "BLOCK", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[1500:1520] = x[:20] + rng.normal(size=(20, 32)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    before = _shuffled(spark)
    found = op02_cover_tree.near_dedup(df).collect()
    written = _shuffled(spark) - before
    assert sorted(r.id for r in found if r.n_links) == [*range(20), *range(1500, 1520)]
    assert all(r.component_id == r.id % 1500 for r in found if r.n_links)
    assert written < 6 * x.nbytes  # was 67 times: each pair of blocks with its vectors


def test_near_groups_and_copies_over_blocks(spark, monkeypatch):
    """Groups whose trees are linked whole, groups in part within the threshold, and weights of copies."""
    monkeypatch.setattr(op02_cover_tree, "BLOCK", 40)
    monkeypatch.setattr(op02_cover_tree, "LEAF", 4)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 24))
    x = [base[i % 3] + rng.normal(size=24) * (0.003, 0.12, 0.25)[i % 3] for i in range(240)]
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate([*x, *x[::6]])}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").repartition(4)
    found = {r.id: (r.n_links, r.component_id) for r in op02_cover_tree.near_dedup(df).collect()}
    assert found == brute.cosine_links(rows)


def test_rows_that_no_hash_tells_apart(spark):
    """Unsound vectors of one id are rows of their own; repeated rows beside copies count once."""
    rows = [(1, [1.0, None, 2.0]), (1, [1.0, 2.0, None]), (1, []), (1, None), (1, None), (2, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0])]
    found = op02_cover_tree.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in found) == [(1, 0, 1)] * 4 + [(2, 1, 2), (3, 1, 2)]
