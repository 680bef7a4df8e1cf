"""Repeated and missing ids: every row has a result of its own."""

import hashlib

import brute
import numpy as np
from pyspark.sql import functions as F

from profloom.llm import op02_cover_tree
from profloom.llm.op06_suffix_dedup import suffix_dedup
from profloom.llm.op08_lattice_lm import lattice_lm


def test_suffix_dedup_tells_texts_of_one_id_apart(docs_of, make):
    long = make.text(600)
    rows = [(None, long), (None, "short"), (1, long), (1, "x" + long), (1, long), (2, make.text(30) + " " + long[40:400]), (3, None), (3, "")]
    distinct = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    wanted = brute.suffix_dedup([(n, t) for n, (*_, t) in enumerate(distinct)])
    wanted = {(i if has else None, t): wanted[n] for n, (has, i, _, t) in enumerate(distinct)}
    found = suffix_dedup(docs_of(rows)).collect()
    key = lambda i, v: (i is not None, i or 0, v)
    assert sorted(key(r.doc_id, (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in found) == sorted(key(i, wanted[i, t or ""]) for i, t in rows)


def test_lattice_lm_returns_every_row(docs_of):
    rows = [(None, "a b"), (None, "a b c d e f"), (5, "one two"), (5, "one two three"), (5, "one two"), (6, None)]
    found = lattice_lm(docs_of(rows), F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 3), (0, 7), (5, 3), (5, 3), (5, 4), (6, 1)]
    same = [r.score for r in found if r.doc_id == 5 and r.n_tokens == 3]
    assert same[0] == same[1] and len({round(r.score, 9) for r in found}) == 5


def test_cover_tree_links_inside_every_length(spark, monkeypatch):
    monkeypatch.setattr(op02_cover_tree, "BLOCK", 20)
    rng = np.random.default_rng(4)
    rows = {}
    for size, n in ((2, 9), (3, 70), (4, 50), (5, 1)):
        base = rng.normal(size=(4, size))
        for k in range(n):
            rows[len(rows)] = (base[k % 4] + rng.normal(size=size) * 0.15).tolist()
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3)
    found = {r.id: (r.n_links, r.component_id) for r in op02_cover_tree.near_dedup(df).collect()}
    wanted = {}
    for size in (2, 3, 4, 5):
        wanted |= brute.cosine_links({i: v for i, v in rows.items() if len(v) == size})
    assert found == wanted and any(n for n, _ in found.values())


def test_cover_tree_keeps_vectors_of_one_id_apart(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0])]
    found = op02_cover_tree.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in found) == [(0, 1, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 0)]
