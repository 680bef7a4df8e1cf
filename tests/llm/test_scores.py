import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from profloom.llm import op03_toxicity, op08_lattice_lm


def test_lattice_sums_all_segmentations(monkeypatch):
    surfaces, p = op08_lattice_lm.read_pieces()
    pieces, logp = op08_lattice_lm.Pieces(surfaces), np.log(p)
    known = dict(zip(surfaces, logp, strict=True))

    def slow(word):
        w = op08_lattice_lm.MARK + word
        a = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - 60), j):
                if w[i:j] in known:
                    a[j] = np.logaddexp(a[j], a[i] + known[w[i:j]])
        return a[-1]

    words = [b"the", b"thntblere", "éréier".encode(), b"x", b"\xff\xfe", b"a" * 70, b"hello,", b"|"]
    assert np.allclose(op08_lattice_lm.word_scores(pieces, logp, words), [slow(w) for w in words], rtol=0, atol=1e-9)
    long = b"thntblereab" * 60 + bytes(range(128, 250))
    assert op08_lattice_lm.word_scores(pieces, logp, [long])[0] == pytest.approx(slow(long), abs=1e-6)
    apart, together = np.zeros(len(p)), np.zeros(len(p))
    op08_lattice_lm.expected_counts(pieces, logp, [long], np.array([3.0]), apart)
    monkeypatch.setattr(op08_lattice_lm, "LONG_WORD", 10_000)
    op08_lattice_lm.expected_counts(pieces, logp, [long], np.array([3.0]), together)
    assert np.allclose(apart, together, atol=1e-6) and apart.sum() > 30
    into = np.zeros(len(p))
    op08_lattice_lm.expected_counts(pieces, logp, [b"the"], np.array([2.0]), into)
    k = surfaces.index(op08_lattice_lm.MARK + b"the")
    up = logp.copy()
    up[k] += 1e-6
    slope = 2 * (op08_lattice_lm.word_scores(pieces, up, [b"the"]) - op08_lattice_lm.word_scores(pieces, logp, [b"the"]))[0] / 1e-6
    assert into[k] == pytest.approx(slope, abs=1e-4)


@pytest.mark.parametrize("frequent", [1000, 3])
def test_base_score_is_brute_force(docs_of, make, frequent):
    docs = [(i, make.text(make.r.randrange(0, 25), 9)) for i in range(60)] + [(100, None), (101, " "), (102, "Only one\there")]
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    found = {r.doc_id: r for r in op08_lattice_lm.lattice_lm(docs_of(docs), train, frequent=frequent).collect()}
    tokens = {i: [*brute.words(t), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(found) == len(docs)
    for i, ws in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-9)
        assert r.score < 0


def test_score_is_a_forward_sum_over_the_whole_text(docs_of, make):
    """The end-to-end score against a slow forward pass, with weights re-estimated in plain Python."""
    docs = [(i, make.text(make.r.randrange(0, 6), 5)) for i in range(30)] + [(100, None), (101, "zz " + "q" * 700)]
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    found = {r.doc_id: r.score for r in op08_lattice_lm.lattice_lm(docs_of(docs), train, frequent=5).collect()}
    surfaces, p = op08_lattice_lm.read_pieces()
    at, most = {s: i for i, s in enumerate(surfaces)}, max(map(len, surfaces))
    tokens = {i: brute.words(t) for i, t in docs}
    learn = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2]

    def sums(word, logp, back=False):
        w = op08_lattice_lm.MARK + word.encode()
        arcs = [(i, j, at[w[i:j]]) for j in range(1, len(w) + 1) for i in range(max(0, j - most), j) if w[i:j] in at]
        a = [0.0] + [-math.inf] * len(w)
        for i, j, k in arcs:
            a[j] = np.logaddexp(a[j], a[i] + logp[k])
        if not back:
            return a[-1]
        b = [-math.inf] * len(w) + [0.0]
        for i, j, k in reversed(arcs):
            b[i] = np.logaddexp(b[i], b[j] + logp[k])
        return [(k, math.exp(a[i] + logp[k] + b[j] - a[-1])) for i, j, k in arcs]

    counts = Counter(w for i in learn for w in tokens[i])
    q, end, prior = p, 0.5, p
    for _ in range(op08_lattice_lm.ROUNDS):
        uses = np.zeros(len(p))
        for w, c in counts.items():
            for k, n in sums(w, np.log(q), True):
                uses[k] += c * n
        total = uses.sum() + len(learn) + op08_lattice_lm.PRIOR
        q, end = (uses + op08_lattice_lm.PRIOR * prior) / total, len(learn) / total
    logp = np.log(q * (1 - end) / q.sum())
    for i, ws in tokens.items():
        assert found[i] == pytest.approx((sum(sums(w, logp) for w in ws) + math.log(end)) / math.log(10), abs=1e-6)


def test_toxicity_finds_planted_texts(spark, docs_of, make):
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        t = make.text(60)
        if toxic:
            w = t.split(" ")
            for _ in range(4):
                w.insert(make.r.randrange(len(w)), make.r.choice(["idiot", "m0ron", "grumb" + make.r.choice(["le", "eln", "ely"])]))
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, "")]
    labels += [(2000, 1), (5, None)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in op03_toxicity.toxicity(docs_of(docs), marks).collect()}
    assert len(found) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[i].predicted, y) for i, y in labels if i in found and found[i].held_out and y is not None]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in op03_toxicity.toxicity(docs_of([(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert op03_toxicity.toxicity(docs_of([]), none).collect() == []


def test_plain_and_hidden_words():
    assert [op03_toxicity.plain(w) for w in ("1d10t", "moron###", "st*pid", "1234", "cl0wn!!")] == ["idiot", "moron", "stpid", "", "clown"]
    assert [op03_toxicity.hidden(w) for w in ("idiot", "1d10t", "moron###", "end.", "well-known")] == [False, True, True, False, False]
