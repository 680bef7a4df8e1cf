"""The toxicity query against a slow form: features word by word, trees by their text, the curve point by point."""

import math
import re

import pytest

from profloom.llm import op03_toxicity as tox

SMALL = "/root/testdata/sf0.001"


def slow_features(text, learned):
    text = text or ""
    words = text.lower().split()
    insults, lucky, weights, you, odd = [], [], [], [], 0
    for i, w in enumerate(words):
        letters = tox.plain(w)
        squeezed = re.sub(r"(.)\1{2,}", r"\1\1", letters)
        weight = max([learned.get(k, 0.0) for k in ([letters] if letters else []) + [letters[:k] + "*" for k in (5, 6, 7) if len(letters) >= k]], default=0.0)
        if letters in tox.INSULTS or squeezed in tox.INSULTS:
            insults.append(i)
        if weight:
            lucky.append(i)
        if letters in tox.SECOND_PERSON:
            you.append(i)
        odd += tox.hidden(w)
        weights.append(weight)
    hits = sorted({*insults, *lucky})
    near = sum(any(abs(h - y) <= 5 for y in you) for h in hits)
    raw = text.encode("utf-8", "replace")
    count = lambda test: sum(1 for b in raw if test(b))
    size, n = max(1, len(raw)), max(1, len(words))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    marks = count(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)
    return [
        math.log1p(len(words)), len(insults) / n, min(20, len(insults)), len(lucky) / n, min(20, len(lucky)), max([weights[i] for i in hits], default=0), sum(weights[i] for i in hits) / n, len(you) / n, min(20, near),
        near / max(1, len(hits)), upper / max(1, upper + lower), sum(len(w) > 2 and w.isupper() for w in text.split()) / n, raw.count(b"!") / size, raw.count(b"?") / size, marks / size,
        count(lambda b: 48 <= b <= 57) / size, odd / n, count(lambda b: b >= 128) / size, size / n, len(set(words)) / n,
    ]


def grow(lines):
    """A tree of the model's text: (feature, threshold, left, right) or a value."""
    line = lines.pop(0)
    if found := re.match(r" *Predict: (\S+)", line):
        return float(found[1])
    feature, bound = re.match(r" *If \(feature (\d+) <= (\S+)\)", line).groups()
    left = grow(lines)
    assert lines.pop(0).lstrip().startswith("Else")
    return int(feature), float(bound), left, grow(lines)


def fall(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def on_curve(edges, values, x):
    if x <= edges[0]:
        return values[0]
    for (a, u), (b, v) in zip(zip(edges, values, strict=True), zip(edges[1:], values[1:], strict=True), strict=False):
        if x <= b:
            return v if x == b else u + (v - u) * (x - a) / (b - a)
    return values[-1]


@pytest.fixture
def kept(monkeypatch):
    """What the operator fits: its learned list, trees and curve."""
    seen = {}

    class Trees(tox.GBTClassifier):
        def _fit(self, data):
            seen["trees"] = super()._fit(data)
            return seen["trees"]

    class Curve(tox.IsotonicRegression):
        def _fit(self, data):
            seen["curve"] = super()._fit(data)
            return seen["curve"]

    rows = tox._feature_rows
    monkeypatch.setattr(tox, "GBTClassifier", Trees)
    monkeypatch.setattr(tox, "IsotonicRegression", Curve)
    monkeypatch.setattr(tox, "_feature_rows", lambda learned: seen.__setitem__("learned", learned) or rows(learned))
    return seen


def test_query_is_the_slow_form(spark, kept):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, "You idiot!!"), (-1, None), (-2, ""), (-3, "you STUPID 1d10t " * 3000), (-3, "clean words here"), (-3, "clean words here")], docs.schema)
    docs = docs.unionByName(more)
    found = tox.toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    trees, curve, learned = kept["trees"], kept["curve"], kept["learned"]
    parts = re.split(r"  Tree \d+ \(weight (\S+)\):\n", trees.toDebugString)[1:]
    forest = [(float(w), grow([x for x in body.split("\n") if x.strip()])) for w, body in zip(parts[::2], parts[1::2], strict=True)]
    edges, values = list(curve.boundaries), list(curve.predictions)
    wanted = []
    for r in docs.select("doc_id", "text", tox.held_out("doc_id").alias("out")).collect():
        x = slow_features(r.text, learned)
        margin = 1 / (1 + math.exp(-2 * sum(w * fall(t, x) for w, t in forest)))
        score = min(1.0, max(0.0, 0.98 * on_curve(edges, values, margin) + 0.02 * margin))
        wanted.append((r.doc_id is None, r.doc_id or 0, r.out, round(score, 9), int(score >= 0.5)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, round(r.score, 9), r.predicted) for r in found) == sorted(wanted)
    assert len({w[3] for w in wanted}) > 5
