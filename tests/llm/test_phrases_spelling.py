"""Collocations and spelling variants against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from profloom.llm import op12_spelling
from profloom.llm.op11_collocations import HatTrie, collocations, phrase_counts
from profloom.llm.op12_spelling import misspelt, runs, spelling_variants, vocabulary


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def phrases(rows):
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def best(rows, least, inside, top):
    f = phrases(rows)
    n = Counter()
    for (lang, p), c in f.items():
        if " " not in p:
            n[lang] += c
    out = []
    long = {k: c for k, c in f.items() if k[1].count(" ") == 2 and c >= least}
    for (lang, p), a in f.items():
        w = p.split(" ")
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(g == lang and (q.startswith(p + " ") or q.endswith(" " + p)) and 100 * c >= inside * a for (g, q), c in long.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang]))
    ranked, at = [], Counter()
    for lang, s, a, p, left, right, total in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, total, -s))
    return ranked


@pytest.mark.parametrize("limits", [{}, {"trie_entries": 40, "table_keys": 4}])
def test_collocations_are_brute_force(spark, make, limits):
    stems = ["New", "york", "of", "the", "été", "a b", "of the"]
    rows = []
    for i in range(60):
        words = [make.r.choice(stems) + make.r.choice(["", "", "s"]) for _ in range(make.r.randrange(0, 60))]
        rows.append((make.r.choice(["en", "fr", None]), make.r.choice([" ", "  ", "\t"]).join(w + make.r.choice(["", "", "", ".", ",\n"]) for w in words)))
    rows += [("en", None), ("en", ""), ("xx", "one of.the"), ("en", "the the the the the"), ("en", "the the the the the")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, a string").repartition(3)
    for top in (5, 2000):
        found = collocations(df, least=3, top=top, **limits)
        assert sorted(map(tuple, found.collect())) == sorted(best(rows, 3, 50, top))


def test_collocations_of_one_very_long_text(spark, make):
    text = " ".join(make.r.choice(["ab", "cd", "ef.", "gh"]) for _ in range(900_000))  # more than two sections, more than a chunk of words
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    found = {(r.lang, r.phrase): r.f for r in phrase_counts(df).where("size > 0").collect()}
    assert found == {k: c for k, c in phrases([("en", text)]).items() if c >= 10}
    assert collocations(df.where("false")).collect() == []


def test_trie_bursts_and_spills_in_order():
    rng = np.random.default_rng(3)
    trie, wanted = HatTrie(8), Counter()
    for _ in range(20):
        keys = rng.integers(1, 4, 300) << 42 | rng.integers(0, 5, 300) << 21 | rng.integers(0, 40, 300)
        wanted.update(keys.tolist())
        trie.add(*np.unique(keys, return_counts=True))
    assert len(trie.tables) > 10 and trie.bounds == sorted(trie.bounds) and all(b % (1 << 21) == 0 for b in trie.bounds)
    assert len(trie) == len(wanted)
    first, n = trie.spill(100)
    rest, m = trie.spill(len(trie))
    assert len(trie) == 0 and (np.diff(first) > 0).all() and len(first) >= 100
    assert dict(zip([*first.tolist(), *rest.tolist()], [*n.tolist(), *m.tolist()], strict=True)) == wanted


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(count):
    form, out = {}, {}
    for w, n in count.items():
        others = [v for v in count if near(w, v)]
        top = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = top if top is not None and count[top] >= 2 * n else None
        out[w] = [form[w], w, n, len(others), count[form[w]] if form[w] else None]
    for w, row in out.items():
        while form[row[1]]:
            row[1] = form[row[1]]
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("tile", [2048, 3])
def test_spelling_variants_are_brute_force(spark, make, monkeypatch, tile):
    monkeypatch.setattr(op12_spelling, "TILE", tile)
    count = {}
    for stem in ("letters", "éàüßwörd", "aaaaaa", "stein", "international", "ÀÉÿþaa"):
        for _ in range(40):
            w = list(stem)
            for _ in range(make.r.randrange(3)):
                k = make.r.randrange(len(w))
                w[k : k + make.r.randrange(2)] = make.r.choice(["a", "e", "ÿ", "x", ""])
            if len(w) >= 5:
                count["".join(w)] = make.r.choice([3, 3, 4, 7, 15, 15, 40])
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in count.items()], "word string, n long, near string, tile int").repartition(4)
    found = {r.word: tuple(r)[1:] for r in spelling_variants(df).collect()}
    assert found == variants(count) and any(r[0] for r in found.values())


def test_words_of_texts(docs_of):
    rows = [(i, t) for i in (*range(300), None) for t in ("Straße ÀBCDEF x1y Übergröße", "don't", None, "")] + [(7, "Straße ÀBCDEF x1y Übergröße")] * 2
    wanted = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            wanted[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    found = vocabulary(runs(docs_of(rows)).select(misspelt(F.col("id"), F.col("run")).alias("word")))
    assert {r.word: r.n for r in found.collect()} == {w: n for w, n in wanted.items() if len(w) >= 5 and n >= 3}
    assert spelling_variants(vocabulary(runs(docs_of([])).select(F.col("run").alias("word")))).collect() == []
