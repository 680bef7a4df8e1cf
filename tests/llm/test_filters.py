import fnmatch

import brute

from profloom.llm import op05_mixture, op07_decontaminate
from profloom.llm.op09_license_scan import license_scan
from profloom.llm.op10_url_filter import compile_globs, run_automaton, split_url, url_filter
from pyspark.sql import functions as F


def test_automaton_agrees_with_fnmatch(make):
    globs = ("*a*b", "a?c*", "*", "abc", "?", "*ab*ab*", "b*", "x" * 70 + "*", "*" + "ab" * 40)
    texts = ["".join(make.r.choice("abc") for _ in range(make.r.randrange(0, 9))) for _ in range(300)] + ["", "x" * 75, "c" + "ab" * 40]
    hit = run_automaton(compile_globs(globs), [t.encode() for t in texts])
    for t, row in zip(texts, hit, strict=True):
        assert row.tolist() == [fnmatch.fnmatchcase(t, g) for g in globs], t


def test_urls(spark):
    urls = [
        ("http://ththre.example.com/fr/825?page=2", "ththre.example.com", "/fr/825", "com/", "allow"),
        ("HTTP://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("ftp://example.com", "example.com", "", None, "allow"),
        ("http://b.net/es/1#x", "b.net", "/es/1", "net/es/", "block"),
        ("http://b.net/en/1#x", "b.net", "/en/1", None, "allow"),
        ("http://a.org/\x01/.com\x01/", "a.org", "/\x01/.com\x01/", None, "allow"),
        ("http://spam-farm.example.org/en/728", "spam-farm.example.org", "/en/728", None, "block"),
        ("http://a.com:80/x" + "y" * 5000, "a.com:80", "/x" + "y" * 5000, None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = sorted(url_filter(df, "page_id", "url").collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [u[1:] for u in urls]
    assert split_url("a://b?c/d") == ("b", "")
    assert url_filter(df.limit(0), "page_id", "url").collect() == []


def test_mixture_is_brute_force(spark, make):
    rows = [(i, make.text(make.r.randrange(0, 30)), make.r.choice(["en", "en", "de", "fr", None]), make.r.choice(["src0", "src0", "src0", "src1", "src2", "src7", "web", None])) for i in range(300)]
    rows += [(500, None, "en", "src0"), (501, " ", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("budget", F.lit("clash"))
    found = {r.doc_id: (r.copies, r.tail_tokens) for r in op05_mixture.mix(df).collect()}
    assert found == brute.mixture(rows, op05_mixture)
    assert op05_mixture.mix(df.limit(0)).collect() == []


def test_leaks_are_found_and_others_left(spark, docs_of, make):
    items = [(i, make.text(make.r.choice([8, 13, 20, 50]), 10_000)) for i in range(20)] + [(90, "too short"), (91, None), (92, make.text(8, 10_000))]
    items.append((93, items[0][1]))
    docs, leaks = [], set()
    for i in range(120):
        t = make.text(80, 10_000)
        if i % 4 == 0:
            item = items[i // 4 % 20][1].split(" ")
            if len(item) >= 20:
                item[len(item) // 2] = "other"
            w = t.split(" ")
            at = make.r.randrange(len(w))
            t = " ".join(w[:at] + ["".join(c.upper() if "a" <= c <= "z" else c for c in x) + make.r.choice(["", ",", "."]) for x in item] + w[at:])
            leaks.add(i)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, items[1][1]), (203, " ".join(items[2][1].split(" ")[:4]))]
    leaks.add(202)
    marks = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")
    found = op07_decontaminate.overlaps(docs_of(docs), marks).collect()
    assert {r.doc for r in found} == leaks
    assert {r.item for r in found if r.doc == 0} == {0, 93}
    assert op07_decontaminate.overlaps(docs_of([]), marks).collect() == []
    assert op07_decontaminate.overlaps(docs_of([(1, "nothing of the kind"), (2, None)]), marks).collect() == []
    assert op07_decontaminate.overlaps(docs_of(docs), marks.limit(0)).collect() == []


def test_masks_meet_every_pattern_of_substitutions():
    from itertools import combinations

    fits = lambda masks, n, off: any(all(m[j] == "0" or o + j not in off for j in range(len(m))) for m in masks for o in range(n - len(m) + 1))
    whole = lambda n, off: not any(5 * sum(x in off for x in range(lo, lo + k)) <= k for k in range(12, n) for lo in range(n - k + 1))
    for n in range(op07_decontaminate.LEAST_WORDS, 24):  # longer ones can be halved
        for off in combinations(range(n), n * (100 - op07_decontaminate.MATCH) // 100):
            assert fits(op07_decontaminate.SHORT_MASKS.get(n, op07_decontaminate.MASKS), n, off) or not whole(n, off), (n, off)


def test_overlaps_are_brute_force(spark, docs_of, make):
    r, items = make.r, [(i, make.text(n, 10_000)) for i, n in enumerate([6, 7, 8, 9, 10, 11, 12, 14, 15, 15, 19, 24, 50, 50, 150])]
    docs = [(1000, make.text(9, 10_000) + " " + " ".join(items[12][1].split(" ")[20:32]) + " " + make.text(9, 10_000))]  # 12 words, verbatim
    for i in range(150):
        item = items[i % len(items)][1].split(" ")
        n = r.randrange(min(len(item), 9), len(item) + 1)
        lo = r.randrange(len(item) - n + 1)
        part = item[lo : lo + n]
        for k in r.sample(range(n), r.choice([0, n // 6, n // 5, n // 4])):
            part[k] = "other"
        if n > 100:
            part[30:74] = ["gap"] * 44
        docs.append((i, " ".join([make.text(r.randrange(1, 30), 10_000), *part, make.text(r.randrange(1, 30), 10_000)])))

    def runs(d, w):
        for shift in range(1 - len(w), len(d)):
            lo, hi = max(0, shift), min(len(d), shift + len(w))
            sums = [0]
            for k in range(lo, hi):
                sums.append(sums[-1] + (1 if d[k] == w[k - shift] else -4))
            if any(b > a for a, b in zip(sums[:-1], sums[1:], strict=True)):
                yield from (b - a for a in range(len(sums)) for b in range(len(sums) - 1, a, -1) if sums[b] >= sums[a])

    wanted = {}
    for d, t in docs:
        for i, x in items:
            size = max(runs(t.split(" "), x.split(" ")), default=0)
            if size >= min(12, len(x.split(" "))):
                wanted[d, i] = size
    found = {}
    for x in op07_decontaminate.overlaps(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect():
        found[x.doc, x.item] = max(found.get((x.doc, x.item), 0), x.hi - x.lo)
    assert found == wanted
    assert (1000, 12) in found and len(found) > 100


def test_leaks_without_broadcast(spark, docs_of, make, monkeypatch):
    monkeypatch.setattr(op07_decontaminate, "SEED_BOUND", 0)
    item = make.text(30, 10_000)
    marks = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, make.text(50, 10_000)), (2, make.text(9, 10_000) + " " + item)]
    assert {(r.doc, r.item, r.same) for r in op07_decontaminate.overlaps(docs_of(docs), marks).collect()} == {(2, 1, 30)}


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        (1, "a/LICENSE", mit), (2, "a/x.txt", "plain words here\nmore of them"), (3, "a/b/LICENSE.txt", "intro line of many words\n" + gpl), (4, "a/b/c/y.txt", ""),
        (5, "a/b/c/z.txt", "code\n" + mit + "\ncode"), (6, "q/r.txt", None), (7, None, "nothing"), (8, "ab/x.txt", "other words"), (9, None, mit),
    ]
    files += [(100 + i, f"z/{i}.txt", f"some line {i}\nanother line {i}") for i in range(40)]
    df = spark.createDataFrame(files, "fid long, path string, body string").withColumn("license", F.lit("clash"))
    found = {r.id: (r.license, r.declared) for r in license_scan(df, "fid", F.col("path"), "body").collect()}
    assert len(found) == len(files)
    wanted = {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: ("MIT", "own"), 6: (None, "none"), 7: (None, "none"), 8: (None, "none"), 9: ("MIT", "own")}
    assert {k: found[k] for k in wanted} == wanted
    assert license_scan(df.limit(0), "fid", F.col("path"), "body").collect() == []


def test_license_weights_are_those_of_all_words(spark):
    from math import log

    mit = "Released under the MIT License."
    files = [(0, "a/0.txt", "plain stuff " + mit)] + [(i, f"a/{i}.txt", f"plain stuff w{i}") for i in range(1, 60)] + [(100, "b/x.txt", "odd thing " + mit)]
    found = {r.id: r.cosine for r in license_scan(spark.createDataFrame(files, "fid long, path string, body string"), "fid", F.col("path"), "body").collect()}
    idf = lambda df: log(62 / (1 + df))
    dot = 5 * idf(2) ** 2
    assert abs(found[0] - dot / ((dot + 2 * idf(60) ** 2) * dot) ** 0.5) < 1e-8
    assert abs(found[100] - dot / ((dot + 2 * idf(1) ** 2) * dot) ** 0.5) < 1e-8
