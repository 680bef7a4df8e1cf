import brute
import pytest

from profloom.llm.op01_line_dedup import line_dedup
from profloom.llm.op04_ngram_join import ngram_join
from profloom.llm.op06_suffix_dedup import core_hashes, suffix_dedup, suffix_order


def passages(make):
    parts = [make.text(40) for _ in range(3)]
    docs = []
    for i in range(40):
        t = make.text(make.r.randrange(0, 30))
        for _ in range(make.r.randrange(0, 3)):
            w = make.r.choice(parts).split(" ")
            t += " " + " ".join(w[make.r.randrange(0, 10) : make.r.randrange(20, 40)]) + " " + make.text(make.r.randrange(0, 8))
        docs.append((i, t))
    return docs + [(100, docs[5][1]), (101, docs[5][1]), (102, None), (103, ""), (104, "a" * 350), (105, "a" * 99), (106, "ab" * 150), (107, docs[7][1] * 3)]


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup_is_brute_force(docs_of, make, hot):
    docs = passages(make)
    found = suffix_dedup(docs_of(docs), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found} == brute.suffix_dedup(docs)


def test_suffix_dedup_of_nothing(docs_of):
    assert suffix_dedup(docs_of([])).collect() == []
    assert suffix_dedup(docs_of([(None, "abc")])).first().doc_id is None


def test_suffix_order_sorts_and_counts_common_prefixes():
    import numpy as np

    rows = np.random.default_rng(0).integers(0, 2, (200, 12)).astype(np.uint8)
    group = np.sort(np.random.default_rng(1).integers(0, 5, 200))
    order, shared = suffix_order(rows, group)
    assert (group[order] == group).all()
    for i in range(1, 200):
        if group[i] == group[i - 1]:
            a, b = rows[order[i - 1]].tolist(), rows[order[i]].tolist()
            assert a <= b and shared[i] == next((k for k in range(12) if a[k] != b[k]), 12)


def test_core_hash_depends_on_all_bytes():
    import numpy as np

    data = np.frombuffer(b"0123456789" * 5, np.uint8)
    h = core_hashes(data, 13)
    assert len(h) == 38 and h[0] == h[10] and len(set(h.tolist())) == 10


def near_groups(make):
    docs = []
    for _ in range(20):
        base = make.text(make.r.choice([2, 5, 8, 30, 80, 200]))
        for _ in range(make.r.randrange(1, 10)):
            t = make.near(base, make.r.randrange(0, max(2, len(base.split()) // 40 + 1)))
            docs.append((len(docs) * 3, t.upper() if make.r.random() < 0.2 else t.replace(" ", "  ")))
    common = make.text(100)
    docs += [(5000 + i, common + " " + make.text(make.r.choice([3, 15, 25, 60, 200]))) for i in range(70)]
    return docs + [(9000, None), (9001, ""), (9002, " \n "), (9003, "one two"), (9004, "ONE two"), (9005, "one")]


def test_ngram_join_is_brute_force(docs_of, make):
    docs = near_groups(make)
    found = ngram_join(docs_of(docs)).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.ngram_join(docs)


def test_ngram_join_of_nothing_and_of_repeated_rows(docs_of):
    assert ngram_join(docs_of([])).collect() == []
    found = ngram_join(docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(1, 2, 1), (2, 2, 1)]


def lined(make):
    shared = [make.text(make.r.randrange(1, 14)) for _ in range(12)]
    docs = []
    for i in range(50):
        lines = [make.text(make.r.randrange(1, 12)) for _ in range(make.r.randrange(0, 6))]
        at = make.r.randrange(0, 9)
        lines[2:2] = shared[at : at + make.r.randrange(0, 4)]
        if make.r.random() < 0.3:
            lines.insert(make.r.randrange(len(lines) + 1), " ")
        docs.append((i, "\n".join(lines)))
    long = "\n".join(["x"] * 30)
    return docs + [(60, None), (61, ""), (62, docs[3][1]), (63, long), (64, long + "\n"), (65, "\n".join(["same line of words that is long enough to count here"] * 5))]


def test_line_dedup_is_brute_force(docs_of, make):
    docs = lined(make)
    source = docs_of(docs)
    found = line_dedup(source)
    assert found.columns == [*source.columns, "n_lines", "n_removed", "n_runs"]
    assert {r.doc_id: r.text for r in found.collect()} == brute.line_dedup(docs)


def test_line_dedup_keeps_rows_without_id(docs_of):
    line = "the same long line of text that would be repeated otherwise, surely"
    found = line_dedup(docs_of([(None, line), (None, line), (1, line)])).collect()
    assert [r.text for r in found] == [line] * 3
    assert line_dedup(docs_of([])).collect() == []


def test_line_dedup_of_very_many_equal_lines(docs_of):
    docs = [(1, "\n".join(["x"] * 20_000)), (2, "\n".join(["a line that is long enough to count as a run all by itself"] * 5_000))]
    found = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup(docs_of(docs)).collect()}
    assert found[1] == ("x", 19_999, 1)  # the window of lines 1 to 8 comes again from line 2 on
    assert found[2] == (docs[1][1].split("\n")[0], 4_999, 1)
