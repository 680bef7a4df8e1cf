import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STEMS = ["ab", "the", "of", "éa", "xyz", "qqq", "lorem", "ip"]


class Maker:
    """Seeded texts."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def text(self, n, span=50):
        return " ".join(self.r.choice(STEMS) + str(self.r.randrange(span)) for _ in range(n))

    def near(self, base, edits):
        w = base.split(" ")
        for _ in range(edits):
            w[self.r.randrange(len(w))] = "new" + str(self.r.randrange(1000))
        return " ".join(w)


@pytest.fixture
def make():
    return Maker(7)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame with extra columns whose names clash with the operators' own."""

    def build(rows, parts=3):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n int, core string").repartition(parts)

    return build
