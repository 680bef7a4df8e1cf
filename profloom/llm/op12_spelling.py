"""Spelling variants: words one edit apart, found by products of letter-count matrices.

An edit of one code point moves a word's letter counts by a squared distance of 1 (one more or
one less) or 2 (one for another). Words are put into blocks; within a block, NumPy products of
the blocks' count matrices give all squared distances at once, pairs at a distance of at most
two between words of equal or adjacent length are kept, and their edit is verified letter by letter.

Blocks: letters are dealt into ``GROUPS`` groups of like weight. At most two letters' counts
differ, so at least ``GROUPS - 2`` groups agree; a block is a choice of ``GROUPS - 2`` groups, the
counts of their letters, and a length. A word stands in its own length's block and, as the shorter
one, in that of the next length. A pair that meets in several blocks is reported by the first
choice only. Blocks of more than ``TILE`` words are cut into tiles and every pair of tiles is a
group of its own, so that no block lands in one task.

Defined cases: a null or empty text has no words; a null id stands as the empty string; repeated
rows count again; ties of the best form go to the smallest word in code-point order; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import cut, discard, mix64, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LETTERS = 26 + 64
#: Letters from frequent to rare; dealt in this order they weigh the groups alike. The others follow by code point.
FREQUENT = "etaonirshulcdmgpbfvzwkyqjx"
GROUPS = 4
CHOICES = tuple(combinations(range(GROUPS), GROUPS - 2))
#: Words of one side of one product.
TILE = 2048
DISTANCE = 2


def _group_of_letter() -> np.ndarray:
    order = [ord(c) - 97 for c in FREQUENT] + list(range(26, LETTERS))
    out = np.empty(LETTERS, np.int64)
    out[order] = np.arange(LETTERS) % GROUPS
    return out


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters, A-Z lower-cased."""
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # all ASCII: the fast way to lower case is the right one
    return found.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))


def misspelt(id_: Column, run: Column, every: int = 97) -> Column:
    """The run, less one code point in one of ``every`` cases, both chosen by a checksum of id and run."""
    h = F.crc32(F.concat(id_, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of ``words(word)``."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, length of each)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    letter = np.where(points < 128, points - 97, points - 0xC0 + 26)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(rows * LETTERS + letter, minlength=len(lengths) * LETTERS).reshape(-1, LETTERS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each choice of groups and each of the two lengths: (choice, length, print, longer, word, n)."""
    group = _group_of_letter()
    weight = mix64(np.arange(1, LETTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        if not batch.num_rows:
            continue
        points, lengths = code_points(batch.column(0).to_pylist())
        counts = letter_counts(points, lengths).astype(np.uint64)
        prints = [(counts[:, group == g] * weight[group == g]).sum(1) for g in range(GROUPS)]
        for c, choice in enumerate(CHOICES):
            mark = mix64(sum(prints[g] for g in choice)).view(np.int64)
            for ahead in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), c, np.int32)), pa.array((lengths + ahead).astype(np.int32)), pa.array(mark),
                        pa.array(np.full(len(lengths), ahead == 0)), batch.column(0), batch.column(1),
                    ],
                    ["choice", "length", "print", "longer", "word", "n"],
                )


def near_in_product(a: np.ndarray, b: np.ndarray, triangle: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two count matrices at a squared distance of at most ``DISTANCE``; ``triangle``: of one matrix, each pair once."""
    square = lambda m: np.einsum("ij,ij->i", m, m)
    close = square(a)[:, None] + square(b)[None, :] - 2 * (a @ b.T) <= DISTANCE + 0.5
    i, j = np.nonzero(np.triu(close, 1) if triangle else close)
    return i, j


def one_replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Is the long word the short one with one code point more? The common ends must cover the short word."""
    head = np.cumprod(short == long[:, :-1], 1).sum(1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= short.shape[1]


def _pairs_of_block(choice: int, length: int, i: int, j: int, longer: np.ndarray, tile: np.ndarray, points: np.ndarray, begin: np.ndarray, counts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words within one block, or one pair of its tiles."""
    full, short = np.flatnonzero(longer), np.flatnonzero(~longer)
    of = lambda rows, k: rows[tile[rows] == k]
    word = lambda rows, n: points[begin[rows][:, None] + np.arange(n)]
    if i == j:
        plan = [(full, full, True), (short, full, False)]
    else:
        plan = [(of(full, i), of(full, j), False), (of(short, i), of(full, j), False), (of(short, j), of(full, i), False)]
    found = []
    for k, (p, q, triangle) in enumerate(plan):
        if not len(p) or not len(q):
            continue
        a, b = near_in_product(counts[p], counts[q], triangle)
        a, b = p[a], q[b]
        if not len(a):
            continue
        ok = one_replaced(word(a, length), word(b, length)) if k == 0 else one_inserted(word(a, length - 1), word(b, length))
        a, b = a[ok], b[ok]
        changed = np.stack([(counts[a][:, group == g] != counts[b][:, group == g]).any(1) for g in range(GROUPS)], 1)
        first = np.stack([~changed[:, list(c)].any(1) for c in CHOICES], 1).argmax(1)
        found.append((a[first == choice], b[first == choice]))
    return tuple(np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of blocks whose rows come together; what a batch leaves open goes on with the next."""
    group = _group_of_letter()
    heads = ("choice", "length", "print", "i", "j")

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: t.column(c).to_numpy() for c in (*heads, "tile", "n")}
        longer = t.column("longer").to_numpy(zero_copy_only=False)
        words = t.column("word").to_pylist()
        points, lengths = code_points(words)
        begin = np.cumsum(lengths) - lengths
        counts = letter_counts(points, lengths).astype(np.float32)
        edges = np.flatnonzero(np.any([cols[h][1:] != cols[h][:-1] for h in heads], 0)) + 1
        left, right = [], []
        for lo, hi in zip([0, *edges], [*edges, len(words)], strict=True):
            if hi - lo < 2 or not longer[lo:hi].any():
                continue
            a, b = _pairs_of_block(*(int(cols[h][lo]) for h in ("choice", "length", "i", "j")), longer[lo:hi], cols["tile"][lo:hi], points, begin[lo:hi], counts[lo:hi], group)
            if len(a):
                left.append(a + lo)
                right.append(b + lo)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            one, two = np.concatenate((a, b)), np.concatenate((b, a))
            word, n = t.column("word").combine_chunks(), cols["n"]
            yield from pa.table({"word": word.take(pa.array(one)), "n": n[one], "near": word.take(pa.array(two)), "near_n": n[two]}).to_batches(16384)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 4 * TILE:
            continue
        t = pa.Table.from_batches(held)
        last = np.all([t.column(h).to_numpy() == t.column(h)[-1].as_py() for h in heads], 0)
        split = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if split:
            yield from solve(t.slice(0, split))
            held = t.slice(split).combine_chunks().to_batches()
    if held:
        yield from solve(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of ``words(word, n)`` that one edit parts."""
    keyed = words.select("word", "n").mapInArrow(_keys, "choice int, length int, print long, longer boolean, word string, n long")
    block = ["choice", "length", "print"]
    crowded = keyed.groupBy(*block).agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    tiles = F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int")
    dealt = keyed.join(crowded, block, "left").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*block, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "longer", "word", "n")
    heads = [*block, "i", "j"]
    return dealt.repartition(*heads).sortWithinPartitions(*heads).mapInArrow(_match, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the end of each chain, by joining the table with itself until no step is left."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at"), "left")
        found = cut(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return now
        discard(now)
        now = found.select("word", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words(word, n)``: see the module's text."""
    words = cut(words)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    joined = cut(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= 2 * F.col("n"), F.col("best.near")).alias("form"), form_n.alias("form_n"))
        .withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n")))
    )
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents")).select(misspelt(F.col("id"), F.col("run")).alias("word"))
    return spelling_variants(vocabulary(found))


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), once AS (
  SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM found GROUP BY ALL
), summed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM once, steps
), spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM summed
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS MATERIALIZED (
  SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
), ranked AS (
  SELECT a.word, count(*) OVER (PARTITION BY a.word) AS n_near, b.word AS best, b.n AS best_n, a.n,
         row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, encode(b.word)) AS k
  FROM near JOIN words a ON a.word = near.word JOIN words b ON b.word = near.near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.best_n >= 2 * w.n THEN r.best END AS form, CASE WHEN r.best_n >= 2 * w.n THEN r.best_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1
), walk AS (
  SELECT word, word AS stop, 0 AS d FROM formed
  UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN formed f ON f.word = walk.stop WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(stop, d) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
