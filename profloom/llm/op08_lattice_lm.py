"""LM scoring: the marginal likelihood of a text over all its subword segmentations.

A public vocabulary gives the pieces and their first weights (its merge scores, taken as
Zipf ranks). Expected piece counts over the training words (forward-backward on every
word's lattice, weighted by the word's count) re-estimate the piece probabilities. A
text's probability is the sum over all segmentations of the product of its pieces; pieces
do not cross the mark that begins a word, so it is the product of its words' lattices
times the probability of the end symbol. Recursions are in log space.

Scale: words, not tokens, carry the work. Word counts are grouped by Spark; each distinct
word's lattice is walked once, vectorised over many words; per text, words among the
``FREQUENT`` most frequent are looked up in a broadcast of that bound, the others are
joined with the word table by a shuffle. Only the piece table (bounded by the vocabulary)
and the frequent words (bounded) come to the driver. Any byte string has a lattice, as the
vocabulary's byte pieces cover what no other piece does.

Defined cases: null text is empty (one end token); a null id is not held out; repeated
rows train as often as they stand, and every row is returned, also of ids that repeat or are
null; a very long word is summed by itself, in memory of two numbers a byte; an empty
table gives an empty result; without training rows the first weights hold. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import U64, cut, mix64, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of expected counts, and the first weights' pseudo-count in each.
ROUNDS, PRIOR = 2, 1000.0
#: Bound on the words that are broadcast.
FREQUENT = 100_000
#: Distinct words that a counting task holds before it writes them out.
HELD_WORDS = 300_000
MARK = "▁".encode()
_BASE = U64(0x5851F42D4C957F2D)
_SLOTS = 20


class Pieces:
    """Surfaces of the vocabulary, found by length and hash."""

    def __init__(self, surfaces: list[bytes]) -> None:
        self.tables: list[tuple[int, U64, np.ndarray, np.ndarray, np.ndarray]] = []
        self.known = {s: i for i, s in enumerate(surfaces)}
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(surfaces):
            by_length.setdefault(len(s), []).append(i)
        for size, ids in sorted(by_length.items()):
            h = np.zeros(len(ids), U64)
            raw = np.frombuffer(b"".join(surfaces[i] for i in ids), np.uint8).reshape(-1, size)
            for j in range(size):
                h = h * _BASE + raw[:, j].astype(U64) + U64(1)
            h = mix64(h)
            order = np.argsort(h)
            seen = np.zeros(1 << _SLOTS, bool)
            seen[(h >> U64(64 - _SLOTS)).astype(np.int64)] = True
            self.tables.append((size, U64(pow(int(_BASE), size, 1 << 64)), h[order], np.array(ids)[order], seen))

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece ids) over a [word, byte] matrix, by end, then start."""
        n, width = words.shape
        prefix = np.zeros((width + 1, n), U64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * _BASE + words[:, j].astype(U64) + U64(1)
        for end in range(1, width + 1):
            for size, power, hashes, ids, seen in reversed(self.tables):
                if size <= end:
                    h = mix64(prefix[end] - prefix[end - size] * power)
                    rows = np.flatnonzero(seen[(h >> U64(64 - _SLOTS)).astype(np.int64)])
                    if len(rows):
                        at = np.minimum(np.searchsorted(hashes, h[rows]), len(hashes) - 1)
                        good = hashes[at] == h[rows]
                        if good.any():
                            yield end - size, end, rows[good], ids[at[good]]


def read_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Surfaces and first probabilities from a sentencepiece file; equal surfaces are added up."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            weight[bytes([int(piece[3:5], 16)])] += 1e-6
        else:
            surface = piece.encode()
            weight[surface] = weight.get(surface, 0.0) + 1 / (10 + abs(model.get_score(i)))
    for b in range(256):
        weight[bytes([b])] = max(weight[bytes([b])], 1e-6)
    surfaces = sorted(weight)
    p = np.array([weight[s] for s in surfaces])
    return surfaces, p / p.sum()


def _buckets(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, padded byte matrix, lengths): words of like length together, mark included, but for very long ones."""
    sizes = np.fromiter((len(w) if len(w) <= LONG_WORD else -len(MARK) for w in words), np.int64, len(words)) + len(MARK)
    edge, top = 0, 8
    while (sizes > edge).any():
        who = np.flatnonzero((sizes > edge) & (sizes <= top))
        step = max(1, (1 << 20) // top)
        for lo in range(0, len(who), step):
            part = who[lo : lo + step]
            yield part, np.array([(MARK + words[i]).ljust(top, b"\0") for i in part], f"S{top}").view(np.uint8).reshape(len(part), top), sizes[part]
        edge, top = top, top + max(4, top // 2)


class LongWord:
    """Forward and backward sums of one very long word, piece by piece: two numbers a byte, no arcs kept."""

    def __init__(self, pieces: Pieces, logp: np.ndarray, word: bytes) -> None:
        self.logp, self.known, self.word = logp, pieces.known, MARK + word
        self.sizes = sorted({len(s) for s in pieces.known}, reverse=True)
        self.alpha = [-math.inf] * (len(self.word) + 1)
        self.alpha[0] = 0.0
        for end in range(1, len(self.alpha)):
            self.alpha[end] = self._sum([self.alpha[end - size] + logp[i] for size, i in self._back(end)])

    def _back(self, end: int) -> Iterator[tuple[int, int]]:
        """(bytes, piece) of the pieces that end here."""
        for size in self.sizes:
            if size <= end and (i := self.known.get(self.word[end - size : end])) is not None:
                yield size, i

    @staticmethod
    def _sum(logs: list[float]) -> float:
        top = max(logs, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in logs))

    def expected(self, count: float, into: np.ndarray) -> None:
        beta: list[list[float]] = [[] for _ in self.alpha]
        beta[-1].append(0.0)
        for end in range(len(self.alpha) - 1, 0, -1):
            onward = self._sum(beta[end])
            beta[end] = []
            for size, i in self._back(end) if onward > -math.inf else ():
                beta[end - size].append(onward + self.logp[i])
                into[i] += math.exp(self.alpha[end - size] + onward + self.logp[i] - self.alpha[-1]) * count


#: Bytes of a word from which it is summed by itself; shorter ones are summed side by side.
LONG_WORD = 512


def _forward(pieces: Pieces, logp: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, list]:
    alpha = np.full((matrix.shape[1] + 1, len(matrix)), -np.inf)
    alpha[0] = 0
    arcs = list(pieces.arcs(matrix))
    for start, end, rows, ids in arcs:
        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + logp[ids])
    return alpha, arcs


def word_scores(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(words))
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = LongWord(pieces, logp, w).alpha[-1]
    for who, matrix, sizes in _buckets(words):
        alpha, _ = _forward(pieces, logp, matrix)
        out[who] = alpha[sizes, np.arange(len(who))]
    return out


def expected_counts(pieces: Pieces, logp: np.ndarray, words: list[bytes], counts: np.ndarray, into: np.ndarray) -> None:
    """Add the expected number of uses of each piece in ``counts`` copies of the words."""
    for w, count in zip(words, counts, strict=True):
        if len(w) > LONG_WORD:
            LongWord(pieces, logp, w).expected(count, into)
    for who, matrix, sizes in _buckets(words):
        alpha, arcs = _forward(pieces, logp, matrix)
        n = np.arange(len(who))
        total = alpha[sizes, n]
        beta = np.full_like(alpha, -np.inf)
        beta[sizes, n] = 0
        for start, end, rows, ids in reversed(arcs):
            onward = logp[ids] + beta[end, rows]
            live = onward > -np.inf
            rows, ids, onward = rows[live], ids[live], onward[live]
            beta[start, rows] = np.logaddexp(beta[start, rows], onward)
            np.add.at(into, ids, np.exp(alpha[start, rows] + onward - total[rows]) * counts[who[rows]])


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces only


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        for k, c in enumerate(held):
            words = list(c)
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                n = pa.array([c[w] for w in part], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), n if k else pa.nulls(len(part), pa.int64()).fill_null(0), n], ["word", "c", "total"])
            c.clear()

    for batch in batches:
        for text, train in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held[bool(train)].update(_tokens(text))
        if sum(map(len, held)) > HELD_WORDS:
            yield from out()
    yield from out()


def _in_blocks(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def lattice_lm(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    ``train`` is a boolean Column over ``docs``: the rows to learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("body"), F.coalesce(train, F.lit(True)).alias("train"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # ids may repeat or be null
    kind = rows.schema["doc"].dataType.simpleString()
    words = cut(rows.mapInArrow(_count, "word binary, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total")))
    n_docs = rows.where("train").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct = sums.n + n_docs, sums.v + (n_docs > 0)

    surfaces, p = read_pieces(vocabulary)
    prior, p_end = p, 0.5
    shared = spark.sparkContext.broadcast(surfaces)

    def expected(logp: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, into = Pieces(shared.value), np.zeros(len(logp))
            for block in _in_blocks(batches):
                expected_counts(pieces, logp, block.column(0).to_pylist(), block.column(1).to_numpy().astype(float), into)
            used = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(into[used])], ["piece", "n"])

        return run

    if n_docs:
        for _ in range(ROUNDS):
            found = words.where("c > 0").select("word", "c").mapInArrow(expected(np.log(p)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
            uses = np.zeros(len(p))
            for piece, n in found.collect():  # at most one row per piece of the vocabulary
                uses[piece] = n
            total = uses.sum() + n_docs + PRIOR
            p, p_end = (uses + PRIOR * prior) / total, n_docs / total
    logp = np.log(p * (1 - p_end) / p.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for block in _in_blocks(batches):
            found = word_scores(pieces, logp, block.column(0).to_pylist()) / math.log(10)
            c = block.column(1).to_numpy()
            done = pa.table([block.column(0), block.column(1), block.column(2), pa.array(np.log10(c + 1.0)), pa.array(found)], ["word", "c", "total", "base", "score"])
            yield from done.combine_chunks().to_batches(20_000)

    scored = cut(words.mapInArrow(score, "word binary, c long, total long, base double, score double"))
    # the least count such that no more than ``frequent`` words have it
    tail = scored.groupBy(F.floor(F.log2("total") * 8).alias("size")).count().orderBy(F.desc("size")).collect()  # a few hundred rows
    least, room = None, frequent
    for size, n in tail:
        room -= n
        if room < 0:
            break
        least = size
    often = scored.where(F.floor(F.log2("total") * 8) >= least).select("word", "c", "base", "score").collect() if least is not None else []
    known = spark.sparkContext.broadcast({bytes(w): (c > 0, b, s) for w, c, b, s in often})
    end = (float(n_docs > 0), math.log10(n_docs + 1), math.log10(p_end))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look = known.value
            out: list[list] = [[] for _ in range(7)]
            ids, trains, bodies, numbers = batch.column(0), batch.column(2).to_pylist(), batch.column(1), batch.column(3)
            of: list[int] = []

            def done(out: list[list] = out, of: list[int] = of, ids: pa.Array = ids, numbers: pa.Array = numbers) -> pa.RecordBatch:
                kinds = (pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                got = pa.RecordBatch.from_arrays([numbers.take(pa.array(of, pa.int64())), ids.take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["row", "doc", "train", "word", "tf", "n", "known", "base", "score"])
                for col in (*out, of):
                    col.clear()
                return got

            for i, train in enumerate(trains):
                bag = Counter(_tokens(bodies[i].as_py()))
                n, k, base, total = 1, end[0], end[1], end[2]
                for w, tf in bag.items():
                    n += tf
                    if (hit := look.get(w)) is not None:
                        k, base, total = k + tf * hit[0], base + tf * hit[1], total + tf * hit[2]
                    else:
                        of.append(i)
                        for col, v in zip(out, (train, w, tf, 0, 0, 0.0, 0.0), strict=True):
                            col.append(v)
                # the text's own row goes through the join as well, under a key that no word has
                of.append(i)
                for col, v in zip(out, (train, f" {numbers[i]}".encode(), 0, n, int(k), base, total), strict=True):
                    col.append(v)
                if len(of) > 100_000:
                    yield done()
            yield done()

    parts = numbered.mapInArrow(texts, f"row long, doc {kind}, train boolean, word binary, tf long, n long, known long, base double, score double")
    rare = scored.select("word", F.col("c").alias("wc"), F.col("base").alias("wb"), F.col("score").alias("ws"))
    joined = parts.join(rare, "word", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.col("tf")
    summed = joined.groupBy("row", "doc", "train").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("known") + F.when(F.col("wc") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + more("wb")).alias("base"),
        F.sum(F.col("score") + more("ws")).alias("score"),
    )
    return summed.select(
        F.col("doc").alias(id_col),
        (~F.col("train")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"),
        "score",
    )


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lattice_lm(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
