"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of ones and zeros slide over the words of a text; a seed is the hash of the
words under the ones, so words under the zeros may differ. Seeds of the benchmark and of
the documents are joined; around each hit the two word sequences are compared word by
word, and an overlap counts that has ``MIN_WORDS`` words (or a shorter item's all) of which
``MATCH`` hundredths are equal. Of the overlaps through a hit the longest is returned; words
at its ends may differ. The masks miss none: a longer overlap holds one of 12 to 23 words of
the same share, and however its substitutions lie, some mask fits between them (tests try all).

A word is a run of ASCII letters and digits and bytes beyond ASCII, A-Z lower-cased, so
punctuation does not hide a leak. Benchmark items under ``MIN_WORDS`` words have masks of their
own; items under ``LEAST_WORDS`` words are told from chance by nothing and left out.

Scale: documents are read once and not shuffled. Seeds that no benchmark item has are
dropped in the scan by a look-up in the sorted benchmark seeds, which are broadcast only
up to ``SEED_BOUND`` of them; beyond it every seed goes through the join. Hits travel
without text; each stretch of hits brings its words once.

Defined cases: null or empty texts have no words; equal items are compared once and all
reported; null items and rows without an id are ignored (such documents are never
flagged); a repeated row is one document; very long texts are read whole and travel only in
stretches around hits. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import PUNCTUATION, U64, cut, lowered, mix64, split_words, table, text_slices, word_hashes

#: The masks; each set meets every overlap of MATCH hundredths.
MASKS = ("1110111", "11010010011", "11010001101")
#: The same for items under MIN_WORDS words, by their number of words.
SHORT_MASKS = {6: ("1111", "11011"), 7: ("11011",), 8: ("111011", "11111"), 9: ("111011",), 10: ("111011", "11010011", "11111"), 11: ("1101011", "1110011")}
MIN_WORDS, LEAST_WORDS, MATCH = 12, 6, 80
#: Benchmark seeds that are broadcast at most (8 bytes each).
SEED_BOUND = 2_000_000


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every word position from which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, len(mask) + 131 * mask.count("1"), U64)
    for j, c in enumerate(mask):
        if c == "1":
            out = mix64(out * U64(0x9FB21C651E98DF25) + words[j : j + n] + U64(j))
    return out


def item_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text."""
    for row, data, offsets in text_slices(texts):
        low = lowered(data)
        starts, ends, rows = split_words(low, offsets, PUNCTUATION)
        hashes = word_hashes(low, starts, ends)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield row + i, hashes[lo:hi]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(batch.column(0)[i].as_py(), w.view(np.int64)) for i, w in item_words(batch.column(1)) if len(w) >= LEAST_WORDS]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.list_(pa.int64()))], ["item", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = np.asarray(words.values).view(U64)
            for mask in SHORT_MASKS.get(len(w), MASKS):
                seeds = seed_hashes(w, mask).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds), pa.array(np.full(len(seeds), item)), pa.array(np.arange(len(seeds), dtype=np.int32))], ["seed", "item", "at"]
                )


def _stretches(wanted, masks: tuple[str, ...], reach: int):
    """Per document and stretch of hits: its words and ``reach`` on either side, and the hits as (position, seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        slots = None
        if known is not None:
            slots = np.zeros(1 << 22, bool)
            slots[(known >> U64(42)).astype(np.int64)] = True
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row, data, offsets in text_slices(batch.column(1)):
                low = lowered(data)
                starts, ends, rows = split_words(low, offsets, PUNCTUATION)
                words = word_hashes(low, starts, ends)
                bounds = np.searchsorted(rows, np.arange(len(offsets)))
                at, seeds = [], []
                for mask in masks:
                    s = seed_hashes(words, mask)
                    p = np.arange(len(s)) if slots is None else np.flatnonzero(slots[(s >> U64(42)).astype(np.int64)])
                    p = p[rows[p] == rows[p + len(mask) - 1]]
                    if known is not None and len(p):
                        k = np.minimum(np.searchsorted(known, s[p]), len(known) - 1)
                        p = p[known[k] == s[p]]
                    at.append(p)
                    seeds.append(s[p])
                pos, seed = np.concatenate(at), np.concatenate(seeds)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, seed = pos[order], seed[order]
                fresh = np.append(True, (pos[1:] - pos[:-1] > reach) | (rows[pos[1:]] != rows[pos[:-1]]))
                cuts = np.flatnonzero(fresh)
                for lo, hi in zip(cuts, np.append(cuts[1:], len(pos)), strict=True):
                    i = int(rows[pos[lo]])
                    begin = max(int(bounds[i]), int(pos[lo]) - reach)
                    end = min(int(bounds[i + 1]), int(pos[hi - 1]) + max(map(len, masks)) + reach)
                    for col, v in zip(
                        out, (row + i, begin - int(bounds[i]), words[begin:end].view(np.int64), (pos[lo:hi] - bounds[i]).astype(np.int32), seed[lo:hi].view(np.int64)), strict=True
                    ):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), *cols[1:]], ["doc", "begin", "words", "pos", "seed"])

    return run


def longest_overlap(same: np.ndarray, at: int) -> tuple[int, int]:
    """[lo, hi) of the longest stretch through ``at`` of which MATCH hundredths are equal; empty if there is none."""
    sums = np.append(0, np.cumsum(np.where(same, 100 - MATCH, -MATCH)))
    ahead = np.maximum.accumulate(sums[::-1])[::-1]  # greatest sum from here on
    ends = np.searchsorted(-ahead, -sums[: at + 1], side="right") - 1  # furthest end for each start
    sizes = np.where(ends > at, ends - np.arange(at + 1), 0)
    lo = int(sizes.argmax())
    return lo, lo + int(sizes[lo])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        doc, begin, shift, item, ats = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4))
        for i in range(batch.num_rows):
            words, ref = (np.asarray(batch.column(k)[i].values) for k in (5, 6))
            lead = shift[i] - begin[i]  # where the item's first word would be
            first, last = max(0, lead), min(len(words), lead + len(ref))
            same = words[first:last] == ref[first - lead : last - lead]
            start, done = begin[i] + first, -1
            for pos in sorted(ats[i]):
                if pos < done:
                    continue
                lo, hi = longest_overlap(same, pos - start)
                if hi - lo >= min(MIN_WORDS, len(ref)):
                    done = start + hi
                    for col, v in zip(out, (doc[i], item[i], start + lo, done, int(same[lo:hi].sum())), strict=True):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc", "item", "lo", "hi", "same"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc, item, lo, hi, same): verified overlaps in words of the document, and equal words in them."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_items, "item long, words array<long>")
    same = cut(items.groupBy("words").agg(F.min("item").alias("item"), F.collect_set("item").alias("items")))
    seeds = cut(same.select("item", "words").mapInArrow(_item_seeds, "seed long, item long, at int"))
    lengths = same.select(F.least(F.size("words"), F.lit(MIN_WORDS)).alias("n")).distinct().collect()  # 7 values at most
    masks = tuple(sorted({m for (n,) in lengths for m in SHORT_MASKS.get(n, MASKS)}))
    (longest,) = same.select(F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    wanted = None
    if seeds.select("seed").distinct().count() <= SEED_BOUND:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([s for (s,) in seeds.select("seed").distinct().collect()], np.int64).view(U64)))
        if not len(wanted.value):
            return spark.createDataFrame([], "doc long, item long, lo long, hi long, same long")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = cut(rows.mapInArrow(_stretches(wanted, masks, longest), "doc long, begin int, words array<long>, pos array<int>, seed array<long>"))
    hits = found.select("doc", "begin", F.explode(F.arrays_zip("pos", "seed")).alias("h")).select("doc", "begin", "h.pos", "h.seed")
    lines = hits.join(seeds, "seed").groupBy("doc", "begin", (F.col("pos") - F.col("at")).alias("shift"), "item").agg(F.collect_set("pos").alias("pos"))
    texts = found.select("doc", "begin", "words").dropDuplicates(["doc", "begin"])
    full = lines.join(texts, ["doc", "begin"]).join(same.select("item", F.col("words").alias("ref")), "item")
    full = full.select("doc", "begin", "shift", "item", "pos", "words", "ref")
    checked = full.mapInArrow(_verify, "doc long, item long, lo long, hi long, same long")
    return checked.join(same.select("item", "items"), "item").select("doc", F.explode("items").alias("item"), "lo", "hi", "same").distinct()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: contaminated, n_overlaps, items, and the widest overlap's equal words."""
    docs = table(spark, sf_dir, "documents")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    per = found.groupBy("doc").agg(F.count("*").alias("n_overlaps"), F.sort_array(F.collect_set("item")).alias("items"), F.max("same").alias("most_equal"))
    return (
        docs.select("doc_id")
        .distinct()
        .join(per, F.col("doc_id") == F.col("doc"), "left")
        .select(
            "doc_id", F.col("doc").isNotNull().alias("contaminated"), F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"),
            F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("most_equal", F.lit(0)).alias("most_equal"),
        )
    )
