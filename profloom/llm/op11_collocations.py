"""Collocations: phrases whose words stand together more often than their parts would have it.

Counting is by a HAT-trie per task and language. A text's words become numbers of the task's own
dictionary; every word goes in with the two words after it in its piece, so one key of three
numbers counts a trigram and, summed over its prefixes, the bigram and the word. The trie's
leaves are hash tables over ranges of keys; a table that grows too large bursts at the boundary
of a first word, or under a single first word at that of a second. When the trie holds
``TRIE_ENTRIES`` keys its largest subtrees are spilled as sorted runs, each split by prefix (a
hash of the first two words) and sent with its own small dictionary. A task of the next stage
merges the runs of one prefix partition: memory is bounded on both sides, and a frequent word
or passage is summed up before it is sent.

Defined cases: a null or empty text has no words, a null language is ``und``; repeated rows count
again; ties go by count and then by phrase in UTF-8 byte order; extra columns are ignored; an
empty table gives an empty result. A very long text is taken in sections that end at piece breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profloom.llm.common import SLICE_BYTES, U64, cut, lowered, mix64, partitions, split_words, table, text_slices, word_hashes

PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True

#: Bits of a word's number; words that one dictionary holds; keys of one hash table and of a task's tries.
BITS = 21
MASK = (1 << BITS) - 1
TABLE_KEYS, TRIE_ENTRIES = 1 << 15, 1_500_000
#: Words whose keys are made at once; bytes of runs sent on at once; prefix partitions a shuffle partition.
CHUNK_WORDS, SEND_BYTES, SPREAD = 1 << 19, 4 << 20, 4
LONGEST = 3


class HatTrie:
    """Counts of packed keys in hash tables over adjoining ranges; a range begins where a word's number changes."""

    def __init__(self, table_keys: int = TABLE_KEYS) -> None:
        self.table_keys = table_keys
        self.bounds, self.tables, self.burst_at = [0], [{}], [table_keys]

    def __len__(self) -> int:
        return sum(map(len, self.tables))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys``: sorted, each once."""
        edges = [*np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        ks, cs = keys.tolist(), counts.tolist()
        crowded = []
        for b, held in enumerate(self.tables):
            lo, hi = edges[b], edges[b + 1]
            if lo < hi:
                for k, c in zip(ks[lo:hi], cs[lo:hi], strict=True):
                    held[k] = held.get(k, 0) + c
                if len(held) > self.burst_at[b]:
                    crowded.append(b)
        for b in reversed(crowded):
            self._burst(b)

    def _burst(self, b: int) -> None:
        """Two tables out of one, at the boundary of a first word (else of a second one) nearest the middle key."""
        held = self.tables[b]
        keys = np.sort(np.fromiter(held, np.int64, len(held)))
        middle = int(keys[len(keys) // 2])
        for shift in (2 * BITS, BITS):
            below = middle >> shift << shift
            at = below if below > keys[0] else below + (1 << shift)
            if at <= keys[-1]:
                break
        else:  # all keys share both words: nothing to burst at
            self.burst_at[b] = 2 * len(held)
            return
        right = {k: held.pop(k) for k in keys[np.searchsorted(keys, at) :].tolist()}
        self.bounds.insert(b + 1, at)
        self.tables.insert(b + 1, right)
        self.burst_at.insert(b + 1, self.table_keys)
        self.burst_at[b] = self.table_keys

    def spill(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest subtrees until they hold ``least`` keys: (keys in order, counts)."""
        taken, n = [], 0
        for b in sorted(range(len(self.tables)), key=lambda b: -len(self.tables[b])):
            if n >= least:
                break
            taken.append(b)
            n += len(self.tables[b])
        keys, counts = np.empty(n, np.int64), np.empty(n, np.int64)
        at = 0
        for b in sorted(taken):
            held = self.tables[b]
            k, c = np.fromiter(held, np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))
            order = np.argsort(k)
            keys[at : at + len(k)], counts[at : at + len(k)] = k[order], c[order]
            at += len(k)
            self.tables[b] = {}
        return keys, counts


def sections(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are, or one very long text in parts that end at piece breaks."""
    if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
        yield data, offsets
        return
    breaks = np.flatnonzero(PIECE[data])
    at = 0
    while at < len(data):
        k = int(np.searchsorted(breaks, at + SLICE_BYTES))
        to = int(breaks[k]) + 1 if k < len(breaks) else len(data)
        yield data[at:to], np.array([0, to - at])
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, is the word followed by the next one in its piece) of lower-cased texts."""
    starts, ends, rows = split_words(data, offsets, BREAK)
    piece = np.cumsum(PIECE[data])[starts] if len(starts) else starts
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])
    edges = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = data[~BREAK[data]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)]), follows


RUN = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("keys", pa.binary()), ("n", pa.int64())])


class Counter:
    """The tries of one task, one a language, over one dictionary."""

    def __init__(self, parts: int, entries: int, table_keys: int) -> None:
        self.parts, self.entries, self.table_keys = parts, entries, table_keys
        self.ids: dict[bytes, int] = {}
        self.tries: dict[str, HatTrie] = {}

    def add(self, lang: str, words: pa.Array, follows: np.ndarray) -> Iterator[dict]:
        """Count the words; yields runs where the bound on memory asks for it."""
        n = len(words)
        for lo in range(0, n, CHUNK_WORDS):
            own = min(CHUNK_WORDS, n - lo)
            coded = words.slice(lo, own + LONGEST - 1).dictionary_encode()
            if len(self.ids) + len(coded.dictionary) >= MASK:
                yield from self.runs(0)
                self.ids = {}
            ids = self.ids
            number = np.array([ids.setdefault(w, len(ids) + 1) for w in coded.dictionary.to_pylist()], np.int64)
            w = np.zeros(own + LONGEST - 1, np.int64)
            w[: len(coded)] = number[coded.indices.to_numpy()]
            one = follows[lo : lo + own]
            two = np.zeros(own, bool)
            later = follows[lo + 1 : lo + 1 + own]
            two[: len(later)] = later
            keys = w[:own] << 2 * BITS | np.where(one, w[1 : own + 1], 0) << BITS | np.where(one & two, w[2 : own + 2], 0)
            self.tries.setdefault(lang, HatTrie(self.table_keys)).add(*np.unique(keys, return_counts=True))
            if sum(map(len, self.tries.values())) > self.entries:
                yield from self.runs(self.entries // 2)

    def runs(self, leave: int) -> Iterator[dict]:
        """Spill, largest trie first, until ``leave`` keys are left."""
        names = np.array([b"", *self.ids], object)
        excess = sum(map(len, self.tries.values())) - leave
        for lang, trie in sorted(self.tries.items(), key=lambda kv: -len(kv[1])):
            if excess > 0:
                keys, counts = trie.spill(excess)
                excess -= len(keys)
                yield from self._split(lang, keys, counts, names)

    def _split(self, lang: str, keys: np.ndarray, counts: np.ndarray, names: np.ndarray) -> Iterator[dict]:
        if not len(keys):
            return
        a, b, c = keys >> 2 * BITS, keys >> BITS & MASK, keys & MASK
        first = np.flatnonzero(np.diff(a, prepend=-1))
        single, total = a[first], np.add.reduceat(counts, first)  # a word's own count is that of its subtree
        more = b > 0
        nothing = np.zeros(len(single), np.int64)
        a, b, c, n = (np.concatenate(x) for x in ((single, a[more]), (nothing, b[more]), (nothing, c[more]), (total, counts[more])))
        used = np.unique(np.concatenate((a, b)))
        texts = names[used].tolist()
        ends = np.cumsum([len(x) for x in texts])
        h = np.zeros(int(used[-1]) + 1, U64)
        h[used] = word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1])), ends)
        h[0] = 0
        part = (mix64(h[a] * U64(3) + h[b]) % U64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = order[lo:hi]
            local, at = np.unique(np.concatenate((a[rows], b[rows], c[rows])), return_inverse=True)
            if local[0]:  # 0 stands for no word, also where all have one
                local, at = np.concatenate(([0], local)), at + 1
            packed = at.astype(np.uint32).tobytes() + n[rows].tobytes()
            yield {"part": int(part[lo]), "lang": lang, "words": b" ".join(names[local[1:]].tolist()), "keys": pa.compress(packed, "zstd", asbytes=True), "n": hi - lo}


def _count(parts: int, entries: int, table_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, ready, held = Counter(parts, entries, table_keys), [], 0

        def found() -> Iterator[dict]:
            for batch in batches:
                langs = batch.column(0).to_pylist()
                for lang in dict.fromkeys(langs):
                    texts = batch.column(1).filter(pa.array([x == lang for x in langs]))
                    for _, data, offsets in text_slices(texts):
                        for part, edges in sections(lowered(data), offsets):
                            yield from counter.add(lang, *words_of(part, edges))
            yield from counter.runs(0)

        for r in found():
            ready.append(r)
            held += len(r["words"]) + len(r["keys"])
            if held > SEND_BYTES or len(ready) >= 4096:
                yield pa.RecordBatch.from_pylist(ready, schema=RUN)
                ready, held = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=RUN)

    return run


def _merge(least: int):
    """Sums of one language's runs of one prefix partition; only counts of ``least`` and more go on, and the sum of all words' counts."""

    def run(key: tuple[pa.Scalar, ...], runs: pa.Table) -> pa.Table:
        lang = key[1].as_py()
        words, ids, counts, base = [], [], [], 0
        for text, packed, n in zip(*(runs.column(c).to_pylist() for c in ("words", "keys", "n")), strict=True):
            names = text.split(b" ")
            raw = pa.decompress(packed, decompressed_size=20 * n, codec="zstd", asbytes=True)
            at = np.frombuffer(raw, np.uint32, 3 * n).astype(np.int64).reshape(3, n)
            ids.append(np.where(at > 0, at + base, 0))
            counts.append(np.frombuffer(raw, np.int64, n, 12 * n))
            words += names
            base += len(names)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        number = np.concatenate(([0], coded.indices.to_numpy() + 1)).astype(np.int64)
        a, b, c = number[np.concatenate(ids, 1)]
        counts = np.concatenate(counts)
        names = np.array([b"", *coded.dictionary.to_pylist()], object)
        pair, of = np.unique(a << 31 | b, return_inverse=True)
        triple, back = np.unique(of << 31 | c, return_inverse=True)
        by_pair, by_triple = np.zeros(len(pair), np.int64), np.zeros(len(triple), np.int64)
        np.add.at(by_pair, of, counts)
        np.add.at(by_triple, back, counts)
        p1, p2 = names[pair >> 31], names[pair & (1 << 31) - 1]
        out = [(0, b"", int(by_pair[pair & (1 << 31) - 1 == 0].sum()))]
        out += [(2, p1[i] + b" " + p2[i], int(by_pair[i])) if p2[i] else (1, p1[i], int(by_pair[i])) for i in np.flatnonzero(by_pair >= least)]
        t = triple >> 31
        third = names[triple & (1 << 31) - 1]
        out += [(3, p1[t[i]] + b" " + p2[t[i]] + b" " + third[i], int(by_triple[i])) for i in np.flatnonzero((by_triple >= least) & (triple & (1 << 31) - 1 > 0))]
        size, phrase, f = zip(*out, strict=True)
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "size": pa.array(size, pa.int32()), "phrase": pa.array(phrase, pa.binary()), "f": pa.array(f, pa.int64())})

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, trie_entries: int = TRIE_ENTRIES, table_keys: int = TABLE_KEYS) -> DataFrame:
    """(lang, size, phrase, f): words and phrases of two and three words with at least ``least`` occurrences; size 0: shares of a language's number of words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    parts = SPREAD * partitions(docs.sparkSession)
    runs = texts.mapInArrow(_count(parts, trie_entries, table_keys), "part int, lang string, words binary, keys binary, n long")
    merged = runs.groupBy("part", "lang").applyInArrow(_merge(least), "lang string, size int, phrase binary, f long")
    return merged.select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "f")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, inside: int = 50, top: int = 2000, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    A phrase of ``a`` occurrences scores floor(10^6 a^2 / (l r)) at its weakest cut into parts of l and
    r occurrences. It goes if a longer phrase around it has ``inside`` percent of its occurrences or more.
    """
    counts = cut(phrase_counts(docs, lang_col, text_col, least, **limits))
    totals = counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = counts.where("size BETWEEN 1 AND 2").select("lang", "phrase", "f")
    phrases = counts.where("size >= 2").withColumnRenamed("f", "a")
    within = phrases.where("size = 3").select("lang", "a", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    around = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size")
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", wide("l") * wide("r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salt in (64, 8):  # the first of each share before the first of all
        shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salt))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top).drop("rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed
), grams AS (
  SELECT lang, 1 AS size, ws[i] AS phrase FROM placed
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM placed WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM placed WHERE i + 2 <= len(ws)
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2 AND f >= 10
), kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand t WHERE t.size = 3 AND c.size = 2 AND t.lang = c.lang
    AND c.phrase IN (t.ws[1] || ' ' || t.ws[2], t.ws[2] || ' ' || t.ws[3]) AND 100 * t.f >= 50 * c.f)
), cuts AS (
  SELECT lang, phrase, f AS a, 1 AS k, ws[1] AS head, array_to_string(ws[2:], ' ') AS rest FROM kept
  UNION ALL SELECT lang, phrase, f, 2, ws[1] || ' ' || ws[2], ws[3] FROM kept WHERE size = 3
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS b FROM scored
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best WHERE b = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
