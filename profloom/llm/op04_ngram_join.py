"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word shingles, ordered rarest first: by the number of
classes of equal documents that hold a shingle, then by hash. Two sets with Jaccard
similarity of at least t overlap in at least ceil(t * n) of each one's n shingles, so they
share at least k of their first n - ceil(t * n) + k: the k-prefix. Each document lengthens
its own prefix (k = 1, 2, ...) while the estimated cost, postings scanned plus candidates
to verify, falls; a pair must then share as many prefix shingles as the smaller k of the
two before it is verified exactly.

How it stays linear where it can:
* identical sets collapse to one class before anything is joined;
* one shuffle finds the shingles that two classes or more hold. Texts are cut to shingles in
  tasks, which settle what they can among their own rows and send each other shingle once to
  the bin of its hash. Only shared shingles (about a sixth in prose) go further; those that
  no other class holds are just counted, as the order puts them first;
* of a document's e shared shingles, the one at place q leaves at most e - q that a partner
  can share from there on. A posting pair that leaves less than the needed overlap is no
  candidate, so that members of a large group of near copies which are too far apart are not
  paired, however many common shingles they share;
* candidates come in rounds. In the first two a document meets one document of each of its
  shingles (linear), which already joins groups of near copies. The last joins the postings
  of shingles whose documents still lie in different components, and only across
  components: a pair inside one is already reachable, a pair across is never skipped. No
  cap is set on postings or candidates;
* candidates are verified on the lists of shared shingles: no other shingle can be in both.

Defined cases: fewer words than a shingle: the whole sequence is the one shingle; null,
empty or blank text: an empty set, linked with nothing. A repeated row is the same
document. Ties of document frequency are settled by hash, and shingles of a set are
distinct. Very long texts are shingled whole. Rows without an id keep a null id and the
component of their class. Extra columns are ignored; an empty table gives an empty result.
Shingles are 64-bit hashes of five 64-bit word hashes, classes are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import SPACES, U64, components, cut, discard, lowered, mix64, partitions, split_words, table, text_slices, word_hashes

WORDS, SIMILAR = 5, 80  # words of a shingle; least similarity in hundredths
#: The longest prefix extension that a document may choose.
MOST_MATCHES = 4
#: Shingles that a task gathers before it sends them, and that a bin of hashes is meant to hold.
GATHERED, BIN = 1 << 20, 1 << 21
#: Rounds in which a shingle's documents meet one of them only.
HUB_ROUNDS = 2


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_slices(texts):
        low = lowered(data)
        starts, ends, rows = split_words(low, offsets, SPACES)
        hashes = word_hashes(low, starts, ends)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        long = np.zeros(max(0, len(hashes) - words + 1), U64)
        for j in range(words):
            long = mix64(long * U64(0x9FB21C651E98DF25) + hashes[j : j + len(long)])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                yield np.unique(long[lo : hi - words + 1])
            elif hi > lo:
                short = np.zeros(1, U64)
                for j in range(lo, hi):
                    short = mix64(short * U64(0x9FB21C651E98DF25) + hashes[j : j + 1])
                yield mix64(short + U64(hi - lo))  # apart from longer shingles
            else:
                yield long[:0]


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix64(s))) if len(s) else 0, int(np.add.reduce(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)))) if len(s) else 0


def _need(n: np.ndarray | int, similar: int) -> np.ndarray | int:
    """Least overlap of a set of n with any set that is similar enough."""
    return -(-n * similar // 100)


def _prefix(n: int, k: int, similar: int) -> int:
    return min(n, n - _need(n, similar) + k)


def _classes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                for col, v in zip((one, two), _prints(s), strict=True):
                    col.append(v)
            signed = [pa.array(np.array(x, U64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *signed], ["doc_id", "n", "s1", "s2"])

    return run


_SENT = "bin long, token array<long>, class array<long>, held array<long>"


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))


def _sent(bins: int, sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SENT``: shingles of one class here go to their bin; those of several are settled.

    A settled shingle is named to its bin once (held), and its classes go on in rows of
    negative bins, which are spread evenly.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    token, name = np.concatenate(sets), np.repeat(np.array(names, U64), sizes)
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    equal = ranked[1:] == ranked[:-1]
    several = np.zeros(len(token), bool)
    several[order[1:][equal]] = True
    several[order[:-1][equal]] = True
    at = ((token >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    alone = np.flatnonzero(~several)
    alone = alone[np.argsort(at[alone], kind="stable")]  # the classes of a bin stay side by side: they pack better
    held = np.unique(token[several])
    all_bins = np.arange(bins + 1)
    ends, ends_held = (np.searchsorted(x, all_bins) for x in (at[alone], ((held >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array(all_bins[:-1]), _lists(token[alone], ends), _lists(name[alone], ends), _lists(held, ends_held)], ["bin", "token", "class", "held"])
    told = np.flatnonzero(several)
    if len(told):
        cuts = np.append(np.arange(0, len(told), 4096), len(told))
        spread = -1 - (token[told[cuts[:-1]]] >> U64(2)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), _lists(token[told], cuts), _lists(name[told], cuts), _lists(held[:0], np.zeros(len(cuts)))], ["bin", "token", "class", "held"])


def _send(words: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                if len(s) and (name := _prints(s)[0]) not in sets:
                    sets[name] = s
                    size += len(s)
                if size >= GATHERED:
                    yield from _sent(bins, list(sets.values()), list(sets))
                    sets, size = {}, 0
        if sets:
            yield from _sent(bins, list(sets.values()), list(sets))

    return run


def _pairs(token: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(name)], ["token", "class"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class) of the shingles that several classes hold; rows come bin by bin."""

    def settled() -> pa.RecordBatch:
        token, name, held = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in have)
        token, name = (x[o] for o in [np.lexsort((name, token))] for x in (token, name))
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])  # a class that came twice
        token, name = token[fresh], name[fresh]
        equal = token[1:] == token[:-1]
        shared = np.isin(token, held)
        shared[1:] |= equal
        shared[:-1] |= equal
        return _pairs(token[shared], name[shared])

    at, have = None, ([], [], [])
    for batch in batches:
        parts = [batch.column(i) for i in (1, 2, 3)]
        flat = [np.asarray(p.flatten()) for p in parts]
        ends = [np.cumsum(np.asarray(p.value_lengths())) for p in parts]
        for i, bin_ in enumerate(batch.column(0).to_pylist()):
            row = [f[(e[i - 1] if i else 0) : e[i]] for f, e in zip(flat, ends, strict=True)]
            if bin_ < 0:
                yield _pairs(row[0], row[1])
                continue
            if bin_ != at:
                if at is not None:
                    yield settled()
                at, have = bin_, ([], [], [])
            for x, v in zip(have, row, strict=True):
                x.append(v)
    if at is not None:
        yield settled()


def _choose(similar: int):
    """Postings of each document: which shingles make its prefix, and how many must match.

    In: doc, n, and its shared shingles as structs (df, token) in order. Out: q, the place
    among these e shingles. The k of least estimated cost is taken; postings count in it from
    which the rest can still reach the overlap with a set of the document's own size.
    """

    def best(n: int, ranks: np.ndarray, df: np.ndarray) -> int:
        choice, least = 0, np.inf
        for k in range(1, min(MOST_MATCHES, _need(n, similar)) + 1):
            inside = ranks < _prefix(n, k, similar)
            if inside.sum() < k:  # a similar set would share k of these
                return 0
            met = inside & ((n - ranks + k - 1) * (100 + similar) >= 2 * similar * n)
            if (cost := df[met].sum() * (1 + 0.01 * n / k**2)) < least:
                choice, least = k, cost
        return choice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            flat = batch.column(2).flatten()
            df, token = (np.asarray(flat.field(i)) for i in range(2))
            ends = np.cumsum(np.asarray(batch.column(2).value_lengths()))
            for doc, n, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.concatenate(([0], ends[:-1])), ends, strict=True):
                places = np.arange(hi - lo)
                ranks = places + n - len(places)  # shingles that no other class holds come first
                if k := best(n, ranks, df[lo:hi]):
                    q = places[ranks < _prefix(n, k, similar)]
                    for col, v in zip(cols, (token[lo:hi][: len(q)], q, *(np.full(len(q), x) for x in (doc, n, hi - lo, k))), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols], ["token", "q", "doc", "n", "e", "k"])

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; see the module's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(rows.mapInArrow(_classes(words), "doc_id long, n long, s1 long, s2 long"))
    class_ = ["n", "s1", "s2"]
    heads = cut(prints.where("n > 0").groupBy(*class_).agg(F.min("doc_id").alias("head")))
    members = cut(prints.distinct().join(heads, class_, "left").select("doc_id", "n", F.coalesce("head", "doc_id").alias("head")))
    discard(prints)

    held = _shared(rows, heads, words, similar)
    postings = cut(held.select("doc", "n", "held").mapInArrow(_choose(similar), "token long, q long, doc long, n long, e long, k long"))
    # two rounds against one document per shingle, then all pairs that are not yet connected
    seen, links, at = None, None, postings.withColumn("comp", F.col("doc"))
    for turn in range(HUB_ROUNDS + 1):
        found = _verify(_enough(_hub_pairs(at, turn, similar) if turn < HUB_ROUNDS else _open_pairs(at, similar), seen), held, similar)
        seen = found.select("a", "b") if seen is None else seen.union(found.select("a", "b"))
        fresh = found.where("linked").select("a", "b")
        links = fresh if links is None else links.union(fresh)
        groups = components(links)
        if turn < HUB_ROUNDS:
            at = postings.join(groups.select(F.col("id").alias("doc"), "component_id"), "doc", "left").withColumn("comp", F.coalesce("component_id", "doc")).drop("component_id")
            at = cut(at)
    named = members.join(groups.select(F.col("id").alias("head"), "component_id"), "head", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "head").alias("component_id"))


def _shared(rows: DataFrame, heads: DataFrame, words: int, similar: int) -> DataFrame:
    """(doc, n, held): of documents whose longest prefix has a shared shingle, all shared ones as structs (df, token) in order."""
    spark = rows.sparkSession
    total = heads.agg(F.sum("n")).first()[0] or 0
    bins = max(4 * partitions(spark), total // BIN)
    sent = rows.select("text").mapInArrow(_send(words, bins), _SENT)
    tokens = cut(sent.repartition("bin").sortWithinPartitions("bin").mapInArrow(_meet, "token long, class long"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    lists = tokens.join(df, "token").groupBy("class").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("held"))
    named = lists.join(heads.where("head IS NOT NULL").select(F.col("s1").alias("class"), F.col("head").alias("doc"), "n"), "class")
    held = cut(named.where(f"n - size(held) < least(n, n - (n * {similar} + 99) div 100 + {MOST_MATCHES})").select("doc", "n", "held"))
    discard(tokens)
    return held


def _fits(similar: int) -> str:
    """Both sizes allow the overlap that the pair needs, and so do both rests from this shingle on."""
    need = f"{similar} * (n + an)"
    return f"an * 100 >= n * {similar} AND n * 100 >= an * {similar} AND (least(e - q, ae - aq) + least(k, ak) - 1) * {100 + similar} >= {need}"


def _as_other(at: DataFrame) -> list:
    return [F.col("doc").alias("other"), F.col("n").alias("an"), F.col("e").alias("ae"), F.col("q").alias("aq"), F.col("k").alias("ak"), F.col("comp").alias("other_comp")]


def _rows_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"), F.least("k", "ak").alias("k"))


def _hub_pairs(at: DataFrame, turn: int, similar: int) -> DataFrame:
    """(a, b, k) rows: each document beside one document of each of its shingles.

    The first time, the one with the smallest share of shingles of its own, which is near most
    of a group of near copies.
    """
    order = F.expr("(n - e) * 1000 div n") if turn == 0 else F.xxhash64(F.lit(turn), "doc")
    hub = F.min(F.struct(order.alias("o"), "doc", "n", "e", "q", "k", "comp")).alias("hub")
    hubs = at.groupBy("token").agg(hub, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "hub.*")
    return _rows_of(at.join(hubs.select("token", *_as_other(hubs)), "token").where(f"comp <> other_comp AND {_fits(similar)}"))


def _open_pairs(at: DataFrame, similar: int) -> DataFrame:
    """(a, b, k) rows of all documents of a shingle that lie in different components.

    The smaller document of a pair (the first of equal ones) stands on the left; its rest from
    the shingle on must reach the overlap of two sets of its size.
    """
    mixed = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    both = at.join(mixed, "token", "left_semi")
    left = both.where(f"(e - q + k - 1) * {100 + similar} >= {2 * similar} * n")
    right = both.select("token", *_as_other(both))
    return _rows_of(left.join(right, "token").where(f"comp <> other_comp AND (n < an OR n = an AND doc < other) AND {_fits(similar)}"))


def _enough(pairs: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Pairs that share enough prefix shingles and were not verified before."""
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("k").alias("k")).where("shared >= k").select("a", "b")
    return found if seen is None else found.join(seen, ["a", "b"], "left_anti")


def _verify(pairs: DataFrame, held: DataFrame, similar: int) -> DataFrame:
    """(a, b, linked): the exact test, on all shared shingles of both."""
    one = held.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("held.token").alias("x"))
    two = held.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("held.token").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("overlap"))
    return cut(both.select("a", "b", F.expr(f"overlap * 100 >= (na + nb - overlap) * {similar}").alias("linked")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END) AS s FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(id, stop) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.stop),
least AS (SELECT id, min(stop) AS m FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.id = d.doc_id
"""
