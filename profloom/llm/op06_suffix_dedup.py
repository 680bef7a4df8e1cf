"""Suffix-array dedup: remove bytes covered by a string of ``length`` bytes that also starts earlier.

Suffixes are sorted by a merge sort whose comparisons ask prefix polynomial hashes, by
binary search, for the longest common extension; what the sort finds is then verified on
the bytes. Not every suffix is sorted: each window of ``length`` bytes is anchored at the
smallest hash of its ``CORE``-byte substrings, so windows with equal bytes have equal
anchors, and about two anchors in ``length - CORE`` bytes stand for all windows.

1. Anchors whose core occurs once are dropped (count and join).
2. An anchor whose whole surroundings (all bytes that its windows can hold) also stand
   around an earlier one has nothing but repeated windows. Inside a batch this is settled
   before the shuffle, byte by byte, so a passage that a third of all texts hold costs one
   row per batch; between batches a 128-bit digest of the surroundings decides.
3. What is left are edges of repeats. They bring their surroundings and meet by core. Their
   right sides (core and what follows) and their left sides (what precedes, reversed) are
   sorted; a window with ``a`` bytes left of the anchor is a repeat of an earlier one exactly
   when some earlier anchor shares its class among left sides of ``a`` bytes and among right
   sides of ``length - a`` bytes.
4. Cores with more than ``HOT`` open anchors do not meet in one task: their windows are
   keyed by hash and reduced to the earliest by Spark's partial aggregation.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; equal
documents and overlapping repeats in one document follow the "starts earlier" rule
(smaller doc_id, then smaller start); rows without an id come before all others. Different texts
under one id, or without one, are documents of their own, in the order of their texts' SHA-256;
rows of equal id and text are one document and keep the same bytes. Very long texts are read
whole. Extra columns are ignored; empty tables work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profloom.llm.common import U64, cut, mix64, table, text_slices

LENGTH = 100
CORE = 32
#: Open anchors of one core that a single task may take.
HOT = 200_000
#: Anchors that are sorted together, whole cores at a time.
BLOCK = 20_000
#: In place of a null id.
NO_ID = -(1 << 63)
_BASE = U64(0x2D358DCCAA6C78A5 | 1)


def core_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each ``size``-byte substring, by doubling."""
    if len(data) < size:
        return np.zeros(0, U64)
    out, have, covered = np.zeros(len(data) - size + 1, U64), data.astype(U64) + U64(1), 0
    width, power, rest = 1, int(_BASE), size
    while rest:
        if rest & 1:
            out = out * U64(power) + have[covered : covered + len(out)]
            covered += width
        rest >>= 1
        if rest:
            have = have[: len(have) - width] * U64(power) + have[width:]
            power, width = power * power % (1 << 64), width * 2
    return mix64(out)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    have, size = values, 1
    while size * 2 <= width:
        have, size = pick(have[:-size], have[size:]), size * 2
    return pick(have[: len(have) - (width - size)], have[width - size :]) if width > size else have


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, core hash): the smallest core of every window inside one text."""
    n, span = len(data), length - core + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = core_hashes(data, core)
    least = _sliding(h, span, np.minimum)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[row[: len(least)] != row[length - 1 :]] = 0  # a window over two texts selects nothing
    pad = np.zeros(span - 1, U64)
    reach = _sliding(np.concatenate((pad, least, pad)), span, np.maximum)
    at = np.flatnonzero(reach == h)
    return at, h[at]


def _anchor_rows(length: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, data, offsets in text_slices(batch.column(1)):
                at, h = anchors(data, offsets, length, core)
                doc = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array((at - offsets[doc]).astype(np.int32)), pa.array(ids[row + doc])], ["core", "pos", "doc"]
                )

    return run


#: Stands for what lies past a text; no UTF-8 text holds this byte.
PAST = 255
#: Anchors whose surroundings a task holds at once.
CONTEXTS = 60_000


def _surroundings(data: np.ndarray, at: np.ndarray, length: int, core: int) -> np.ndarray:
    """[anchor, byte]: ``length - core`` bytes before each anchor, then ``length`` bytes from it on."""
    wide = np.full(len(data) + 2 * length, PAST, np.uint8)
    wide[length : length + len(data)] = data
    return wide[(at + length)[:, None] + np.arange(core - length, length)[None, :]]


def _with_surroundings(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, pos, core hash, surroundings) of (doc, body, anchors) rows, by doc and pos, repeated rows once."""

    def whole(held: list[tuple]) -> tuple[np.ndarray, ...]:
        doc, pos, h, around = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((pos, doc))
        fresh = np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (pos[order[1:]] != pos[order[:-1]]))
        return tuple(x[order[fresh]] for x in (doc, pos, h, around))

    for batch in batches:
        held: list[tuple] = []
        rows = 0
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            at = np.asarray(found.values.field(0)).astype(np.int64)
            data = np.frombuffer(text.as_buffer(), np.uint8)
            held.append((np.full(len(at), doc, np.int64), at, np.asarray(found.values.field(1)), _surroundings(data, at, length, core)))
            rows += len(at)
            if rows >= CONTEXTS:
                yield whole(held)
                held, rows = [], 0
        if held:
            yield whole(held)


def _digests(length: int, core: int):
    """Per anchor: two hashes of its surroundings, the stretch that its windows cover, and whether an
    earlier anchor of the same batch has the same surroundings (compared byte by byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, pos, h, around in _with_surroundings(batches, length, core):
            past = around == PAST
            half = length - core
            left, right = half - past[:, :half].sum(1), length - past[:, half:].sum(1)
            keep = left + right >= length
            doc, pos, h, around, left, right = (x[keep] for x in (doc, pos, h, around, left, right))
            one, two = np.zeros((2, len(doc)), U64)
            for j in range(around.shape[1]):
                one = one * _BASE + around[:, j].astype(U64) + U64(1)
                two = (two ^ around[:, j].astype(U64)) * U64(0xD6E8FEB86659FD93) + U64(j)
            one, two = mix64(one), mix64(two)
            _, first, of = np.unique(one, return_index=True, return_inverse=True)
            source = first[of]
            shut = (source != np.arange(len(doc))) & (around == around[source]).all(1)
            one[shut] = mix64(one[shut] + np.flatnonzero(shut).astype(U64) * U64(0x9E3779B97F4A7C15))  # spread: they meet no one
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(h), pa.array(doc), ints(pos), ints(pos - left), ints(pos + right), pa.array(shut)],
                ["h1", "h2", "core", "doc", "pos", "lo", "hi", "shut"],
            )

    return run


def _contexts(length: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, pos, h, around in _with_surroundings(batches, length, core):
            width = around.shape[1]
            ends = (np.arange(len(doc) + 1) * width).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(around).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(pos.astype(np.int32)), blob], ["core", "doc", "pos", "around"])

    return run


def suffix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (strings of symbols) inside each group, and each one's common prefix with the one before.

    ``group`` is non-decreasing. Bottom-up merge sort, all groups and all merges of a level at
    once; two rows are compared at their longest common extension, which a binary search over
    prefix hashes finds in log(width) steps. The extensions returned are counted on the symbols,
    and an order that a hash collision broke is mended by sorting on the symbols themselves.
    """
    n, width = rows.shape
    prefix = np.zeros((n, width + 1), U64)
    for j in range(width):
        prefix[:, j + 1] = prefix[:, j] * _BASE + rows[:, j].astype(U64) + U64(1)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), width)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = prefix[a, mid] == prefix[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        at = common(a, b)
        end = at == width
        at = np.minimum(at, width - 1)
        return np.where(end, ties, rows[a, at] < rows[b, at])

    order = np.arange(n)
    begin = np.searchsorted(group, group, "left")
    finish = np.searchsorted(group, group, "right")
    size, largest = 1, int((finish - begin).max(initial=0))
    while size < largest:
        live = np.flatnonzero(finish - begin > size)
        inside = live - begin[live]
        run = inside // size
        pair = begin[live] + (run & ~1) * size
        other = begin[live] + (run ^ 1) * size
        lo = np.minimum(other, finish[live])
        hi = np.minimum(other + size, finish[live])
        base = lo.copy()
        late = run & 1 == 1  # rows of the right run go after equal ones of the left run
        me = order[live]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            ahead = before(order[mid], me[open_], late[open_])
            lo[open_] = np.where(ahead, mid + 1, lo[open_])
            hi[open_] = np.where(ahead, hi[open_], mid)
        to = pair + inside % size + (lo - base)
        order[to] = me
        size *= 2

    def shared(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = rows[seq[1:]] != rows[seq[:-1]]
        at = np.where(differ.any(1), differ.argmax(1), width)
        here = np.minimum(at, width - 1)
        wrong = (at < width) & (rows[seq[1:], here] < rows[seq[:-1], here]) & (group[1:] == group[:-1])
        out = np.zeros(n, np.int64)
        out[1:] = np.where(group[1:] == group[:-1], at, 0)
        return out, wrong

    extension, wrong = shared(order)
    if wrong.any():
        order = np.lexsort((*rows.T[::-1], group))
        extension, _ = shared(order)
    return order, extension


def repeated_spans(doc: np.ndarray, pos: np.ndarray, core: np.ndarray, around: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi) of the windows that repeat one of an earlier anchor; anchors grouped by ``core``."""
    order = np.lexsort((pos, doc, core))
    core, around = core[order], around[order]
    half = length - size
    n = len(core)
    sides = []
    for rows in (around[:, :half][:, ::-1], around[:, half:]):
        rows = rows.copy()
        past = rows == PAST  # nothing beyond a text's end is common to two of them
        seq, ext = suffix_order(np.ascontiguousarray(rows), core)
        real = np.where(past.any(1), past.argmax(1), rows.shape[1])
        ext[1:] = np.minimum(ext[1:], np.minimum(real[seq[1:]], real[seq[:-1]]))
        best = np.maximum(ext, np.append(ext[1:], 0))
        most = np.empty(n, np.int64)
        most[seq] = best
        sides.append((seq, ext, most))
    alive = sides[0][2] + sides[1][2] >= length
    found = []
    for a in range(half + 1):
        kinds = []
        for (seq, ext, most), least in zip(sides, (a, length - a), strict=True):
            kind = np.empty(n, np.int64)
            kind[seq] = np.cumsum((ext < least) | np.append(True, core[1:] != core[:-1]) if least else np.append(True, core[1:] != core[:-1]))
            kinds.append(kind)
        who = np.flatnonzero(alive & (sides[0][2] >= a) & (sides[1][2] >= length - a))
        if not len(who):
            continue
        key = kinds[0][who] * (n + 1) + kinds[1][who]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(who), bool)
        later[first] = False
        found.append((order[who[later]], np.full(later.sum(), a)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    who, a = map(np.concatenate, zip(*found, strict=True))
    return who, pos[who] - a, pos[who] - a + length


def _sort_blocks(length: int, size: int):
    def settle(batch: pa.Table) -> pa.RecordBatch:
        core, doc, pos = (batch.column(i).to_numpy() for i in range(3))
        around = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, 2 * length - size)
        who, lo, hi = repeated_spans(doc, pos.astype(np.int64), core, around, length, size)
        doc = doc[who]
        order = np.lexsort((lo, doc))  # runs of neighbouring windows become one span
        doc, lo, hi = doc[order], lo[order], hi[order]
        if len(doc):
            top = np.maximum.accumulate(hi + (doc != np.append(doc[:1], doc[:-1])).cumsum() * (1 << 40))
            fresh = np.append(True, lo[1:] + (doc[1:] != doc[:-1]).cumsum() * (1 << 40) > top[:-1])
            last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)
            hi = (top[last] & ((1 << 40) - 1)).astype(np.int64)
            doc, lo = doc[fresh], lo[fresh]
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by core
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                whole = pa.Table.from_batches(held)
                cores = whole.column(0).to_numpy()
                last = int(np.searchsorted(cores, cores[-1], "left"))
                if last:
                    yield settle(whole.slice(0, last))
                    held = whole.slice(last).to_batches()
                    rows = len(cores) - last
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _window_rows(length: int, size: int):
    """(key1, key2, doc, start) of every window of the anchors of a hot core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            around = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            doc, pos = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            for a in range(length - size + 1):
                part = around[:, length - size - a : 2 * length - size - a]
                ok = ~(part == PAST).any(1)
                one, two = np.zeros((2, ok.sum()), U64)
                for j in range(length):
                    one = one * _BASE + part[ok, j].astype(U64) + U64(1)
                    two = mix64(two + part[ok, j].astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix64(one).view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[ok]), pa.array((pos[ok] - a).astype(np.int32))], ["k1", "k2", "doc", "start"]
                )

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans out of each text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            merged: list[list[int]] = []
            for s in sorted(spans or [], key=lambda s: s["lo"]):
                if merged and s["lo"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["hi"])
                else:
                    merged.append([s["lo"], s["hi"]])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(text[at:lo])
                at = hi
            rest = b"".join([*kept, text[at:]])
            for col, v in zip(out, (doc, len(text), len(text) - len(rest), merged, rest, hashlib.sha256(rest).hexdigest()), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


def _at(rows: DataFrame, anchors_: DataFrame) -> DataFrame:
    """(doc, body, at): each text with its anchors among ``anchors_(core, doc, pos)``."""
    return rows.join(anchors_.groupBy("doc").agg(F.collect_list(F.struct("pos", "core")).alias("at")), "doc").select("doc", "body", "at")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows(doc, id, body)`` with a number for ``doc`` that tells texts of one id apart and keeps their order; only where an id has several texts."""
    several = rows.groupBy("doc").agg(F.min(F.xxhash64("body")).alias("lo"), F.max(F.xxhash64("body")).alias("hi")).where("lo <> hi")
    if several.isEmpty():
        return rows
    marked = rows.withColumn("mark", F.sha2("body", 256))
    order = cut(marked.select("doc", "mark").distinct().orderBy("doc", "mark").withColumn("number", F.monotonically_increasing_id()))
    return cut(marked.join(order, ["doc", "mark"]).select(F.col("number").alias("doc"), "id", "body"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_sha256) per document."""
    own = F.col(id_col).cast("long")
    rows = _numbered(docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc"), own.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body")))
    named, rows = rows, rows.select("doc", "body")
    found = rows.mapInArrow(_anchor_rows(length, core), "core long, pos int, doc long")  # what changes from row to row side by side: it packs better
    repeated = cut(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    digests = _at(rows, found.join(repeated, "core")).mapInArrow(_digests(length, core), "h1 long, h2 long, core long, doc long, pos int, lo int, hi int, shut boolean")
    place = F.struct("doc", "pos")
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    known = cut(digests.select("core", "doc", "pos", "lo", "hi", (F.col("shut") | (place != first)).alias("gone")))
    spans = known.where("gone").select("doc", "lo", "hi")
    firsts = known.where("NOT gone").select("core", "doc", "pos")
    open_ = cut(firsts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    around = lambda cores: _at(rows, firsts.join(cores.select("core"), "core")).mapInArrow(_contexts(length, core), "core long, doc long, pos int, around binary")
    cold = around(open_.where(F.col("n") <= hot)).repartition("core").sortWithinPartitions("core")
    spans = spans.union(cold.mapInArrow(_sort_blocks(length, core), "doc long, lo int, hi int"))
    heavy = open_.where(F.col("n") > hot)
    if not heavy.isEmpty():
        windows = around(heavy).select("doc", "pos", "around").mapInArrow(_window_rows(length, core), "k1 long, k2 long, doc long, start int")
        earliest = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start")).alias("first"))
        later = windows.join(earliest, ["k1", "k2"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
        spans = spans.union(later.select("doc", F.col("start").alias("lo"), (F.col("start") + length).alias("hi")))
    cuts = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return named.join(cuts, "doc", "left").select("id", "body", "spans").mapInArrow(
        _apply, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE = """
WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
windows AS (SELECT doc_id, unnest(range(0, n - 99)) AS i, x FROM bytes WHERE n >= 100),
strings AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM windows),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM strings),
later AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM placed WHERE nth > 1),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
spans AS MATERIALIZED (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY ALL),
edges AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS last, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans
  FROM edges JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""
