"""Shared helpers of the training-data operators.

Text helpers work on the UTF-8 buffer of an Arrow column, many documents at a
time, so that Python pays per batch and not per word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.tables import table  # noqa: F401  (re-exported for the operators)

U64 = np.uint64
#: Bytes of text that one vectorised pass takes, unless a single document is longer.
SLICE_BYTES = 1 << 20


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local one only where none is set and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # nothing reads this execution's shuffle files again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(scratch(spark)) or f"file:{folder.split(':', 1)[-1]}".startswith(f"file:{scratch(spark).split(':', 1)[-1]}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


_LUT = np.zeros(256, bool)
_LUT[[0x20, *range(0x09, 0x0E)]] = True
SPACES = _LUT
_LUT = np.ones(256, bool)
_LUT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Everything but ASCII letters and digits and bytes beyond ASCII.
PUNCTUATION = _LUT

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.empty(size, U64)
        have[0] = 1
        k = 1
        while k < size:  # doubling
            step = min(k, size - k)
            have[k : k + step] = have[:step] * U64(pow(base, k, 1 << 64))
            k += step
        _POWERS[base] = have
    return have[:n]


def split_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words end at ``breaks`` bytes and at row ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one running polynomial sum."""
    n = len(data)
    run = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, n), out=run[1:])
    return mix64((run[ends] - run[starts]) * _powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(U64))


class Forest:
    """Union-find over arbitrary integers, the smallest one as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (to := up.get(root, root)) != root:
            root = to
        while (to := up.get(x, x)) != root and x != root:
            up[x] = root
            x = to
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.find(x) for x in nodes]


#: Nodes that one task's forest holds before it is written out and begun anew.
FOREST_NODES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def out() -> pa.RecordBatch:
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > FOREST_NODES:
            yield out()
            forest = Forest()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``edges(a, b)``; the component is its smallest node.

    Each task first contracts its own edges to stars, then large-star and small-star
    rounds (Kiveris et al. 2014) run until the edge set stands still. No step holds the
    graph in one place; each round ends in a written table.
    """
    edges = cut(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long"))
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component_id")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    ).groupBy("id").agg(F.min("component_id").alias("component_id"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
