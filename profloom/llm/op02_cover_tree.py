"""Embedding near-dedup by dual traversal of cover trees: exact cosine threshold pairs.

On unit vectors, cosine >= c is distance <= sqrt(2 - 2c). The top levels of one cover tree
are nets of a bounded sample, each point as far from those before it as can be; the finest of
at most ``PIVOTS`` centres, as many as the blocks call for, splits all vectors into cells.
Each block of a cell grows its own subtree, once: nested levels whose radii halve, every node with
the covering radius that it really has. Pairs of cells (before any vector moves), then pairs
of nodes, are dropped when their centres lie further apart than both covering radii and the
threshold together, and linked whole when even their furthest members lie within it. Centres
are first compared in single precision along the sample's principal axes, of which part of a
distance is a lower bound; what is left at the leaves is decided by the cosine in double precision.

Scale: equal vectors collapse to one weighted representative first, by a digest of 128 bits, so that
only the representatives' vectors are moved. A cell that holds more
rows than a block, as around a frequent vector, is several blocks. Blocks are stored once, in bundles of
blocks of neighbouring cells, and dealt into shares; a task holds two shares against one another, which come to it a pair
of bundles at a time, so disk grows with the vectors and memory per task is two shares. In
high dimension without clusters bounds prune little and time grows with the square of the
number of distinct vectors, as any exact method's does. Of links, a task hands on counts
and one spanning edge per linked vector, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different length do not link; rows without an id are left out; a
repeated row is one vector, different vectors under one id are vectors of their own. Lengths are taken after division by the largest component, so
that very large and very small ones neither overflow nor vanish. A cosine of exactly the
threshold links. Extra columns are ignored; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.llm.common import components, cut, discard, mix64, partitions, table

COSINE = 0.95
#: Bounds: vectors of the sample that places the centres, centres, rows of a block, rows of a leaf.
SAMPLE, PIVOTS, BLOCK, LEAF = 4096, 256, 4096, 64
#: Numbers of a block (rows go down to 256 for that) and of a bundle of blocks, bundles of a share, classes that are broadcast.
NUMBERS, BUNDLE, SHARE, BROADCAST = 1 << 20, 1 << 21, 4, 100_000
#: Kept from every bound, for rounding: of distances, and of squares in single precision.
SLACK, ROUGH = 1e-7, 2e-5
#: Distances that are compared at once, and pairs that are decided at once.
CHUNK, GATHER = 1 << 19, 1 << 14
NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("first", "<i4"), ("kids", "<i4"), ("radius", "<f8")])
#: What a bundle holds of each of its blocks: its name, cell, largest distance to the cell's centre, counts of rows and nodes.
HEAD = np.dtype([("block", "<i8"), ("cell", "<i4"), ("far", "<f8"), ("rows", "<i4"), ("nodes", "<i4")])


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    x = x.astype(np.float64, copy=False)
    x = x / np.where((top := np.abs(x).max(axis=1, initial=0.0)) > 0, top, 1.0)[:, None]
    return x / np.where((size := np.linalg.norm(x, axis=1)) > 0, size, 1.0)[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(x: np.ndarray, members: np.ndarray, half: float) -> list[np.ndarray]:
    """``members`` in groups around the first of each, ``half`` at most from it and further from all firsts before."""
    groups, left = [], members
    while len(left):
        tried = min(256, len(left))
        near = (distances(x[left[:tried]], x[left]) <= half).copy()
        free = np.ones(len(left), bool)
        for k in range(tried):
            if free[k]:
                mine = near[k] & free
                mine[k] = False
                free &= ~mine
                free[k] = False
                groups.append(np.concatenate((left[k : k + 1], left[mine])))
        left = left[free]
    return groups


def grow(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes) of the tree over unit rows ``x``.

    In that order a node's members are the rows from ``lo`` to ``hi`` and its centre is the first;
    its children are the ``kids`` nodes from ``first`` on. Nodes of a few rows or of no more than
    the radius ``least`` are not split.
    """
    members, bounds, nodes = [np.arange(len(x))], [2.0], []
    order = np.arange(len(x))
    starts = [0]
    k = 0
    while k < len(members):
        own, lo = members[k], starts[k]
        reach = float(distances(x[own], x[own[:1]]).max(initial=0.0)) if len(own) > 1 else 0.0
        groups = []
        if len(own) > LEAF and reach > least:
            half = min(bounds[k], reach) / 2
            groups = net(x, own, half)
            at = lo + np.cumsum([0, *map(len, groups)])
            starts += at[:-1].tolist()
            bounds += [half] * len(groups)
        else:
            order[lo : lo + len(own)] = own
        nodes.append((lo, lo + len(own), len(members), len(groups), reach))
        members += groups
        members[k] = None
        k += 1
    return order, np.array(nodes, NODE)


@dataclass
class Block:
    """Vectors in the order of their tree; ``z`` are parts of them along some axes, ``square`` those parts' squared lengths."""

    ids: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    nodes: np.ndarray
    z: np.ndarray
    square: np.ndarray


def block_of(ids: np.ndarray, weights: np.ndarray, x: np.ndarray, nodes: np.ndarray, axes: np.ndarray | None) -> Block:
    z = (units(x) if axes is None else units(x) @ axes).astype(np.float32)
    return Block(ids, weights, x, nodes, z, np.einsum("ij,ij->i", z, z))


def _near(a: Block, p: np.ndarray, b: Block, q: np.ndarray, far: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine of the centres) of all pairs of nodes p[i], q[j] that may hold links, and of some that may not."""
    i0, j0 = a.nodes["lo"][p], b.nodes["lo"][q]
    rp, rq = a.nodes["radius"][p], b.nodes["radius"][q]
    n = len(j0)
    left = np.column_stack((-2 * a.z[i0], np.ones(len(i0), np.float32), a.square[i0]))
    right = np.ascontiguousarray(np.column_stack((b.z[j0], b.square[j0], np.ones(n, np.float32))).T)
    step = max(1, CHUNK // n)
    room, flags = np.empty(min(step, len(i0)) * n, np.float32), np.zeros(-(-min(step, len(i0)) * n // 8) * 8, bool)
    for lo in range(0, len(i0), step):
        rows = min(step, len(i0) - lo)
        square = np.matmul(left[lo : lo + rows], right, out=room[: rows * n].reshape(rows, n))
        bound = far + rp[lo : lo + rows, None] + rq[None, :] if rq.any() else far + rp[lo : lo + rows, None] if rp.any() else np.array(far)
        flags[rows * n :] = False
        np.less_equal(square, (bound * bound + ROUGH).astype(np.float32), out=flags[: rows * n].reshape(rows, n))
        eights = np.flatnonzero(flags.view(np.uint64))  # most have none
        if not len(eights):
            continue
        at = (eights[:, None] * 8 + np.arange(8)).ravel()
        at = at[flags[at]]
        i, j = np.divmod(at, n)
        if 8 * len(at) > rows * n:
            yield i + lo, j, (units(a.x[i0[lo : lo + rows]]) @ units(b.x[j0]).T).ravel()[at]
            continue
        for k in range(0, len(at), GATHER):
            u, v = i[k : k + GATHER] + lo, j[k : k + GATHER]
            yield u, v, np.einsum("ij,ij->i", units(a.x[i0[u]]), units(b.x[j0[v]]))


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Rows u[k] and v[k] get one label, the smallest row's that they are linked with; labels are so before and after."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(new := label[label], label):
            label[:] = new


class Links:
    """Weighted link counts of the rows of some blocks, and labels that linked rows share."""

    def __init__(self, cosine: float) -> None:
        self.cosine, self.far = cosine, float(np.sqrt(2 - 2 * cosine))
        self.starts: dict[int, int] = {}
        self.ids = self.n = self.label = np.zeros(0, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def start(self, name: int, block: Block) -> int:
        """The place of the block's first row."""
        if name not in self.starts:
            self.starts[name] = len(self.ids)
            self.label = np.concatenate((self.label, len(self.ids) + np.arange(len(block.ids))))
            self.ids = np.concatenate((self.ids, block.ids))
            self.n = np.concatenate((self.n, np.zeros(len(block.ids), np.int64)))
        return self.starts[name]

    def edge(self, u: np.ndarray, v: np.ndarray) -> None:
        self.edges.append((u, v))
        self.waiting += len(u)
        if self.waiting > 1 << 18:
            self.settle()

    def settle(self) -> None:
        if self.edges:
            _merge(self.label, *map(np.concatenate, zip(*self.edges, strict=True)))
        self.edges, self.waiting = [], 0

    def table(self) -> pa.RecordBatch:
        self.settle()
        keep = np.flatnonzero(self.n > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[keep]), pa.array(self.n[keep]), pa.array(self.ids[self.label[keep]])], ["id", "n", "to"])

    def leaf(self, a: Block, i: slice, at: int, b: Block, j: slice, bt: int, inner: bool) -> None:
        """Rows i of a with rows j of b; inner: they are the same rows."""
        y = units(b.x[j])
        step = max(1, CHUNK // len(y))
        for lo in range(i.start, i.stop, step):
            rows = slice(lo, min(i.stop, lo + step))
            hit = units(a.x[rows]) @ y.T >= self.cosine
            if inner:
                hit[np.arange(rows.stop - lo), np.arange(lo, rows.stop) - j.start] = False
            if not hit.any():
                continue
            some = hit.astype(np.float64)
            self.n[at + lo : at + rows.stop] += (some @ b.weights[j]).astype(np.int64)
            if not inner:
                self.n[bt + j.start : bt + j.stop] += (a.weights[rows] @ some).astype(np.int64)
            top = np.arange(hit.shape[1])
            own = np.arange(hit.shape[0]) + hit.shape[1]  # labels inside this pair, until they stand
            while True:
                new = np.minimum(own, np.where(hit, top[None, :], own[:, None]).min(1))
                newer = np.minimum(top, np.where(hit, new[:, None], top[None, :]).min(0))
                if (new == own).all() and (newer == top).all():
                    break
                own, top = new, newer
            linked = np.flatnonzero(own < hit.shape[1])
            self.edge(np.concatenate((at + lo + linked, bt + j.start + np.arange(len(top)))), np.concatenate((bt + j.start + own[linked], bt + j.start + top)))

    def whole(self, a: Block, i: slice, at: int, b: Block, j: slice, bt: int, inner: bool) -> None:
        """All of rows i of a link with all of rows j of b."""
        u, v = np.arange(at + i.start, at + i.stop), np.arange(bt + j.start, bt + j.stop)
        self.n[u] += int(b.weights[j].sum()) - (a.weights[i] if inner else 0)
        if not inner:
            self.n[v] += int(a.weights[i].sum())
            self.edge(v, np.full(len(v), u[0]))
        self.edge(u, np.full(len(u), v[0]))

    def add(self, a: Block, a_name: int, b: Block, b_name: int) -> None:
        """Dual traversal of two blocks' trees, or of one with itself; all children of a pair of nodes at once."""
        same = a_name == b_name
        at, bt = self.start(a_name, a), self.start(b_name, b)
        stack = [(0, 0)]
        while stack:
            p, q = stack.pop()
            (lo, hi, first, kids, _), (low, high, least, less, _) = a.nodes[p].item(), b.nodes[q].item()
            if not kids and not less:
                self.leaf(a, slice(lo, hi), at, b, slice(low, high), bt, same and p == q)
                continue
            ps = np.arange(first, first + kids) if kids else np.array([p])
            qs = np.arange(least, least + less) if less else np.array([q])
            one_p, one_q = (side.nodes["hi"][x] - side.nodes["lo"][x] == 1 for side, x in ((a, ps), (b, qs)))
            for us, vs, plain in ((ps[one_p], qs[one_q], True), (ps[~one_p], qs[one_q], False), (ps[one_p], qs[~one_q], False), (ps[~one_p], qs[~one_q], False)):
                if not len(us) or not len(vs):
                    continue
                for i, j, c in _near(a, us, b, vs, self.far):
                    u, v = us[i], vs[j]
                    if plain:
                        hit = c >= self.cosine
                        if same and p == q:
                            hit &= u < v
                        u, v = a.nodes["lo"][u[hit]], b.nodes["lo"][v[hit]]
                        if len(u):
                            np.add.at(self.n, at + u, b.weights[v])
                            np.add.at(self.n, bt + v, a.weights[u])
                            self.edge(at + u, bt + v)
                        continue
                    d, reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * c)), a.nodes["radius"][u] + b.nodes["radius"][v]
                    keep = d <= self.far + reach + SLACK
                    if same and p == q:
                        keep &= u <= v
                    for x, y, near in zip(u[keep].tolist(), v[keep].tolist(), (d + reach <= self.far - SLACK)[keep].tolist(), strict=True):
                        if near:
                            (lo, hi, *_), (low, high, *_) = a.nodes[x].item(), b.nodes[y].item()
                            self.whole(a, slice(lo, hi), at, b, slice(low, high), bt, same and x == y)
                        else:
                            stack.append((x, y))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(units(x), pivots)
    return d.argmin(1), d.min(1)


def _count(pivots: np.ndarray, dims: int):
    """(cell, rows) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(_cells(_matrix(batch.column("v"), dims), pivots)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], ["cell", "rows"])

    return run


def _deal(pivots: np.ndarray, dims: int, parts: np.ndarray, bundles: np.ndarray):
    """(id, n, cell, distance to its centre, block, bundle, vector's bytes); a cell's blocks are numbered together, by cell."""
    first = np.cumsum(parts) - parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            cell, far = _cells(x, pivots)
            block = first[cell] + (mix64(batch.column("id").to_numpy().astype(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)
            ends = pa.py_buffer((np.arange(len(x) + 1) * x.itemsize * dims).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(np.ascontiguousarray(x))])
            made = [pa.array(cell.astype(np.int32)), pa.array(far), pa.array(block), pa.array(bundles[block].astype(np.int32)), data]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *made], ["id", "n", "cell", "far", "block", "bundle", "v"])

    return run


def _pack(kind: str, dims: int, least: float):
    """One row per bundle: heads of its blocks; their ids, weights and vectors side by side in the order of their trees; the trees."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(-1, dims)
        block, cell, far = (rows.column(c).to_numpy() for c in ("block", "cell", "far"))
        heads, order, trees = [], [], []
        for name in np.unique(block):
            at = np.flatnonzero(block == name)
            mine, nodes = grow(units(x[at]), least)
            heads.append((name, cell[at[0]], far[at].max(), len(at), len(nodes)))
            order.append(at[mine])
            trees.append(nodes)
        order = np.concatenate(order)
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table(
            {
                "bundle": pa.array([key[0].as_py()], pa.int32()), "heads": one(np.array(heads, HEAD)), "ids": one(rows.column("id").to_numpy()[order]),
                "weights": one(rows.column("n").to_numpy()[order]), "data": one(x[order]), "nodes": one(np.concatenate(trees)),
            }
        )

    return run


def _blocks(row: dict[str, pa.Scalar], side: str, kind: str, axes: np.ndarray | None, made: dict) -> Iterator[tuple[np.void, Block]]:
    """(head, block) of a bundle's blocks; what is made of a block is kept for the task, but for its vectors."""
    get = lambda name, kind: np.frombuffer(row[f"{name}_{side}"].as_buffer(), kind)
    heads, ids, weights, nodes = get("heads", HEAD), get("ids", np.int64), get("weights", np.int64), get("nodes", NODE)
    x = get("data", kind).reshape(len(ids), -1)
    at = of = 0
    for head in heads:
        rows, tree = slice(at, at + head["rows"]), slice(of, of + head["nodes"])
        at, of = rows.stop, tree.stop
        if (name := int(head["block"])) not in made:
            block = block_of(ids[rows], weights[rows], x[rows], nodes[tree], axes)
            made[name] = block.z, block.square
        yield head, Block(ids[rows], weights[rows], x[rows], nodes[tree], *made[name])


def _compare(cosine: float, kind: str, pivots: np.ndarray, axes: np.ndarray | None):
    """Links among the pairs of bundles of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, made = Links(cosine), {}
        apart = distances(pivots, pivots)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                others = list(_blocks(row, "b", kind, axes, made))
                for p, a in _blocks(row, "a", kind, axes, made):
                    for q, b in others:
                        if (row["bundle_a"] != row["bundle_b"] or p["block"] <= q["block"]) and apart[p["cell"], q["cell"]] <= links.far + p["far"] + q["far"] + SLACK:
                            links.add(a, int(p["block"]), b, int(q["block"]))
        yield links.table()

    return run


def centres(sample: np.ndarray, most: int, least: float) -> np.ndarray:
    """Farthest-point order: the first k points are a net of the radius at which the k-th was added, ``least`` or more."""
    chosen, away = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)) and away.max() > least:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def principal(sample: np.ndarray, far: float) -> np.ndarray | None:
    """Axes of most variance, as many as make comparing cheapest; None where all components are."""
    dims = sample.shape[1]
    rng = np.random.default_rng(0)
    flat = sample - sample.mean(axis=0)
    axes = rng.normal(size=(dims, min(dims, 256)))
    for _ in range(3):
        axes = np.linalg.qr(flat.T @ (flat @ axes))[0]
    axes = axes @ np.linalg.eigh((flat @ axes).T @ (flat @ axes))[1][:, ::-1]
    passed = np.zeros(axes.shape[1])  # shares of pairs that the first k axes leave open
    for i, j in rng.integers(0, len(sample), (20, 2, 5_000)):
        passed += ((np.cumsum(((sample[i] - sample[j]) @ axes) ** 2, axis=1) <= far * far) & (i != j)[:, None]).mean(axis=0) / 20
    costs = {k: 33 + k + 3000 * dims * passed[k - 1] for k in range(8, axes.shape[1] + 1, 8)} | {dims: 33 + dims}  # as measured with 64 components
    best = min(costs, key=costs.get)
    return None if best == dims else np.ascontiguousarray(axes[:, :best])


def _sound(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))


def _links_of_few(cosine: float):
    """All links among the vectors of one length, where they make no more than a block."""

    def run(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("v").combine_chunks(), rows.column("dims")[0].as_py())
        order, nodes = grow(units(x), np.sqrt(2 - 2 * cosine) / 4)
        block = block_of(rows.column("id").to_numpy()[order], rows.column("n").to_numpy()[order], x[order], nodes, None)
        links = Links(cosine)
        links.add(block, 0, block, 0)
        return pa.Table.from_batches([links.table()])

    return run


def _links_of_many(heads: DataFrame, dims: int, total: int, cosine: float) -> DataFrame:
    """(id, n, to): counts of links and spanning edges among ``heads(id, v, n)``, all of one length, by cells and blocks."""
    spark = heads.sparkSession
    limit = float(np.sqrt(2 - 2 * cosine))
    size = min(BLOCK, max(256, NUMBERS // dims))
    kind = "<f4" if heads.schema["v"].dataType.elementType == T.FloatType() else "<f8"
    share = min(1.0, 0.9 * SAMPLE / max(1, total))
    drawn = heads.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_000)) < share * 1_000_000).select("v").limit(SAMPLE).toArrow()
    sample = units(_matrix(drawn.column("v").combine_chunks(), dims) if drawn.num_rows else np.ones((1, dims)))
    pivots, axes = centres(sample, min(PIVOTS, max(16, 2 * -(-total // size))), limit / 2), principal(sample, limit)

    rows = np.zeros(len(pivots), np.int64)
    for r in heads.select("v").mapInArrow(_count(pivots, dims), "cell int, rows long").groupBy("cell").agg(F.sum("rows").alias("rows")).collect():  # at most PIVOTS rows
        rows[r.cell] = r.rows
    # cells in the order of the coarser centres that they are nearest to, so that a bundle's blocks are neighbours
    place = np.argsort(distances(pivots, pivots[:16]).argmin(1), kind="stable")
    pivots, rows = pivots[place], rows[place]
    parts = np.maximum(1, -(-rows // size))
    least = int(np.ceil(np.sqrt(8 * partitions(spark))))
    bundles = np.cumsum(np.repeat(rows / parts, parts)) // max(size, min(BUNDLE // dims, total // (2 * least)))
    dealt = heads.select("id", "v", "n").mapInArrow(_deal(pivots, dims, parts, bundles), "id long, n long, cell int, far double, block long, bundle int, v binary")
    packed = dealt.repartition(partitions(spark), "bundle").groupBy("bundle").applyInArrow(_pack(kind, dims, limit / 4), "bundle int, heads binary, ids binary, weights binary, data binary, nodes binary")
    stored = cut(packed)

    cells = {r.bundle: np.frombuffer(r.heads, HEAD) for r in stored.select("bundle", "heads").collect()}  # under 40 bytes a block
    apart = distances(pivots, pivots)
    meet = lambda a, b: (apart[np.ix_(a["cell"], b["cell"])] <= limit + a["far"][:, None] + b["far"] + SLACK).any()
    touching = [(a, [b for b in cells if meet(cells[a], cells[b])]) for a in cells]
    shares = min(len(cells), max(least, -(-len(cells) // SHARE)))
    stored_with = stored.join(F.broadcast(spark.createDataFrame(touching, "bundle int, touches array<int>")), "bundle").repartition(shares)
    a, b = (stored_with.select(*[F.col(c).alias(f"{c}_{s}") for c in stored_with.columns]) for s in "ab")
    # asked of both sides, so that they have the same columns and are dealt once
    both = F.expr("bundle_a <= bundle_b AND array_contains(touches_a, bundle_b) AND array_contains(touches_b, bundle_a)")
    pairs = a.join(b.hint("shuffle_replicate_nl"), both).drop("touches_a", "touches_b")
    found = cut(pairs.mapInArrow(_compare(cosine, kind, pivots, axes), "id long, n long, to long"))
    discard(stored)
    return found


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id) of every vector.

    Lengths that make no more than a block are compared a length a group; each of the others by cells.
    Rows are told apart by the digest of their vector; vectors themselves go only as far as their blocks.
    """
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    key = ["dims", "sound", "h1", "h2"]
    sound = _sound(F.col("v"))
    # unsound vectors by their text, as hashes pass over nulls; -0.0 has the hash of 0.0
    hashes = [F.when(F.col("sound"), F.xxhash64(F.lit(k), "v")).otherwise(F.xxhash64(F.lit(k), F.col("v").cast("string"))).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("id", "v", F.size("v").alias("dims"), sound.alias("sound")).select("id", "v", "dims", "sound", *hashes)
    plain = cut(rows.groupBy("id", *key).agg(F.count("*").alias("times")))
    classes = plain.where("sound").groupBy(*key).agg(F.min("id").alias("head"), F.count("*").alias("n"))
    # numbered in the order of their smallest ids, so that a component's smallest number has its smallest id
    classes = cut(classes.orderBy("head").select(F.monotonically_increasing_id().alias("number"), "head", "n", *key))
    lengths = {r.dims: r["count"] for r in classes.groupBy("dims").count().collect()}  # a row for each length
    heads = classes.withColumnRenamed("head", "id")
    heads = F.broadcast(heads) if sum(lengths.values()) <= BROADCAST else heads.hint("shuffle_hash")
    heads = rows.where("sound").join(heads, ["id", *key]).select(F.col("number").alias("id"), "v", "n", "dims")
    if plain.where("sound AND times > 1").limit(1).count():
        heads = heads.dropDuplicates(["id"])
    heads = cut(heads)
    many = [d for d, n in lengths.items() if n > BLOCK]
    found = heads.where(~F.col("dims").isin(many)).groupBy("dims").applyInArrow(_links_of_few(cosine), "id long, n long, to long")
    for dims in many:
        found = found.unionByName(_links_of_many(heads.where(F.col("dims") == dims), dims, lengths[dims], cosine))
    found = cut(found)
    discard(heads)
    counts = found.groupBy("id").agg(F.sum("n").alias("n_far"))
    groups = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    groups = groups.join(classes.select(F.col("number").alias("component_id"), F.col("head").alias("least")), "component_id").select("id", "least")
    named = classes.withColumnRenamed("number", "id").join(counts, "id", "left").join(groups, "id", "left")
    named = named.select(*key, (F.coalesce("n_far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "head").alias("component_id"))
    alone = plain.where(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return plain.where("sound").join(named, key).select("id", "n_links", "component_id").unionByName(alone)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE all_rows AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
sound AS (
  SELECT vec_id, e, list_max(list_transform(e, lambda c: abs(c))) AS top FROM all_rows
  WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), scaled AS (SELECT vec_id, list_transform(e, lambda c: c / top) AS e FROM sound
), v AS MATERIALIZED (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM scaled
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(id, stop) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.stop),
least AS (SELECT id, min(stop) AS m FROM reach GROUP BY id), counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, m IS NULL OR m >= vec_id AS kept
FROM all_rows LEFT JOIN least ON least.id = vec_id LEFT JOIN counted ON counted.id = vec_id
"""
