"""Traces as sequences of frames: distance, clusters, folded stacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators.graph import keep

THRESHOLD = 2.0


def frame_cost(a: str, b: str) -> float:
    """1 - 2 |common words| / (|words a| + |words b|)."""
    x, y = set(a.split("_")), set(b.split("_"))
    return 1 - 2 * len(x & y) / (len(x) + len(y))


def distance(a: list[str], b: list[str], bound: float | None = None) -> float:
    """Edit distance of frames: insert or delete 1, replace by the words that differ; above ``bound``: infinity."""
    if bound is not None and abs(len(a) - len(b)) > bound:
        return float("inf")
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        left, diagonal = float(i), row[0]
        row[0] = left
        for j, y in enumerate(b, 1):
            left = min(row[j] + 1, left + 1, diagonal + (frame_cost(x, y) if x != y else 0.0))
            diagonal, row[j] = row[j], left
        if bound is not None and min(row) > bound:
            return float("inf")
    return row[-1]


def distances(left: list, right: list, bound: float | None = None):
    """``distance`` of many pairs at once: costs once for each pair of frames, then one table for all pairs of equal lengths."""
    import numpy as np

    out = np.full(len(left), np.inf)
    number: dict[str, int] = {}
    ids = [[np.array([number.setdefault(f, len(number)) for f in x], np.int64) for x in side] for side in (left, right)]
    names = list(number)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(*ids, strict=True)):
        if bound is None or abs(len(a) - len(b)) <= bound:
            shapes.setdefault((len(a), len(b)), []).append(k)
    for (n, m), rows in shapes.items():
        row = np.tile(np.arange(m + 1.0), (len(rows), 1))
        if n and m:
            a, b = (np.stack([side[k] for k in rows]) for side in ids)
            codes, at = np.unique(a[:, :, None] * len(names) + b[:, None, :], return_inverse=True)
            costs = np.array([0.0 if c // len(names) == c % len(names) else frame_cost(names[c // len(names)], names[c % len(names)]) for c in codes.tolist()])[at].reshape(len(rows), n, m)
        for i in range(1, n + 1):
            new = np.empty_like(row)
            new[:, 0] = i
            for j in range(1, m + 1):
                new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + costs[:, i - 1, j - 1])
            row = new
        out[rows] = row[:, m]
    return out if bound is None else np.where(out <= bound, out, np.inf)


def trace_distance(pairs: DataFrame, a: str, b: str, bound: float | None = None) -> DataFrame:
    """Pairs of traces with their distance (null above the bound); each distinct pair is computed once."""
    distinct = pairs.select(a, b).distinct()

    def run(batches):
        for pdf in batches:
            pdf["distance"] = [None if d == float("inf") else d for d in distances(pdf[a].tolist(), pdf[b].tolist(), bound).tolist()]
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema)
    return pairs.join(distinct.mapInPandas(run, f"{kinds}, distance double"), [a, b])


def first_frames(trace: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(trace, 1, n), ",")


def close_traces(traces: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(stratum, a, b, distance): pairs of the distinct traces (stratum, t, frames) of a stratum within the threshold, a < b by text.

    An edit of cost c changes at most c times as many words as both traces have in their widest
    frames. So the words of a trace that its partner lacks are bounded, and the rarest words up
    to one more than that bound hold a common one: pairs are joined on those, and on their
    lengths. Only traces that have no more words than the bound can be close without a common
    word; they are joined with each other by stratum and length.
    """
    words = F.transform("frames", lambda f: F.array_distinct(F.split(f, "_")))
    wide = F.coalesce(F.array_max(F.transform("words", lambda w: F.size(w))), F.lit(0))
    sized = traces.withColumn("words", words).withColumn("wide", wide)
    most = sized.groupBy("stratum").agg(F.max("wide").alias("most"))
    slack = F.floor(threshold * (F.col("wide") + F.col("most")) + 1e-9)
    sized = sized.join(most, "stratum").select("stratum", "t", "frames", F.flatten("words").alias("words"), slack.alias("slack"))
    node = ["stratum", "t", "frames", "slack"]
    counted = sized.select(*node, F.explode("words").alias("word")).groupBy(*node, "word").agg(F.count("*").alias("times"))
    tokens = counted.select(*node, "word", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    key = ["stratum", "word", "nth"]
    common = tokens.groupBy(*key).agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("stratum", "t").orderBy("df", "word", "nth"))
    rare = tokens.join(common, key).withColumn("rank", rank).where("df > 1 AND rank <= slack + 1").select(*key, "t", "frames")
    short = sized.where("size(words) <= slack").select("stratum", F.lit(None).cast("string").alias("word"), F.lit(0).alias("nth"), "t", "frames")
    # a row for each length that a partner may have, so that lengths are an equal key as well
    band = int(threshold)
    keyed = rare.unionByName(short).withColumn("word", F.coalesce("word", F.lit(""))).withColumn("length", F.size("frames"))
    left = keyed.select(*key, F.col("t").alias("a"), F.col("frames").alias("fa"), F.explode(F.sequence(F.col("length") - band, F.col("length") + band)).alias("length"))
    right = keyed.select(*key, F.col("t").alias("b"), F.col("frames").alias("fb"), "length")
    pairs = left.join(right, [*key, "length"]).where("a < b").select("stratum", "a", "b", "fa", "fb").dropDuplicates(["stratum", "a", "b"])

    def run(batches):
        for pdf in batches:
            pdf["distance"] = distances(pdf["fa"].tolist(), pdf["fb"].tolist(), threshold)
            yield pdf.loc[pdf["distance"] <= threshold, ["stratum", "a", "b", "distance"]]

    return pairs.mapInPandas(run, "stratum string, a string, b string, distance double")


def cluster_traces(df: DataFrame, trace: str, threshold: float = THRESHOLD, strategy: str = "first-fit", stratum: Column | None = None) -> DataFrame:
    """Rows with ``cluster``: the pivot trace (as text) of the cluster that theirs belongs to.

    Distinct traces of a stratum (by default those with the same first two frames), in the order
    of their text, join the first (or nearest, of those the last) pivot within the threshold or
    become one; rows without a trace are left out. Pivots are settled in rounds of joins over the
    close pairs: a trace without a smaller undecided neighbour is one, and its neighbours are not.
    """
    of = first_frames(F.col(trace)) if stratum is None else stratum
    rows = df.withColumn("__t", F.array_join(F.col(trace), ",")).withColumn("__s", F.to_json(F.struct(of.alias("s"))))
    distinct = rows.where("__t IS NOT NULL").select(F.col("__s").alias("stratum"), F.col("__t").alias("t"), F.col(trace).alias("frames")).dropDuplicates(["stratum", "t"])
    links = keep(close_traces(distinct, threshold))
    side = lambda e, c: e.select("stratum", F.col(c).alias("t")).distinct()
    open_, left, pivots = keep(side(links, "a").union(side(links, "b")).distinct()), links, []
    while not open_.isEmpty():
        found = keep(open_.join(side(left, "b"), ["stratum", "t"], "left_anti"))
        pivots.append(found)
        near = left.join(found.withColumnRenamed("t", "a"), ["stratum", "a"], "left_semi")
        open_ = keep(open_.join(found.union(side(near, "b")), ["stratum", "t"], "left_anti"))
        for end in ("a", "b"):
            left = left.join(open_.withColumnRenamed("t", end), ["stratum", end], "left_semi")
        left = keep(left)
    placed = distinct.select("stratum", "t")
    if pivots:
        joined = links.join(reduce(DataFrame.union, pivots).withColumnRenamed("t", "a"), ["stratum", "a"], "left_semi")
        pick = F.min("a") if strategy == "first-fit" else F.max_by("a", F.struct(-F.col("distance"), F.col("a")))
        placed = placed.join(joined.groupBy("stratum", F.col("b").alias("t")).agg(pick.alias("pivot")), ["stratum", "t"], "left")
    else:
        placed = placed.withColumn("pivot", F.lit(None).cast("string"))
    placed = placed.select(F.col("stratum").alias("__s"), F.col("t").alias("__t"), F.coalesce("pivot", "t").alias("cluster"))
    return rows.join(placed, ["__s", "__t"]).drop("__s", "__t")


def fold_stacks(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, stack, amount): cost per full stack, frames from the root joined by ``;``."""
    stack = F.array_join(F.array_append(F.transform("trace", lambda f: f["func"]), F.col("uid")), ";")
    return df.groupBy(*keys, stack.alias("stack")).agg(F.sum("amount").alias("amount"))


def diff_folded(baseline: DataFrame, target: DataFrame, normalize: bool = True) -> DataFrame:
    """(stack, base, target): costs of both sides, the baseline scaled to the target's total."""
    b, t = fold_stacks(baseline).withColumnRenamed("amount", "base"), fold_stacks(target).withColumnRenamed("amount", "target")
    both = t.join(b, "stack", "full_outer").select("stack", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("target", F.lit(0.0)).alias("target"))
    if not normalize:
        return both
    total = both.agg(F.try_divide(F.sum("target"), F.sum("base")).alias("ratio"))  # one row
    return both.join(total).select("stack", (F.col("base") * F.coalesce("ratio", F.lit(1.0))).alias("base"), "target")


def folded_lines(df: DataFrame) -> DataFrame:
    """Flame-graph text: uid first, then the trace from the inside out, amount last; freed memory left out."""
    kept = df.where(~F.coalesce(F.col("subtype") == "free", F.lit(False)))
    frames = F.concat(F.array("uid"), F.reverse(F.transform("trace", lambda f: f["func"])))
    return kept.select(F.concat(F.array_join(frames, ";"), F.lit(" "), F.col("amount").cast("bigint").cast("string")).alias("value"))
