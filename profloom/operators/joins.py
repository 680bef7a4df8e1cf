"""Joins of profiles, models and versions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profloom.operators import scan
from profloom.operators.graph import keep
from profloom.operators.windows import best_model_per_uid


def join_baseline_target(baseline: DataFrame, target: DataFrame, *keys: str, compat: bool = False) -> DataFrame:
    """Exclusive times of both sides by (uid, location); removed functions show unless ``compat``."""
    on = [*keys, "uid", "location"]
    b = baseline.select(*on, F.col("exclusive").alias("base"))
    t = target.select(*on, F.col("exclusive").alias("target"))
    return t.join(b, on, "left" if compat else "full_outer")


def join_averages(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    on = [*keys, "uid"]
    return baseline.select(*on, F.col("average").alias("base")).join(target.select(*on, F.col("average").alias("target")), on)


_MODEL = ("model", "r_square", "x_start", "x_end", "b0", "b1", "b2")


def _side(models: DataFrame, on: list[str], prefix: str) -> DataFrame:
    return models.select(*on, *[F.col(c).alias(f"{prefix}_{c}") for c in _MODEL if c not in on])


def join_models(baseline: DataFrame, target: DataFrame, *keys: str, strategy: str = "best") -> DataFrame:
    """Models of both sides: the best ones by uid, or all of them by uid and kind."""
    if strategy == "best":
        on = [*keys, "uid"]
        baseline, target = (best_model_per_uid(m, *on) for m in (baseline, target))
    else:
        on = [*keys, "uid", "model"]
    return _side(baseline, on, "base").join(_side(target, on, "target"), on)


def join_model_quadruple(baseline: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Best and linear models of both sides, for the uids that have all four."""
    on = [*keys, "uid"]
    linear = lambda m: m.where("model = 'linear' AND r_square > 0")
    out = join_models(baseline, target, *keys)
    return out.join(_side(linear(baseline), on, "base_linear"), on).join(_side(linear(target), on, "target_linear"), on)


def _rare_grams(names: DataFrame, least: float) -> DataFrame:
    """(side, name, gram): of each name so many of its rarest grams that similar names share one.

    An edit changes q grams of q characters, so names of similarity ``least``, the longer of n
    characters, share n - q + 1 - q (1 - least) n grams, repeats counted. Pairs take pairs of
    characters where this is above 0, and single characters where the longer name is too short.
    """
    long = math.floor(1 / (2 * least - 1)) + 1 if least > 0.5 else 1 << 30
    n = F.length("name")
    out = None
    for q, fits in ((1, n < long), (2, n / least + 1e-9 >= long)):
        rows = names.where(fits & (n >= q)).select("side", "name", F.explode(F.sequence(F.lit(1), n - (q - 1))).alias("i"))
        rows = rows.withColumn("gram", F.substring(F.col("name"), F.col("i"), F.lit(q)))
        nth = F.row_number().over(Window.partitionBy("side", "name", "gram").orderBy("i"))
        shared = F.greatest(F.lit(1), F.ceil(n - (q - 1) - q * (1 - least) * n - 1e-9))
        rows = rows.select("side", "name", F.struct(F.lit(q).alias("q"), "gram", nth.alias("nth")).alias("gram"), (n - (q - 1) - shared + 1).alias("most"))
        out = rows if out is None else out.union(rows)
    known = out.groupBy("gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("side", "name", "gram.q").orderBy("n", "gram"))
    return out.join(known, "gram").withColumn("rank", rank).where("rank <= most").select("side", "name", "gram")


def match_locations(baseline: DataFrame, target: DataFrame, least: float = 0.6) -> DataFrame:
    """(base, target, common): location names that changed, matched one to one.

    Similarity is 1 - levenshtein / longer length; a pair counts when each is the other's best.
    Names on both sides match themselves. Candidates share one of their rarest grams, which every
    similar pair does (see ``_rare_grams``), so the names meet by an equi join and not by all pairs.
    """
    b = baseline.select(F.col("location").alias("base")).where("base IS NOT NULL").distinct()
    t = target.select(F.col("location").alias("target")).where("target IS NOT NULL").distinct()
    only_b = b.join(t, F.col("base") == F.col("target"), "left_anti")
    only_t = t.join(b, F.col("base") == F.col("target"), "left_anti")
    alike = 1 - F.levenshtein("base", "target") / F.greatest(F.length("base"), F.length("target"))
    both = only_b.select(F.lit(0).alias("side"), F.col("base").alias("name")).union(only_t.select(F.lit(1).alias("side"), F.col("target").alias("name")))
    rare = _rare_grams(both, least)
    rare_b, rare_t = (rare.where(F.col("side") == k).select(F.col("name").alias(c), "gram") for k, c in enumerate(("base", "target")))
    near = rare_b.join(rare_t, "gram").where(F.least(F.length("base"), F.length("target")) >= F.greatest(F.length("base"), F.length("target")) * (least - 1e-9))
    pairs = near.select("base", "target").distinct().withColumn("alike", alike).where(F.col("alike") >= least)
    rank = lambda a, c: F.row_number().over(Window.partitionBy(a).orderBy(F.desc("alike"), c))
    best = pairs.withColumn("kb", rank("base", "target")).withColumn("kt", rank("target", "base")).where("kb = 1 AND kt = 1")
    n = F.least(F.length("base"), F.length("target"))
    prefix = F.expr("substring(base, 1, aggregate(sequence(1, least(length(base), length(target))), 0, (a, i) -> if(a = i - 1 AND substring(base, i, 1) = substring(target, i, 1), i, a)))")
    return best.where(n > 0).select("base", "target", prefix.alias("common"))


def parent_baselines(targets: DataFrame, versions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(target_id, baseline_id): for each target profile, compatible profiles of its version's parents."""
    up = versions.select(F.col("checksum").alias("version"), F.explode("parents").alias("parent"))
    return _compatible(targets.join(up, "version"), profiles)


def _compatible(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    keys = ["type", "cmd", "workload", "collector"]
    t = targets.select(*keys, "parent", F.col("profile_id").alias("target_id"), F.col("postprocessors").alias("tp"))
    b = profiles.select(*keys, F.col("version").alias("parent"), F.col("profile_id").alias("baseline_id"), F.col("postprocessors").alias("bp"))
    return t.join(b, [*keys, "parent"]).where(F.size(F.array_except("bp", "tp")) == 0).select("target_id", "baseline_id")


def chain_cover(versions: DataFrame) -> DataFrame:
    """(version, chain, pos): the history cut into chains of first parents, counted from each chain's oldest version.

    A parent's chain goes on with one of the children whose first parent it is. Chains are numbered by
    pointer doubling: each round every version learns the place of the one it points to, so a
    chain of n versions takes log n joins of one row a version.
    """
    edges = versions.select(F.col("checksum").alias("version"), F.posexplode("parents").alias("nth", "parent"))
    nodes = versions.select(F.col("checksum").alias("version")).union(edges.select("parent")).distinct()
    links = edges.where("nth = 0").groupBy(F.col("parent").alias("to")).agg(F.min("version").alias("version"))
    at = nodes.join(links, "version", "left").select("version", F.coalesce("to", "version").alias("to"), F.col("to").isNotNull().cast("long").alias("pos"))
    at = keep(at)
    while True:
        far = at.select(F.col("version").alias("to"), F.col("to").alias("further"), F.col("pos").alias("more"))
        moved = keep(at.join(far, "to").select("version", F.col("further").alias("to"), (F.col("pos") + F.col("more")).alias("pos"), (F.col("more") > 0).alias("open")))
        done = moved.where("open").isEmpty()
        at = moved.drop("open")
        if done:
            return at.select("version", F.col("to").alias("chain"), "pos")


def _stairs(steps: DataFrame) -> DataFrame:
    """Steps (chain, pos, to, top) without those that an earlier one of the same chains makes superfluous."""
    before = Window.partitionBy("chain", "to").orderBy("pos", F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("had", F.max("top").over(before)).where("had IS NULL OR top > had").drop("had")


def chain_steps(versions: DataFrame, places: DataFrame) -> DataFrame:
    """(chain, pos, to, top): from ``pos`` of a chain on, versions have those of chain ``to`` up to ``top`` as ancestors.

    The closure runs over chains, not versions: steps are joined with themselves until none is new.
    """
    edges = versions.select(F.col("checksum").alias("version"), F.explode("parents").alias("parent"))
    up = places.select(F.col("version").alias("parent"), F.col("chain").alias("to"), F.col("pos").alias("top"))
    steps = keep(_stairs(edges.join(places, "version").join(up, "parent").where("chain <> to").select("chain", "pos", "to", "top")))
    state = None
    while True:
        now = steps.agg(F.count("*"), F.sum(F.xxhash64("chain", "pos", "to", "top").cast("decimal(38,0)"))).first()
        if now == state:
            return steps
        state = now
        on = steps.select(F.col("chain").alias("to"), F.col("pos").alias("from"), F.col("to").alias("end"), F.col("top").alias("last"))
        longer = steps.join(on, "to").where("from <= top AND end <> chain").select("chain", "pos", F.col("end").alias("to"), F.col("last").alias("top"))
        steps = keep(_stairs(steps.unionByName(longer)))


def ancestor_baselines(targets: DataFrame, versions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(target_id, baseline_id): for each target profile, compatible profiles of all ancestors of its version.

    A version's ancestors are the lower part of its own chain and of each chain it steps to, so
    profiles meet by an equi join on configuration and chain, and no table of ancestors is built.
    """
    places = keep(chain_cover(versions))
    steps = chain_steps(versions, places)
    keys = ["type", "cmd", "workload", "collector"]
    t = targets.select(*keys, F.col("profile_id").alias("target_id"), F.col("postprocessors").alias("tp"), "version").join(places, "version").drop("version")
    far = t.join(steps.withColumnRenamed("pos", "from"), "chain").where("from <= pos").groupBy(*keys, "target_id", "tp", "to").agg(F.max("top").alias("top"))
    reach = t.select(*keys, "target_id", "tp", F.col("chain").alias("to"), (F.col("pos") - 1).alias("top")).unionByName(far)
    b = profiles.select(*keys, F.col("profile_id").alias("baseline_id"), F.col("postprocessors").alias("bp"), "version").join(places, "version").withColumnRenamed("chain", "to")
    found = reach.join(b, [*keys, "to"]).where("pos <= top").where(F.size(F.array_except("bp", "tp")) == 0)
    return found.select("target_id", "baseline_id")


def nearest_version(wanted: DataFrame, versions: DataFrame, *keys: str, crowd: int | None = None) -> DataFrame:
    """For each (keys, date) wanted, the newest version not younger than it; equal dates by ordinal.

    Both sides are merged in date order and the last version seen is carried forward, so it
    costs one sort and not a range join. Groups of more than ``crowd`` rows are spread over tasks.
    """
    order = "ordinal" if "ordinal" in versions.columns else "checksum"
    v = versions.select(*keys, "date", F.struct(F.col(order).alias("o"), F.col("checksum").alias("c"), F.col("date").alias("d")).alias("v"), F.lit(0).alias("side"))
    w = wanted.select(*keys, "date", F.lit(None).cast(v.schema["v"].dataType).alias("v"), F.lit(1).alias("side"))
    found = scan.last_known(v.union(w), *keys, order=["date", "side", F.col("v.o")], value="v", name="last", crowd=crowd).where("side = 1")
    return found.select(*keys, "date", F.col("last.c").alias("checksum"), F.col("last.d").alias("version_date"))


def latest_stats(stats: DataFrame, versions: DataFrame, skip: str | None = None) -> DataFrame:
    """(name, version, value): the newest version's value of each stats name."""
    dated = stats.join(versions.select(F.col("checksum").alias("version"), "date"), "version")
    if skip is not None:
        dated = dated.where(F.col("version") != skip)
    newest = dated.groupBy("name").agg(F.max_by(F.struct("version", "value"), F.struct("date", "version")).alias("s"))
    return newest.select("name", "s.version", "s.value")


def self_pairs(points: DataFrame, *keys: str, x: str = "x", y: str = "y", width: float | None = None) -> DataFrame:
    """(keys, i, xi, yi, j, xj, yj): pairs of points of a group, all of them or those within ``width`` in x.

    A width makes the join an equi join on bands: each point is copied to its own band and both neighbours.
    """
    i = points.select(*keys, F.col("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    j = points.select(*keys, F.col("i").alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    if width is None:
        return i.join(j, list(keys))
    band = lambda c: F.floor(F.col(c) / width)
    i = i.withColumn("band", band("xi"))
    j = j.withColumn("band", F.explode(F.array(band("xj") - 1, band("xj"), band("xj") + 1)))
    return i.join(j, [*keys, "band"]).where(F.abs(F.col("xi") - F.col("xj")) <= width).drop("band")


def callers_callees(edges: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(func, callers, callees): sorted neighbour sets; ``renames(old, new)`` is applied first."""
    if renames is not None:
        for c in ("caller", "callee"):
            edges = edges.join(renames.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    out = edges.select(F.col("caller").alias("func"), F.lit(None).cast("string").alias("up"), F.col("callee").alias("down"))
    in_ = edges.select(F.col("callee").alias("func"), F.col("caller").alias("up"), F.lit(None).cast("string").alias("down"))
    return out.union(in_).groupBy("func").agg(F.sort_array(F.collect_set("up")).alias("callers"), F.sort_array(F.collect_set("down")).alias("callees"))
