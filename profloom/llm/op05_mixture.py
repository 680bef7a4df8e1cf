"""Mixing sources to target weights: hierarchical token budgets over a domain-language-source tree.

The total budget goes down the tree by integer weights. A node takes at most its supply
times ``MAX_EPOCHS``; what a node cannot take goes to its siblings by their weights, and
only what all of them cannot take is missing one level up, where the parent's siblings
share it (water filling, level by level, as capacities are known from below). Each leaf
then reads its documents in seeded order, epoch by epoch, and takes the prefix of tokens
that its budget covers: whole epochs first, then documents of the next epoch until the
budget ends inside one, which is cut.

Scale: the tree is an aggregate; prefix sums in a leaf run over 4096 buckets of the seeded
hash, and only inside a bucket over rows, so a leaf that holds a third of all rows is
spread like any other. What still meets by leaf alone is a row per bucket, 4096 at most.

Defined cases: null keys are the empty string; null or blank texts have no tokens and are
never taken; budgets round down, so a leaf may miss fewer tokens than its parents have
children; repeated rows stand next to each other in the order and are taken each; empty
tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profloom.llm.common import cut, table

#: Share of all tokens that the mixture holds, in hundredths; epochs that a document may serve.
SHARE, MAX_EPOCHS, SEED = 70, 2, "mix1"
LEVELS = ("domain", "lang", "source")
#: Target weights by level; values that are not named weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 3, "fr": 2, "es": 1}, "source": {}}


def domain_of(source: Column) -> Column:
    """The default domain: the source's number modulo four."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.try_to_number(number, F.lit("999999999")).cast("bigint") % 4).cast("string"))).otherwise("other")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {})
    found = F.lit(1)
    for value, w in named.items():
        found = F.when(F.col(level) == value, w).otherwise(found)
    return found.cast("decimal(10,0)")


def fill_level(nodes: DataFrame, parents: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Share ``budget`` (of the parent) among siblings with ``cap``: adds ``share``."""
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
    before, onward = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    d = lambda c: F.col(c).cast("decimal(20,0)")
    nodes = nodes.withColumn("w", _weight(level, weights))
    nodes = nodes.withColumn("lower", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest_w", F.sum("w").over(onward).cast("decimal(12,0)"))
    full = d("cap") * F.col("rest_w") <= F.col("w") * (d("budget") - d("lower"))
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0)))
    nodes = nodes.withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings).cast("decimal(12,0)"))
    left = (F.col("w") * (d("budget") - d("taken"))).cast("decimal(32,0)")
    nodes = nodes.withColumn("left", left)
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left div open_w"))).drop("w", "lower", "rest_w", "full", "taken", "open_w", "left")


def leaf_budgets(sizes: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict = WEIGHTS, share: int = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(levels..., supply, budget) of each leaf with tokens; ``sizes`` has the levels and n_tokens."""
    leaves = sizes.groupBy(*levels).agg(F.sum("n_tokens").alias("supply")).where("supply > 0")
    leaves = cut(leaves.withColumn("cap", F.col("supply") * max_epochs))
    total = leaves.agg(F.expr(f"coalesce(sum(supply), 0) * {share} div 100").alias("t"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c")).first()
    budgets = None
    for k, level in enumerate(levels):
        keys, parents = list(levels[: k + 1]), list(levels[:k])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("budget", F.lit(min(total.t, total.c)).cast("bigint")) if budgets is None else nodes.join(budgets, parents)
        budgets = fill_level(nodes, parents, level, weights).select(*keys, F.col("share").alias("budget"))
    return leaves.join(budgets, list(levels)).select(*levels, "supply", "budget")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, lang_col: str = "lang", source_col: str = "source",
    weights: dict = WEIGHTS, share: int = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[Column, ...] = (),
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, tail_tokens) of the documents taken, and the columns to ``carry``.

    ``copies``: epochs that take the whole document; ``tail_tokens``: tokens of its beginning
    that the last epoch takes where the budget ends inside it.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(domain if domain is not None else domain_of(source), F.lit("")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), source.alias("source"), n.alias("n_tokens"), *carry,
    )
    also = slim.columns[5:]
    slim = cut(slim.where("n_tokens > 0"))
    budgets = leaf_budgets(slim, LEVELS, weights, share, max_epochs).select(*LEVELS, F.expr("budget div supply").alias("epochs"), F.expr("budget % supply").alias("rest"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = slim.join(budgets, list(LEVELS)).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    bucket = [*LEVELS, "bucket"]
    sums = rows.groupBy(*bucket).agg(F.sum("n_tokens").alias("size"))
    sums = sums.withColumn("ahead", F.sum("size").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("size")).drop("size")
    inside = Window.partitionBy(*bucket).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, bucket)
    start = F.col("ahead") + F.col("upto") - F.col("n_tokens")
    room = F.col("rest") - start
    whole = (room >= F.col("n_tokens")).cast("long")
    tail = F.when((room > 0) & (room < F.col("n_tokens")), room).otherwise(F.lit(0)).cast("long")
    taken = placed.select("doc_id", *LEVELS, "n_tokens", (F.col("epochs") + whole).alias("copies"), tail.alias("tail_tokens"), *also)
    return taken.where("copies > 0 OR tail_tokens > 0")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _level_sql(k: int) -> str:
    """One level of water filling, as CTEs ``nodeK`` to ``budgetK``."""
    keys, parents = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
    named = " ".join(f"WHEN {LEVELS[k]} = '{v}' THEN {w}" for v, w in WEIGHTS[LEVELS[k]].items())
    weight = f"(CASE {named} ELSE 1 END)" if named else "1"
    part = f"PARTITION BY {parents}" if k else ""
    budget = f"JOIN budget{k - 1} USING ({parents})" if k else f"CROSS JOIN (SELECT least(sum(supply) * {SHARE} // 100, sum(cap)) AS budget FROM leaf)"
    return f"""
node{k} AS (SELECT n.*, budget, {weight} AS w FROM (SELECT {keys}, sum(cap) AS cap FROM leaf GROUP BY {keys}) n {budget}),
order{k} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM node{k} WINDOW o AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {LEVELS[k]})),
full{k} AS (SELECT *, cap * rest_w <= w * (budget - lower) AS is_full FROM order{k}),
budget{k} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({part}), 0))) // sum(w) FILTER (WHERE NOT is_full) OVER ({part}) END AS budget FROM full{k})"""


def oracle(docs: str = "documents") -> str:
    return rf"""
WITH slim AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4)::VARCHAR ELSE 'other' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM {docs}
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens) AS supply, sum(n_tokens) * {MAX_EPOCHS} AS cap FROM slim GROUP BY ALL HAVING sum(n_tokens) > 0
), {_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)}, plan AS (
  SELECT l.domain, l.lang, l.source, budget // supply AS epochs, budget % supply AS rest FROM leaf l JOIN budget2 b USING (domain, lang, source)
), keyed AS (
  SELECT s.*, p.epochs, p.rest, md5(concat_ws(':', '{SEED}', p.epochs::BIGINT::VARCHAR, coalesce(s.doc_id::VARCHAR, ''))) AS key FROM slim s JOIN plan p USING (domain, lang, source) WHERE n_tokens > 0
), placed AS (
  SELECT *, rest - (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS UNBOUNDED PRECEDING) - n_tokens) AS room FROM keyed
), taken AS (
  SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN room >= n_tokens THEN 1 ELSE 0 END)::BIGINT AS copies,
         (CASE WHEN room > 0 AND room < n_tokens THEN room ELSE 0 END)::BIGINT AS tail_tokens FROM placed
)
SELECT * FROM taken WHERE copies > 0 OR tail_tokens > 0
"""


ORACLE = oracle()
