"""License scan: sparse TF-IDF cosine to license templates, then inheritance down directories.

Every line of a file, and a licence file as a whole, is a unit with a sparse vector over its
words (lower-case runs of letters, digits, ``.`` and ``+``; a word counts once in a unit).
Weights are idf over all units of the corpus, for every word.
A unit whose cosine to a template is ``LEAST`` or more declares that licence; a file takes its
best unit's. A file without one inherits from the licence file in the nearest directory above
it, by joins on directory paths.

Only the templates (fixed, a few rows) are broadcast. Document frequencies are one aggregate
over the words of all units. Then only those units are cut to words again that hold one of the
heavy template words, without which no cosine reaches the threshold, and only those joined to
the frequencies that can still reach it when each word that no template has weighs as little
as the most frequent of them.

Defined cases: null text has no units; a null path has no directory and inherits nothing; ties
of cosine go to the template name that sorts first; of two licence files in one directory the
better match, then the smaller name, then the smaller path holds; a repeated row is returned
as often as it stands. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import cut, table

LEAST = 0.6
#: Licence statements as headers carry them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Names of licence files, without extension, upper case.
LICENSE_NAMES = ("LICENSE", "LICENCE", "COPYING", "NOTICE")
_WORD = "[a-z0-9.+]+"


def _words(text: str) -> str:
    """SQL for the distinct words of a text, dots at the ends of words dropped."""
    return f"filter(array_distinct(transform(regexp_extract_all(lower({text}), '{_WORD}', 0), w -> rtrim('.', w))), w -> w <> '')"


def templates(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(named.items()), "license string, statement string").selectExpr("license", f"explode({_words('statement')}) AS word")


def license_scan(files: DataFrame, id_col: str, path: Column, text_col: str, named: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, license, cosine, declared): ``declared`` is own, inherited or none."""
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    base = F.upper(F.regexp_extract(F.coalesce("path", F.lit("")), "([^/.]*)[^/]*$", 1))
    rows = rows.withColumn("is_file", base.isin(*LICENSE_NAMES))
    terms = cut(templates(spark, named))
    vocabulary = sorted(r.word for r in terms.select("word").distinct().collect())  # words of the fixed templates
    known = "array(" + ", ".join(f"'{w}'" for w in vocabulary) + ")"
    lines = rows.select("id", "path", "is_file", F.explode(F.expr("if(is_file, array_append(split(text, '\\n', -1), text), split(text, '\\n', -1))")).alias("unit"))
    cut_up = lambda df: df.select("id", "path", "is_file", F.expr(_words("unit")).alias("words")).where("size(words) > 0")
    # a unit's first word counts the units; no filter on the words, which would cut each unit up twice
    found = lines.select(F.posexplode(F.expr(_words("unit"))).alias("at", "word"))
    counts = cut(found.groupBy("word").agg(F.count("*").alias("df"), F.count_if(F.col("at") == 0).alias("units")))
    total = counts.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
    counts = counts.select("word", "df")
    idf = F.log((1.0 + F.col("units")) / (1.0 + F.coalesce("df", F.lit(0))))
    weights = F.broadcast(terms.select("word").distinct()).join(counts, "word", "left").crossJoin(F.broadcast(total))  # one row of totals
    weights = cut(weights.select("word", idf.alias("idf")))
    norms = terms.join(weights, "word").groupBy("license").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    model = F.broadcast(terms.join(weights, "word").join(norms, "license"))  # a row for each template word

    # no template's dot is above the sum of hits, no norm below the least, no other word lighter than the most frequent one
    others = counts.where(f"NOT array_contains({known}, word)")
    floor = others.groupBy().agg(F.max("df").alias("df")).crossJoin(total).select(idf.alias("idf")).first()
    floor, least_norm = floor.idf if floor else 0.0, norms.agg(F.min("norm")).first()[0] or 0.0
    weighed = {r.word: r.idf * r.idf for r in weights.collect()}  # a value for each template word
    squares = "map(" + ", ".join(f"'{w}', {x!r}D" for w, x in weighed.items()) + ")"
    # the lightest words that reach no cosine even all together; a unit needs one of the others
    heavy, light = sorted(weighed, key=weighed.get), 0.0
    while heavy and (light := light + weighed[heavy[0]]) < (least * least_norm) ** 2 * (1 - 1e-9):
        heavy.pop(0)
    units = cut_up(lines.where(F.lower("unit").rlike("|".join(w.replace(".", "\\.").replace("+", "\\+") for w in heavy) or "(?!)")))
    units = units.select("id", "path", "is_file", F.expr(f"array_intersect(words, {known})").alias("hits"), F.expr(f"array_except(words, {known})").alias("rest")).where("size(hits) > 0")
    units = units.withColumn("own", F.expr(f"aggregate(hits, 0D, (a, w) -> a + element_at({squares}, w))"))
    bound = F.col("own") * F.col("own") >= (least * least_norm) ** 2 * (1 - 1e-9) * (F.col("own") + F.size("rest") * floor * floor)
    near = cut(units.where(bound).withColumn("unit", F.expr("uuid()")))
    dots = near.select("unit", F.explode("hits").alias("word")).join(model.select("license", "word", "idf", "norm"), "word")
    dots = dots.groupBy("unit", "license").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.max("norm").alias("norm"))
    rest = near.select("unit", F.explode("rest").alias("word")).join(counts, "word").crossJoin(F.broadcast(total)).groupBy("unit").agg(F.sum(idf * idf).alias("others"))
    scored = near.select("id", "path", "is_file", "unit", "own").join(dots, "unit").join(rest, "unit", "left")
    size = F.sqrt(F.col("own") + F.coalesce("others", F.lit(0.0)))
    scored = scored.withColumn("cosine", F.round(F.try_divide(F.col("dot"), size * F.col("norm")), 9)).where(F.col("cosine") >= least)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", F.expr("-rank_of")))
    order = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(sorted(named))], "license string, rank_of int"))
    found = cut(scored.join(order, "license").groupBy("id", "path", "is_file").agg(best.alias("b")).select("id", "path", "is_file", "b.license", "b.cosine"))

    folder = F.regexp_replace("path", "[^/]*$", "")
    holders = found.where("is_file AND path IS NOT NULL").withColumn("folder", folder)
    holders = holders.groupBy("folder").agg(F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), F.col("license"), F.col("path"))).alias("h"))
    plain = rows.select("id", "path").distinct()
    steps = F.expr("transform(sequence(1, size(split(path, '/'))), k -> struct(k AS depth, if(k = 1, '', concat(array_join(slice(split(path, '/'), 1, k - 1), '/'), '/')) AS folder))")
    above = plain.where("path IS NOT NULL").select("id", "path", F.explode(steps).alias("s")).join(holders, F.col("s.folder") == F.col("folder"))
    inherited = above.groupBy("id", "path").agg(F.max_by("h", "s.depth").alias("h"))
    out = rows.select("id", "path").alias("r")
    out = out.join(found.select(F.col("id").alias("fid"), F.col("path").alias("fpath"), "license", "cosine"), F.col("r.id").eqNullSafe(F.col("fid")) & F.col("r.path").eqNullSafe(F.col("fpath")), "left")
    out = out.join(inherited.select(F.col("id").alias("hid"), F.col("path").alias("hpath"), "h"), (F.col("r.id") == F.col("hid")) & (F.col("r.path") == F.col("hpath")), "left")
    return out.select(
        F.col("r.id").alias("id"),
        F.col("r.path").alias("path"),
        F.coalesce("license", "h.license").alias("license"),
        F.coalesce("cosine", "h.cosine").alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("declared"),
    )


def document_path(id_col: str = "doc_id") -> Column:
    """Paths for ``documents``: source/lang/shard/file; the first document of a shard is its licence file."""
    name = F.when(F.col(id_col) % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col(id_col).cast("string"), F.lit(".txt")))
    shard = F.expr(f"{id_col} div 64").cast("string")
    top = F.when(F.col(id_col) % 640 == 0, F.lit("")).otherwise(F.concat(shard, F.lit("/")))
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), top, name)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_scan(docs, "doc_id", document_path(), "text")
    return found.select(F.col("id").alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "declared")


_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
ORACLE = rf"""
WITH template(license, statement) AS (VALUES {_VALUES}),
term AS (SELECT DISTINCT license, rtrim(w, '.') AS word FROM template, unnest(regexp_extract_all(lower(statement), '{_WORD}')) AS u(w) WHERE rtrim(w, '.') <> ''),
file AS (
  SELECT doc_id AS id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || CASE WHEN doc_id % 640 = 0 THEN '' ELSE (doc_id // 64) || '/' END
         || CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path, doc_id % 64 = 0 AS is_file, text FROM documents
), raw AS (
  SELECT id, path, is_file, unnest(CASE WHEN is_file THEN list_append(string_split(text, chr(10)), text) ELSE string_split(text, chr(10)) END) AS unit FROM file
), unit AS (
  SELECT *, row_number() OVER () AS u FROM (
    SELECT id, path, is_file, list_filter(list_distinct(list_transform(regexp_extract_all(lower(unit), '{_WORD}'), lambda w: rtrim(w, '.'))), lambda w: w <> '') AS words FROM raw) WHERE len(words) > 0
), freq AS (
  SELECT w AS word, count(*) AS df FROM unit, unnest(words) AS x(w) GROUP BY w
), total AS (SELECT count(*) AS n FROM unit),
weight AS (SELECT word, ln((1.0 + n) / (1.0 + df)) AS idf FROM freq CROSS JOIN total),
term_weight AS (SELECT license, word, ln((1.0 + n) / (1.0 + coalesce(df, 0))) AS idf FROM term LEFT JOIN freq USING (word) CROSS JOIN total),
norm AS (SELECT license, sqrt(sum(idf * idf)) AS norm FROM term_weight GROUP BY license),
word_of AS (SELECT u, w AS word FROM unit, unnest(words) AS x(w) WHERE list_has_any(words, (SELECT list(word) FROM term))),
size AS (SELECT u, sqrt(sum(idf * idf)) AS size FROM word_of JOIN weight USING (word) GROUP BY u),
dot AS (SELECT u, license, sum(idf * idf) AS dot FROM word_of JOIN term_weight USING (word) GROUP BY u, license),
scored AS (
  SELECT id, path, is_file, license, round(dot / (size * norm), 9) AS cosine FROM unit JOIN size USING (u) JOIN dot USING (u) JOIN norm USING (license) WHERE size * norm > 0
), found AS (
  SELECT id, path, is_file, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY cosine DESC, license) AS r FROM scored WHERE cosine >= {LEAST}) WHERE r = 1
), holder AS (
  SELECT * FROM (SELECT regexp_replace(path, '[^/]*$', '') AS folder, license, cosine, row_number() OVER (PARTITION BY regexp_replace(path, '[^/]*$', '') ORDER BY cosine DESC, license, path) AS r
  FROM found WHERE is_file) WHERE r = 1
), inherited AS (
  SELECT * FROM (SELECT f.id, f.path, h.license, h.cosine, row_number() OVER (PARTITION BY f.id, f.path ORDER BY length(h.folder) DESC) AS r
  FROM file f JOIN holder h ON starts_with(f.path, h.folder)) WHERE r = 1
)
SELECT f.id AS doc_id, f.path, coalesce(o.license, i.license) AS license, round(coalesce(o.cosine, i.cosine), 6) AS cosine,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN i.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS declared
FROM file f LEFT JOIN found o USING (id, path) LEFT JOIN inherited i USING (id, path)
"""
