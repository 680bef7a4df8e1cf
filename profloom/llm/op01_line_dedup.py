"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run of consecutive non-blank lines counts when it has ``MIN_CHARS`` characters in all or
``MIN_LINES`` lines. Every line that lies in such a run which also occurs earlier (smaller
doc_id, or same document and earlier line) is deleted; the first occurrence stays.

* Each line opens the shortest window that counts, and ends one; the window's smallest line
  hash, with its position, is its fingerprint. Windows over one minimum share it, so far
  fewer positions are selected than there are windows. A repeated run holds whole windows,
  which select the same lines in both texts: that is the guarantee. So a window whose
  fingerprint stands at one selected position only repeats nowhere and goes no further.
* The other windows' positions join with the earliest position of the same fingerprint and
  content (a partial aggregate), so a line that a third of all texts hold costs one row per
  place, not one per pair. Both sides of that join are written tables, so that Spark can
  split a fingerprint that very many places share.
* Matching windows that overlap or adjoin chain into the maximal repeated run, which extends
  a match line by line both ways, and the whole run is deleted from the later text. This is
  linear also where one text repeats a line many times over.

Defined cases: a null text stays null with no lines; blank lines neither count nor break a
run and are kept; rows without an id are returned as they are; a repeated row is returned
as often as it stands, judged as one document. Very long texts are handled whole, their
windows as rows. Extra columns of the input are kept. An empty table gives an empty result.
Lines are compared through two independent 64-bit hashes; equal smallest hashes of a window
are equal lines, of which the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import cut, table

MIN_CHARS, MIN_LINES = 50, 8
_WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _near(array: str, at: str, ahead: bool = True) -> str:
    """Up to MIN_LINES elements from index ``at`` (from 0) on; slice() would copy the whole array each time."""
    return f"array_compact(array({', '.join(f'get({array}, int({at}) {"+" if ahead else "-"} {j})' for j in range(MIN_LINES))}))"


def _window_sizes(chars: str, sizes: str, ahead: bool) -> str:
    """Lines of the shortest counting window from (or up to) each line; 0 where the text is too short."""
    fold = f"""aggregate({_near(chars, "i - 1", ahead)}, named_struct('s', 0, 'k', 0),
        (a, x) -> if(a.s >= {MIN_CHARS}, a, named_struct('s', a.s + x, 'k', a.k + 1)),
        a -> if(a.s >= {MIN_CHARS} OR a.k = {MIN_LINES}, a.k, 0))"""
    return f"if({sizes} > 0, transform(sequence(1, {sizes}), i -> {fold}), array())"


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, g, chars, place): two hashes, the size and the index of each non-blank line."""
    placed = F.transform(_lines(F.col(text_col).cast("string")), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.filter(placed, lambda s: s.x.rlike(_WORD)).alias("lines")
    )
    return lines.select(
        "doc",
        F.transform("lines", lambda s: F.xxhash64(s.x)).alias("h"),
        F.transform("lines", lambda s: F.xxhash64(F.lit(97), s.x)).alias("g"),
        F.transform("lines", lambda s: F.length(s.x)).alias("chars"),
        F.col("lines.i").alias("place"),
    )


def windows_of(hashed: DataFrame) -> DataFrame:
    """(doc, w): the windows of each text as structs (at, k, p, print, content, place).

    at, k and p count non-blank lines, from 1; place has the window's line indices in the text.
    """
    sized = hashed.withColumn("n", F.size("h"))
    sized = sized.withColumn("ahead", F.expr(_window_sizes("chars", "n", True))).withColumn("back", F.expr(_window_sizes("chars", "n", False)))
    # one that ends where a shortest opening window ends is the same
    opening = "filter(transform(ahead, (k, i) -> struct(i + 1 AS at, k AS k)), w -> w.k > 0)"
    ending = "filter(transform(back, (k, i) -> struct(i + 2 - k AS at, k AS k)), w -> w.k > 0 AND get(ahead, w.at - 1) <> w.k)"
    lines = f"transform(concat({opening}, {ending}), w -> struct(w.at AS at, w.k AS k, slice({_near('h', 'w.at - 1')}, 1, w.k) AS h, slice({_near('g', 'w.at - 1')}, 1, w.k) AS g, slice({_near('place', 'w.at - 1')}, 1, w.k) AS place))"
    placed = "transform(w, x -> struct(x.at AS at, x.k AS k, int(x.at + array_position(x.h, array_min(x.h)) - 1) AS p, array_min(x.h) AS print, xxhash64(x.g) AS content, x.place AS place))"
    return sized.withColumn("w", F.expr(lines)).select("doc", F.expr(placed).alias("w"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc, at, k, place): windows that repeat an earlier one."""
    selected = windows.select(F.explode(F.expr("array_distinct(transform(w, x -> struct(x.print, x.p)))")).alias("x")).select("x.print")
    several = cut(selected.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    rows = windows.select("doc", F.explode("w").alias("x")).select("doc", "x.at", "x.k", "x.print", "x.content", "x.place")
    rows = cut(rows.join(several, "print", "left_semi"))
    first = cut(rows.groupBy("print", "content").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(first, ["print", "content"]).where("doc <> first.doc OR at <> first.at").select("doc", "at", "k", "place")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with later repeated runs deleted from its text, plus n_lines, n_removed, n_runs."""
    found = repeated_windows(cut(windows_of(line_hashes(docs, id_col, text_col))))
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    chains = F.array_sort(gathered(F.expr("sequence(at, at + k - 1)")))
    cuts = found.groupBy("doc").agg(gathered("place").alias("__gone"), chains.alias("__chain"))
    cuts = cuts.select("doc", "__gone", F.expr("size(filter(__chain, (x, i) -> i = 0 OR get(__chain, i - 1) <> x - 1))").alias("__runs"))
    joined = docs.join(cuts.withColumnRenamed("doc", "__doc"), F.col(id_col).cast("long") == F.col("__doc"), "left").drop("__doc")
    lines = joined.withColumn("__lines", _lines(F.col(text_col).cast("string")))
    kept = F.expr("array_except(sequence(0, size(__lines) - 1), __gone)")
    text = F.when(F.col("__gone").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return lines.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("__lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__runs", F.lit(0)).cast("long").alias("n_runs"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH line AS (
  SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(i)
), filled AS (
  SELECT doc_id, i, line, length(line) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), near AS (
  SELECT doc_id, k, list(line) OVER f AS fl, list(chars) OVER f AS fc, list(line) OVER b AS bl, list(chars) OVER b AS bc FROM filled
  WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
), sized AS (
  SELECT *, CASE WHEN list_sum(fc) >= 50 THEN list_min([x FOR x IN range(1, len(fc) + 1) IF list_sum(fc[1:x]) >= 50]) WHEN len(fc) = 8 THEN 8 END AS fk,
         CASE WHEN list_sum(bc) >= 50 THEN list_min([x FOR x IN range(1, len(bc) + 1) IF list_sum(bc[len(bc) - x + 1:]) >= 50]) WHEN len(bc) = 8 THEN 8 END AS bk
  FROM near
), windows AS (
  SELECT doc_id, k AS lo, k + fk - 1 AS hi, fl[1:fk] AS content FROM sized WHERE fk IS NOT NULL
  UNION SELECT doc_id, k - bk + 1, k, bl[len(bl) - bk + 1:] FROM sized WHERE bk IS NOT NULL
), placed AS (
  SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, u.k FROM placed, unnest(range(lo, hi + 1)) AS u(k) WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, g.k IS NOT NULL AS cut FROM line l LEFT JOIN filled f ON f.doc_id = l.doc_id AND f.i = l.i LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = f.k
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""
