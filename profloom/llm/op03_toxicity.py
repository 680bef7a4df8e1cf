"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed insult list and of a list learned from the
training labels (words and word beginnings that toxic texts use far more often), closeness
of second-person words to hits, capitals, punctuation and obfuscation rates. Labels, lang,
source and doc_id are never features.

Fitting takes a bounded sample of the labelled training rows (``FIT_TOXIC`` and
``FIT_CLEAN``, chosen by hash of the id, weighted back to the classes' sizes); scoring
takes every row, one pass, no shuffle. The sample is split by hash, at every size: one part
finds the learned list, one grows the trees, one calibrates on rows that neither has seen.

Defined cases: null text is empty; empty texts get a score like any other; without both
classes among the rows for the trees, every score is the share of toxic labels (0 without labels); a label
that is null or not 0/1 is ignored, a document with several labels is toxic if one is; a
repeated row is returned as often as it stands; very long texts are read whole; texts of equal
features have equal scores. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import cut, table

FIT_TOXIC, FIT_CLEAN = 8_000, 16_000  # bounds of the fitting sample
#: Entries of the learned list at most, least toxic texts of one, least log ratio.
LEARNED, LEAST_TEXTS, LEAST_RATIO = 2_000, 5, 3.0
TREES, DEPTH, STEP = 20, 4, 0.2

#: Insults in plain letters, English, German, French, Spanish.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns
    fool fools jerk creep filthy vile ugly imbecile imbeciles dimwit bastard bastards bitch asshole shit fuck crap cunt
    dumm trottel arsch schwein abschaum blöd blödmann wichser versager
    imbécile crétin salaud connard ordure débile abruti minable
    imbécil estúpido estúpida idiota basura escoria gilipollas cabrón
    """.split()
)
#: Second-person words of the same languages.
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
#: Characters that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})

PREFIXES = (5, 6, 7)
FEATURES = (
    "log_words insult_share insult_hits learned_share learned_hits learned_best learned_mass you_share near_you near_share "
    "capital_share shout_share exclaim_share question_share mark_share digit_share obfuscated_share odd_share word_length distinct_share"
).split()
_SEED, _LEARNED, _YOU, _HIDDEN = 1, 2, 4, 8
_CACHE = 300_000


def plain(word: str) -> str:
    """Letters of a lower-case word, stand-ins resolved when the word has letters of its own."""
    if word.isalpha():
        return word
    core = word.strip("".join(c for c in set(word) if not c.isalnum() and c not in "@$"))
    if any(c.isalpha() for c in core):
        core = core.rstrip("!").translate(LEET)
    return "".join(c for c in core if c.isalpha())


def keys(letters: str) -> list[str]:
    """Entries of the learned list that a word can hit."""
    return [letters, *(f"{letters[:k]}*" for k in PREFIXES if len(letters) >= k)] if letters else []


def hidden(word: str) -> bool:
    """Does the word hide letters: symbols or digits among them, or a tail of symbols?"""
    if word.isalpha() or not any(c.isalpha() for c in word):
        return False
    tail = len(word) - len(word.rstrip("*#$%&@!~^+=_"))
    inner = word.strip(".,;:!?\"'()[]{}*#$%&@~^+=_-…»«¿¡")
    return tail > 1 or any(not c.isalpha() and c not in "-'’" for c in inner)


class Reader:
    """Words to codes and weights, with a bounded memory of words seen."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned, self.seen = learned, {}

    def look(self, word: str) -> tuple[int, float]:
        letters = plain(word)
        squeezed = "".join(c for i, c in enumerate(letters) if i < 2 or not c == letters[i - 1] == letters[i - 2])
        weight = max((self.learned.get(k, 0.0) for k in keys(letters)), default=0.0)
        code = (_SEED if letters in INSULTS or squeezed in INSULTS else 0) | (_LEARNED if weight else 0)
        code |= (_YOU if letters in SECOND_PERSON else 0) | (_HIDDEN if hidden(word) else 0)
        if len(self.seen) >= _CACHE:
            self.seen.clear()
        self.seen[word] = found = (code, weight)
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.lower().split()
        n = len(words)
        seen, look = self.seen, self.look
        found = [seen.get(w) or look(w) for w in words]
        code = np.fromiter((c for c, _ in found), np.int8, n)
        kinds = [code & k != 0 for k in (_SEED, _LEARNED, _YOU, _HIDDEN)]
        hits = np.flatnonzero(kinds[0] | kinds[1])
        weights = [found[i][1] for i in hits]
        you = np.flatnonzero(kinds[2])
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
            near = int((gap <= 5).sum())
        bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size = max(1, int(bytes_.sum()))
        letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum()))
        marks = bytes_[33:48].sum() + bytes_[58:65].sum() + bytes_[91:97].sum() + bytes_[123:127].sum()
        shout = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
        per = 1 / max(1, n)
        return [
            math.log1p(n), kinds[0].sum() * per, min(20.0, kinds[0].sum()), kinds[1].sum() * per, min(20.0, kinds[1].sum()), max(weights, default=0.0),
            sum(weights) * per, len(you) * per, float(min(20, near)), near / max(1, len(hits)), bytes_[65:91].sum() / letters, shout * per, bytes_[33] / size,
            bytes_[63] / size, marks / size, bytes_[48:58].sum() / size, kinds[3].sum() * per, bytes_[128:].sum() / size, size * per, len(set(words)) * per,
        ]


def _feature_rows(learned: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(learned)
        for batch in batches:
            found = [reader.features(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            cols = [batch.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(pa.float64()))], [*(batch.schema.names[i] for i in keep), "x"])

    return run


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic texts, clean texts) of this task's texts."""
    sides: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sides[label].update({k for w in set((text or "").lower().split()) for k in keys(plain(w))})
    for k, side in enumerate(sides):
        names = list(side)
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            n = pa.array([side[w] for w in part], pa.int64())
            none = pa.array(np.zeros(len(part), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), n if k else none, none if k else n], ["key", "toxic", "clean"])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; ``labels`` has doc_id and toxic."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marked = marked.where(~held_out("doc_id"))
    sizes = {label: n for label, n in marked.groupBy("label").count().collect()}
    kept = held_out("doc_id").alias("held_out")
    if len(sizes) < 2:
        share = float(bool(sizes.get(1)))
        return rows.select("doc_id", kept, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))

    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) / 1_000_000
    share = {k: min(1.0, 0.97 * most / sizes[k]) if sizes[k] > most else 1.0 for k, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))}
    rate = F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100))
    chosen = marked.where(draw < rate).select("doc_id", "label", (1 / rate).alias("weight"), part.alias("part"))
    sample = cut(rows.join(F.broadcast(chosen), "doc_id"))  # at most FIT_TOXIC + FIT_CLEAN ids
    grown = {r.label for r in sample.where("part >= 45 AND part < 85").select("label").distinct().collect()}
    if len(grown) < 2:
        share = float(sizes[1] / (sizes[0] + sizes[1]))
        return rows.select("doc_id", kept, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    cond = ("part < 45", "part >= 45 AND part < 85", "part >= 85")

    first = sample.where(cond[0])
    totals = {label: n for label, n in first.groupBy("label").count().collect()}
    counts = first.select("text", "label").mapInArrow(_key_counts, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (totals.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (totals.get(0, 0) + 1))
    top = counts.where(F.col("toxic") >= LEAST_TEXTS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    learned = {r.key: float(r.ratio) for r in top.orderBy(F.desc("toxic"), "key").limit(LEARNED).select("key", "ratio").collect()}

    schema = "doc_id " + rows.schema["doc_id"].dataType.simpleString()
    made = sample.select("text", "label", "weight", "part").mapInArrow(_feature_rows(learned), "label int, weight double, part long, x array<double>")
    made = cut(made.coalesce(4)).select("label", "weight", "part", array_to_vector("x").alias("features"))
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=3, seed=17, cacheNodeIds=False)
    model = trees.fit(made.where(cond[1]).coalesce(4))
    margin = vector_to_array("probability")[1].alias("margin")
    fitted = model.transform(made.where(cond[2])).select(F.col("label").cast("double").alias("label"), "weight", margin)
    if fitted.select("label").distinct().count() < 2:  # nothing to calibrate by: the trees' margin stands
        fitted = fitted.sparkSession.createDataFrame([(float(k), 1.0, float(k)) for k in (0, 1)], "label double, weight double, margin double")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="risk").fit(fitted)

    scored = rows.mapInArrow(_feature_rows(learned), f"{schema}, x array<double>").select("doc_id", array_to_vector("x").alias("features"))
    scored = curve.transform(model.transform(scored).select("doc_id", margin))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("risk") + 0.02 * F.col("margin")))  # ties of a step keep the trees' order
    return scored.select("doc_id", kept, score.alias("score")).select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
