"""Corpus pipeline over ``documents``: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of ``docs``. A stage that judges documents by id keeps rows
without one, as nothing was found against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import cut, table
from profloom.llm.op01_line_dedup import line_dedup
from profloom.llm.op03_toxicity import toxicity
from profloom.llm.op04_ngram_join import ngram_join
from profloom.llm.op05_mixture import mix
from profloom.llm.op07_decontaminate import overlaps


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.join(judged.where("predicted = 1").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; a text that they were all of goes as a document."""
    found = line_dedup(docs)
    kept = found.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    sized = [F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(c)).cast(kind).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes]
    return kept.select(*sized)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies stays."""
    found = ngram_join(docs)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified overlap with a benchmark item go."""
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with copies and tail_tokens.

    Texts stay whole: a reader takes a document ``copies`` times and then its first
    ``tail_tokens`` words. Rows without an id are told apart by their text.
    """
    taken = mix(docs, carry=(F.xxhash64("text").alias("print"),)).withColumnRenamed("doc_id", "id")
    taken = taken.select("id", "print", "domain", "n_tokens", "copies", "tail_tokens").distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["id"]) & (F.xxhash64("text") == F.col("print"))).select(*docs.columns, "domain", "n_tokens", "copies", "tail_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
]

#: The classifier cannot be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
