"""Readers for the test tables and the views that map them onto the profile model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of ``sf_dir``, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
