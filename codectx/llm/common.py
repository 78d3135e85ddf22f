"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codectx.storage import shared_dir, spread, written

__all__ = ["crossfile_entries", "shared_dir", "spread", "table", "text_or_empty", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crossfile_entries(samples: DataFrame) -> DataFrame:
    """One row (record_id, file_path, content) for each entry of crossfile_context; null maps give none."""
    return samples.select(
        F.col("sample_id").alias("record_id"), F.explode("crossfile_context").alias("file_path", "content")
    )
