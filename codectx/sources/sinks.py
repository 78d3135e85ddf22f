"""Sinks: vector indexes with their metadata, histories, checkpoints, text reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def save_index(vectors: DataFrame, path: str, dim: int, fingerprint: str) -> None:
    """Write vectors (cid, vec) and one row of metadata below a folder that executors share."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(dim, fingerprint)], "dim int, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def _meta(spark: SparkSession, path: str) -> Row | None:
    """The row of metadata of a saved index, None if there is no such folder; any other failure is raised."""
    try:
        return spark.read.json(f"{path}/meta").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_index(spark: SparkSession, path: str, dim: int) -> DataFrame | None:
    """The vectors of a saved index; None if it isn't there or has another dimension."""
    meta = _meta(spark, path)
    return spark.read.parquet(f"{path}/vectors") if meta and meta["dim"] == dim else None


def index_valid(spark: SparkSession, path: str, fingerprint: str) -> bool:
    meta = _meta(spark, path)
    return bool(meta) and meta["fingerprint"] == fingerprint


def ids_fingerprint(ids: list[str]) -> str:
    return hashlib.sha256("".join(ids).encode()).hexdigest()[:16]


def save_history(history: DataFrame, path: str) -> None:
    """One JSON object a line."""
    history.coalesce(1).write.mode("overwrite").json(path)


def save_checkpoint(spark: SparkSession, path: str, weights: DataFrame, affinities: DataFrame, gate: dict, history: DataFrame, config: dict) -> None:
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    affinities.write.mode("overwrite").parquet(f"{path}/affinities")
    save_history(history, f"{path}/history")
    spark.createDataFrame([(json.dumps(gate), json.dumps(config))], "gate string, config string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    meta = spark.read.json(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/affinities"), json.loads(meta["gate"])


def text_report(chunks: DataFrame, path: str) -> None:
    """A headed block of text for each chunk (title, content)."""
    chunks.select(F.concat(F.lit("=== "), F.col("title"), F.lit(" ===\n"), F.col("content"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
