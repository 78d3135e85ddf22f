"""Chunks of files as they arrive. The batch operators do the work; a stream only feeds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codectx.operators.entities import entity_chunks


def new_files(spark: SparkSession, folder: str, schema: str = "path string, content string, at timestamp") -> DataFrame:
    """A stream of rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def append_chunks(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Chunk each batch of new files and hand it to ``sink`` with its number; a batch that is tried again has the same number, so a sink that overwrites by number writes each once."""

    def one(batch: DataFrame, number: int) -> None:
        sink(entity_chunks(batch, [], "path", "content"), number)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
