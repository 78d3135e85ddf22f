"""Chunkers as table functions for SQL: register(spark), then SELECT * FROM line_chunks(text, 40) and the like, laterally over any table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from codectx.operators import entities, structural


class LineChunks:
    def eval(self, text: str, size: int) -> Iterator[tuple]:
        own = (text or "").splitlines()
        for k, at in enumerate(range(0, max(1, len(own)), size)):
            yield k, at + 1, min(at + size, max(1, len(own))), "\n".join(own[at : at + size])


class EntitySpans:
    def eval(self, text: str) -> Iterator[tuple]:
        for s in entities.spans(text or "") or ():
            yield s["kind"], s["start"], s["end"], s["defined"], s["parent"]


class StructuralWindows:
    def eval(self, path: str, text: str, most: int) -> Iterator[tuple]:
        root = structural.tree_of(path or "", text) if text else None
        if root is not None:
            data = text.encode("utf-8", "replace")
            for k, w in enumerate(structural.pack(root, structural.nws_sums(data), most)):
                yield k, w[0][0].start_row, w[-1][0].end_row, structural.rebuilt(w, data)


def register(spark: SparkSession) -> None:
    spark.udtf.register("line_chunks", udtf(LineChunks, returnType="chunk_no int, start_line int, end_line int, text string"))
    spark.udtf.register("entity_spans", udtf(EntitySpans, returnType="kind string, start_line int, end_line int, defined array<string>, parent string"))
    spark.udtf.register("structural_windows", udtf(StructuralWindows, returnType="window_no int, start_row int, end_row int, content string"))
