"""Source files that do not parse: flag them and report rates for each repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import spread
from codectx.llm.syntax import PARSERS

JUDGED = r"(?i)\.(py|js|ts|java|go)$"
OUT = "origin string, record_id long, file_path string, repo string, language string, valid boolean, first_line int, first_cause string, errors array<struct<line:int,cause:string>>"


def check(path: str, text: str) -> tuple[str, list[tuple[int, str]]] | None:
    """(language, [(line, cause), ...]) of a text, None if its extension isn't judged.

    >>> check("a.py", "x = (1")[1][0][0], check("a.txt", "x")
    (1, None)
    """
    language = PARSERS.get(path.rpartition(".")[2].lower())
    if not language:
        return None
    name, parse = language
    errors = parse(text)
    return name, [(text.count("\n", 0, min(e.at, len(text))) + 1, e.why) for e in errors]


def files(loader_samples: DataFrame, code_chunks: DataFrame) -> DataFrame:
    """(origin, record_id, file_path, repo, content) of the whole files whose extension is judged; null contents count as empty."""
    cross = loader_samples.select("sample_id", "repo", F.explode("crossfile_context").alias("file_path", "content"))
    own = code_chunks.filter("chunk_type = 'fallback'")
    both = cross.select(F.lit("crossfile").alias("origin"), F.col("sample_id").alias("record_id"), "file_path", "repo", "content").unionByName(
        own.select(F.lit("chunk").alias("origin"), F.col("chunk_key").alias("record_id"), "file_path", "repo", F.col("text").alias("content"))
    )
    return both.filter(F.col("file_path").rlike(JUDGED)).withColumn("content", F.coalesce("content", F.lit("")))


def check_files(texts: DataFrame) -> DataFrame:
    """One row for each of files(): its language, whether it is valid, the first cause and all errors with their lines.

    An empty text is valid Python, JavaScript, TypeScript and Java, and no Go file (which needs a package). Repeated rows are
    judged each; equal texts that a task meets again aren't parsed again. Nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            seen: dict[tuple[str, str], tuple[str, list[tuple[int, str]]]] = {}
            for origin, key, path, repo, text in b.itertuples(index=False):
                at = (path.rpartition(".")[2].lower(), text)
                if at not in seen:
                    seen[at] = check(path, text)
                language, errors = seen[at]
                first = errors[0] if errors else (None, None)
                rows.append((origin, key, path, repo, language, not errors, *first, [{"line": n, "cause": c} for n, c in errors]))
            yield pd.DataFrame(rows, columns=["origin", "record_id", "file_path", "repo", "language", "valid", "first_line", "first_cause", "errors"]).astype({"first_line": "Int32"})

    return spread(texts.select("origin", "record_id", "file_path", "repo", "content")).mapInPandas(run, OUT)


def rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their share, for each repository and language."""
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.count_if(~F.col("valid")) / F.count("*"), 6).alias("invalid_rate")
    )
