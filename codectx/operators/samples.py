"""Completion samples cut from the files of repositories.

An attempt picks a repository, an eligible file of it, a level and a cut; what doesn't make a useful sample is dropped, and the first N attempts
that do are kept. All picks are orders of hashes of seed and attempt, so attempts are independent rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codectx.functions import text as t
from codectx.operators import sampling, structural
from codectx.operators.dense import uniform

#: Kinds of nodes of the trees at which a file may be cut. Fixed values.
ONE_LINE = frozenset("Expr Assign AugAssign AnnAssign Return Raise Assert Delete Import ImportFrom statement".split())
BLOCKS = frozenset("If For While With Try Match AsyncFor AsyncWith function_definition class_definition statement".split())
KINDS = {"line": ONE_LINE, "block": BLOCKS, "mixed": ONE_LINE | BLOCKS}
#: Levels tried one after another where one offers no cut. Fixed values.
FALLBACK = {"line": ("line", "block", "mixed"), "block": ("block", "line", "mixed"), "mixed": ("mixed", "line", "block")}
LEAST_LINES, LEAST_LEFT = 10, 30


def cut(content: str, language: str, level: str, pick: float, last: float) -> tuple[int, int] | None:
    """(first row, last row) of the target; None for a file of fewer than 10 lines. Where no tree offers a cut, one line between the half and four fifths of the file is taken."""
    n = content.count("\n") + 1
    if n < LEAST_LINES:
        return None
    root = structural.python_tree(content) if language == "python" else structural.brace_tree(content) if language in ("java", "typescript") else None
    for name in FALLBACK[level] if root else ():
        found = structural.cut_candidates(root, name, KINDS[name])
        if found:
            return found[int(pick * len(found))]
    row = int(n * (0.5 + 0.3 * last))
    return row, row


def build_samples(files: DataFrame, wanted: int, attempts: int, seed: int = 13, least_lines: int = 200, least_chars: int = 2000, least_left: int = LEAST_LEFT, shares: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, crossfile): samples of files (repo_id, path, content), and for each the other files of its repository (by path).

    samples: sample_id (the attempt), repo_id, path, left_context, target, right_context, cut_level (as drawn, also where another level gave the cut), n_lines. Repositories with an
    eligible file are preferred, others serve only if there is none; so are a repository's eligible files. Null contents are left out. Targets that are blank, only comments or only
    imports, and left contexts of fewer than ``least_left`` lines, make no sample.
    """
    base = files.filter("content is not null").select("repo_id", "path", t.newline_normalised(F.col("content")).alias("content"))
    base = base.withColumn("good", t.is_eligible(F.col("content"), least_lines, least_chars))
    repos = base.groupBy("repo_id").agg(F.max("good").alias("good"))
    any_good = repos.agg(F.coalesce(F.max("good"), F.lit(False))).first()[0]
    pool = sampling.hash_positions(repos.filter("good") if any_good else repos, sampling.order_key(seed, F.col("repo_id")), "place").select("repo_id", "place")
    n = pool.count()
    spark = files.sparkSession
    tries = spark.range(attempts).select(F.col("id").alias("sample_id"), (F.floor(uniform(seed, F.lit("repo"), F.col("id")) * n) + 1).alias("place"))
    drawn = tries.join(pool, "place").select("sample_id", "repo_id")
    # a file is drawn by its place among the eligible ones of its repository, so that an attempt meets one file and no other
    offered = base.join(repos.withColumnRenamed("good", "any"), "repo_id").filter("good or not any").groupBy("repo_id", "path").agg(F.max("content").alias("content"))
    placed = sampling.hash_positions(offered, sampling.order_key(seed, F.lit("file"), F.col("repo_id"), F.col("path")), "file_place", ["repo_id"])
    sizes = offered.groupBy("repo_id").agg(F.count("*").alias("n_files"))
    pick = drawn.join(sizes, "repo_id").select("sample_id", "repo_id", (F.floor(uniform(seed, F.lit("file"), F.col("sample_id")) * F.col("n_files")) + 1).alias("file_place"))
    rows = pick.join(placed, ["repo_id", "file_place"])
    rows = rows.withColumn("cut_level", sampling.cut_level(uniform(seed, F.lit("level"), F.col("sample_id")), shares)).withColumn("language", t.language(F.col("path")))

    @F.pandas_udf("a int, b int")
    def cuts(content: pd.Series, language: pd.Series, level: pd.Series, pick: pd.Series, last: pd.Series) -> pd.DataFrame:
        found = [cut(*x) or (None, None) for x in zip(content, language, level, pick, last)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("Int32")

    placed = rows.withColumn("c", cuts("content", "language", "cut_level", uniform(seed, F.lit("cut"), F.col("sample_id")), uniform(seed, F.lit("last"), F.col("sample_id")))).filter("c.a is not null").withColumn("lines", F.split("content", "\n", -1))
    part = placed.select(
        "sample_id", "repo_id", "path", F.array_join(F.slice("lines", 1, F.col("c.a")), "\n").alias("left_context"), F.array_join(F.slice("lines", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1), "\n").alias("target"),
        F.array_join(F.expr("slice(lines, c.b + 2, greatest(0, size(lines) - c.b - 1))"), "\n").alias("right_context"), "cut_level", (F.col("c.b") - F.col("c.a") + 1).alias("n_lines"), F.col("c.a").alias("_left"), "language",
    )
    useful = part.filter((t.strip(F.col("target")) != "") & ~t.is_comment_only(F.col("target")) & ~t.is_import_only(F.col("target"), F.col("language")) & (F.col("_left") >= least_left)).drop("_left", "language")
    samples = useful.orderBy("sample_id").limit(wanted)
    others = base.select("repo_id", F.col("path").alias("other"), F.col("content").alias("other_content"))
    crossfile = samples.select("sample_id", "repo_id", "path").join(others, "repo_id").filter("other <> path").select("sample_id", F.col("other").alias("path"), F.col("other_content").alias("content"))
    return samples, crossfile
