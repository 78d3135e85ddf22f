"""Sources: repository files in Parquet, file trees, evaluation sets, cross-file contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders that a file tree scan leaves out. Fixed values.
EXCLUDED = (".git", ".hg", ".mypy_cache", ".pytest_cache", "__pycache__", "node_modules", "dist", "build", ".venv", "venv")
#: Rows that are numbered together when flags are summed up along a table.
BLOCK = 1 << 16


def islands(df: DataFrame, position: str, first: Column, name: str = "repo_id") -> DataFrame:
    """``df`` with ``name``: how many rows up to and with each, in the order of ``position`` (whole numbers), begin something.

    Flags are summed within blocks of positions and shifted by the sums of the blocks before, so that no task sees more than a block and the
    list of block sums.
    """
    rows = df.withColumn("_f", F.coalesce(first, F.lit(False)).cast("long")).withColumn("_block", F.floor(F.col(position) / BLOCK))
    sums = rows.groupBy("_block").agg(F.sum("_f").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.orderBy("_block")) - F.col("_s")).drop("_s")
    inner = F.sum("_f").over(Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_inner", inner).join(before, "_block").withColumn(name, F.col("_inner") + F.col("_before")).drop("_f", "_block", "_inner", "_before")


def at_least(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``df`` with ``name``, the number of rows of each key, without keys of fewer than ``n``. Counts are aggregated first and joined back."""
    counts = df.groupBy(key).agg(F.count("*").alias(name)).filter(F.col(name) >= n)
    return df.join(counts, key)


def repo_files(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, file_seq, path, content, n_files) of a Parquet file of repository files in file order.

    A row with ``first`` true begins a repository, rows before the first such row are one too, and so is a file without that column. Repositories of
    one file are left out. File order is kept for one Parquet file, and over several by their names.
    """
    df = spark.read.parquet(path)
    rows = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    offset = files.withColumn("_offset", F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).select("_file", "_offset")
    placed = rows.join(offset, "_file").withColumn("file_seq", F.col("_row") + F.col("_offset"))
    flag = F.col("first") if "first" in df.columns else F.lit(False)
    return at_least(islands(placed, "file_seq", flag), "repo_id", 2, "n_files").select("repo_id", "file_seq", "path", "content", "n_files")


def excluded(path: Column) -> Column:
    """Whether any folder of a path, above the scanned root too, is one that is left out."""
    return F.exists(F.split(path, "[/\\\\]"), lambda x: x.isin(*EXCLUDED))


def display_path(path: Column, root: str | None) -> Column:
    """A path from the root on; the whole path if it lies elsewhere or there is no root."""
    plain = F.regexp_replace(path, "^file:/*", "/")
    if not root:
        return plain
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)


def file_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """(path, content) of the files below a folder; bytes that aren't UTF-8 become replacement characters."""
    glob = "*" if not suffixes else "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    @F.pandas_udf("string")
    def decoded(data):  # noqa: ANN001, ANN202
        return data.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return files.filter(~excluded(F.col("path"))).select(display_path(F.col("path"), root).alias("path"), decoded("content").alias("content"))


def crossfile_pairs(raw: Column) -> Column:
    """A map of path to content from a JSON map or a JSON list of {path, text}; anything else is an empty map. Of a path given twice the last counts."""
    empty = F.create_map().cast("map<string,string>")
    listed = F.from_json(raw, "array<struct<path:string,text:string>>")
    good = F.filter(listed, lambda x: x.isNotNull() & x["path"].isNotNull())
    names = F.array_distinct(F.transform(good, lambda x: x["path"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(good, lambda x: x["path"] == n), -1)["text"]))
    trimmed = F.ltrim(raw)
    return F.coalesce(F.when(trimmed.startswith("{"), F.from_json(raw, "map<string,string>")).when(trimmed.startswith("["), last), empty)


def eval_path(name: str = "repoeval", language: str = "python", base: str = "data") -> str:
    """Where the evaluation set of a name lies. The layout is a fixed value."""
    return f"{base}/{name}/{language}/test.parquet" if name == "repoeval_update" else f"{base}/{name}/test.parquet"


def eval_set(spark: SparkSession, name: str = "repoeval", language: str = "python", most: int = 100, base: str = "data") -> DataFrame:
    """The evaluation rows of a named set in file order, the first ``most`` of them; 0 takes all."""
    df = spark.read.parquet(eval_path(name, language, base))
    return eval_rows(df.withColumn("row_index", F.col("_metadata.row_index")), most, "row_index")


def eval_rows(df: DataFrame, most: int = 0, order: str = "item_id") -> DataFrame:
    """Evaluation rows in one shape: task_id (task_<place> where the column is missing), left_context, right_context, groundtruth (or target_code), crossfile. ``most`` 0 takes all."""
    has = set(df.columns)
    e = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    rows = df.orderBy(order).limit(most) if most > 0 else df
    task = F.col("task_id") if "task_id" in has else F.concat(F.lit("task_"), F.col(order).cast("string"))
    target = e("groundtruth") if "groundtruth" in has else e("target_code")
    raw = crossfile_pairs(F.col("crossfile_context")) if "crossfile_context" in has else F.create_map().cast("map<string,string>")
    return rows.select(order, task.alias("task_id"), e("left_context").alias("left_context"), e("right_context").alias("right_context"), target.alias("groundtruth"), raw.alias("crossfile"))
