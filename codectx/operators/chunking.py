"""Line chunks, chunk ids and texts, pools and fingerprints; all built from expressions, joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.functions.text import identifier_set, lines, strip, text


def chunk_id(path: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.format_string("%s::L%d-%d::%s", path, start, end, kind)


def retrieval_text(path: Column, start: Column, end: Column, kind: Column, parent: Column, body: Column) -> Column:
    head = F.format_string("### File: %s L%d-%d [%s]", path, start, end, kind)
    return strip(F.concat(head, F.when(F.length(parent) > 0, F.concat(F.lit(" class="), parent)).otherwise(F.lit("")), F.lit("\n"), text(body)))


def place_within(group: Column, *order: Column) -> Column:
    """The place of a row in its group from 0; a group is as large as one sample's or file's chunks."""
    return F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1


def line_windows(df: DataFrame, text_col: str, size: int, keep: list[str], newline_only: bool = False) -> DataFrame:
    """``keep`` and (chunk_no, start_line, end_line, text) of windows of ``size`` lines.

    Blank windows stay. An empty text is one empty window of line 1; with ``newline_only`` lines end at LF alone, and a text that
    ends in one has an empty last line.
    """
    if size < 1:
        raise ValueError("a window needs a line")
    own = F.split(text(F.col(text_col)), "\n", -1) if newline_only else lines(F.col(text_col))
    base = df.select(*keep, own.alias("_lines")).withColumn("_n", F.greatest(F.size("_lines"), F.lit(1)))
    at = base.select("*", F.posexplode(F.expr(f"sequence(1, _n, {size})")).alias("chunk_no", "start_line"))
    return at.select(
        *keep, "chunk_no", "start_line", F.least(F.col("start_line") + (size - 1), F.col("_n")).alias("end_line"),
        F.array_join(F.slice("_lines", F.col("start_line"), F.lit(size)), "\n").alias("text"),
    )


def line_runs(df: DataFrame, text_col: str, size: int, key: str, occupied: DataFrame | None = None) -> DataFrame:
    """(key, run_no, start_line, end_line, text, defined_symbols) of maximal runs of non-blank lines, cut every ``size`` lines.

    occupied: (key, start_line, end_line) of ranges whose lines belong to other chunks; they are taken out. The ranges of a file are gathered beside its
    text (there are no more than it has lines); runs are then found within the row, so nothing is shuffled for lines.
    """
    own = df.select(key, lines(F.col(text_col)).alias("_lines"))
    if occupied is not None:
        ranges = occupied.groupBy(key).agg(F.collect_set(F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"))).alias("_taken"))
        own = own.join(ranges, key, "left")
        free = lambda i: ~F.exists(F.coalesce("_taken", F.array().cast("array<struct<s:int,e:int>>")), lambda r: i.between(r["s"] - 1, r["e"] - 1))
        own = own.withColumn("_solid", F.transform("_lines", lambda x, i: (strip(x) != "") & free(i)))
    else:
        own = own.withColumn("_solid", F.transform("_lines", lambda x: strip(x) != ""))
    at = F.sequence(F.lit(0), F.size("_solid") - 1)
    solid = lambda i: F.coalesce(F.get("_solid", i), F.lit(False))
    some = own.withColumn("_s", F.filter(at, lambda i: solid(i) & ~(F.when(i > 0, solid(i - 1)).otherwise(False)))).withColumn("_e", F.filter(at, lambda i: solid(i) & ~solid(i + 1)))
    cuts = F.flatten(F.zip_with("_s", "_e", lambda s, e: F.transform(F.sequence(s, e, F.lit(size)), lambda k: F.struct(k.alias("s"), F.least(e, k + (size - 1)).alias("e")))))
    # the outer form, as Spark would put the whole expression into a filter before the plain one, once for each use of a column
    rows = some.withColumn("_cuts", cuts).select(key, "_lines", F.posexplode_outer("_cuts").alias("_no", "_c")).filter("_c is not null")
    return rows.select(
        key, (F.col("_no") + 1).alias("run_no"), (F.col("_c.s") + 1).alias("start_line"), (F.col("_c.e") + 1).alias("end_line"),
        F.array_join(F.slice("_lines", F.col("_c.s") + 1, F.col("_c.e") - F.col("_c.s") + 1), "\n").alias("text"), identifier_set(F.get("_lines", F.col("_c.s"))).alias("defined_symbols"),
    )


def first_by_id(df: DataFrame, id_cols: list[str], order: list[str]) -> DataFrame:
    """The first row of each id in the given order. A hash aggregate of (order, row) would keep whole rows in its buffers, so keys are decided first and rows joined after."""
    first = df.groupBy(*id_cols).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, id_cols).filter(F.struct(*order) == F.col("_first")).drop("_first")


def fingerprint(df: DataFrame, group: list[str], id_col: str, order: list[str]) -> DataFrame:
    """(group, fingerprint): 16 hexadecimal digits of the SHA-256 of the group's ids, in order, one after the other."""
    ids = F.array_sort(F.collect_list(F.struct(*order, F.col(id_col).alias("_id"))))
    return df.groupBy(*group).agg(F.substring(F.sha2(F.array_join(F.transform(ids, lambda x: x["_id"]), ""), 256), 1, 16).alias("fingerprint"))


def index_fingerprint(df: DataFrame, id_col: str, slices: int = 3) -> DataFrame:
    """One row (fingerprint) for any number of ids: the hash of the hashes of slices, which are the ids whose own hash begins with the same ``slices`` hexadecimal digits.

    Within a slice the ids' hashes are put in their own order, so the fingerprint says which ids there are, however they are stored. No task gathers more than a slice.
    """
    h = df.select(F.sha2(F.coalesce(F.col(id_col), F.lit("")), 256).alias("h")).withColumn("_slice", F.substring("h", 1, slices))
    parts = h.groupBy("_slice").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("p"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_slice", "p"))), lambda x: x["p"]), ""), 256), 1, 16).alias("fingerprint"))


def range_relations(df: DataFrame, key: str, group: list[str], width: int = 64) -> DataFrame:
    """(a, b, contains, overlaps) of different ranges of one group that touch: a contains b, or they share more than an end.

    Ranges meet in bins of ``width`` lines, and a pair in the first bin that both are in, so a file of very many ranges isn't compared with itself as a whole.
    """
    base = df.select(*group, F.col(key).alias("k"), F.col("start_line").alias("s"), (F.col("end_line") + 1).alias("e")).filter("s is not null and e is not null and e > s")
    first = F.floor(F.col("s") / width)
    binned = base.withColumn("first", first).withColumn("bin", F.explode(F.sequence(first, F.floor((F.col("e") - 1) / width))))
    a, b = binned.alias("a"), binned.alias("b")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in (*group, "bin")]
    on = same + [F.col("a.bin") == F.greatest("a.first", "b.first"), F.col("a.k") != F.col("b.k"), F.greatest("a.s", "b.s") < F.least("a.e", "b.e")]
    return a.join(b, on).select(
        F.col("a.k").alias("a"), F.col("b.k").alias("b"), ((F.col("a.s") <= F.col("b.s")) & (F.col("a.e") >= F.col("b.e"))).alias("contains"), F.lit(True).alias("overlaps")
    )
