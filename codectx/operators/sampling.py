"""Sampling and splitting by hashes of seed and key: the same rows whatever the partitioning, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.operators.dense import uniform

#: Shares of the levels at which files are cut. Fixed values.
LEVELS = {"line": 0.70, "block": 0.20, "mixed": 0.10}

def level_shares(shares: dict[str, float]) -> dict[str, float]:
    """Shares that add up to 1; a missing level or a sum that isn't positive is an error."""
    if set(shares) != set(LEVELS) or sum(shares.values()) <= 0:
        raise ValueError(f"shares are needed for {sorted(LEVELS)}")
    total = sum(shares.values())
    return {k: shares[k] / total for k in LEVELS}


def cut_level(u: Column, shares: dict[str, float] | None = None) -> Column:
    """The level that a number in (0, 1) falls on."""
    s = level_shares(shares or LEVELS)
    return F.when(u < s["line"], "line").when(u < s["line"] + s["block"], "block").otherwise("mixed")


def order_key(seed: int, *key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def hash_positions(df: DataFrame, key: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with each row's place from 1, within its group if ``by`` names one, in the order of a hexadecimal hash; ties by nothing (keys must be unique).

    Rows are numbered within slices of the hash and shifted by the slices' counts, so no task holds more than a slice, however large a group is.
    """
    by = by or []
    cut = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    rows = df.withColumn("_h", key).withColumn("_slice", cut)
    counts = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_c")).drop("_c")  # 4,096 rows for each group at most, one for each slice
    inner = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h"))
    placed = rows.withColumn("_inner", inner).join(before if by else F.broadcast(before), [*by, "_slice"])
    return placed.withColumn(name, F.col("_inner") + F.col("_before")).drop("_h", "_slice", "_before", "_inner")


def train_eval_split(df: DataFrame, key: str, ratio: float = 0.1, most: int = 100, seed: int = 13) -> DataFrame:
    """``df`` with ``split``: 'eval' for the first max(1, int(n * ratio)) rows in hash order, ``most`` and n - 1 at most, else 'train'."""
    n = df.count()
    k = min(max(1, int(n * ratio)), most, n - 1) if n >= 2 and ratio > 0 and most > 0 else 0
    placed = hash_positions(df, order_key(seed, F.col(key)), "_place")
    return placed.withColumn("split", F.when(F.col("_place") <= k, "eval").otherwise("train")).drop("_place")


def epoch_batches(df: DataFrame, key: str, epoch: int, size: int = 4, seed: int = 13) -> DataFrame:
    """``df`` with ``batch_no`` from 0: shuffled anew for each epoch, the last batch may be smaller."""
    placed = hash_positions(df, order_key(seed, F.lit(epoch), F.col(key)), "_place")
    return placed.withColumn("batch_no", F.floor((F.col("_place") - 1) / size)).drop("_place")


def one_of_each(df: DataFrame, group: str, key: str, epoch: int, seed: int = 13) -> DataFrame:
    """One row of each group, drawn anew for each epoch: the first in the order of a seeded hash. Keys decide, rows are joined after."""
    h = order_key(seed, F.lit(epoch), F.col(key))
    first = df.groupBy(group).agg(F.min(F.struct(h.alias("h"), F.col(key).alias("k"))).alias("_f")).select(F.col("_f.k").alias(key))
    return df.join(first, key, "left_semi")


def sampled_contexts(ranked: DataFrame, k: int, n: int, seed: int = 13) -> DataFrame:
    """(qid, draw, rk, cid): draw 0 is the top k, the n - 1 others are k of the top max(4k, k + 1), in hash order. A query without candidates has no rows."""
    pool = ranked.filter(F.col("rk") <= max(4 * k, k + 1))
    first = ranked.filter(F.col("rk") <= k).select("qid", F.lit(0).alias("draw"), "rk", "cid")
    if n < 2:
        return first
    drawn = pool.select("qid", "cid", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("draw"))
    order = Window.partitionBy("qid", "draw").orderBy(uniform(seed, F.col("qid"), F.col("draw"), F.col("cid")))
    return first.unionByName(drawn.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).select("qid", "draw", "rk", "cid"))
