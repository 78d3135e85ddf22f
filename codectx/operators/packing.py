"""Packing contexts into budgets of characters or tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.functions.text import strip, text

#: Budget of a prompt: all tokens, those of the soft prompt, headroom, most of the left context, least worth keeping of a cut chunk. Fixed values.
TOKENS, PROMPT, HEADROOM, LEFT, LEAST = 4096, 50, 256, 1500, 20


def crossfile_pack(files: DataFrame, key: str, most: int) -> DataFrame:
    """(key, included, truncated, context): blocks of files, short ones first, until ``most`` characters; the first that doesn't fit is cut if its header fits, and ends the context.

    files: key, path, content. Equal lengths go by path.
    """
    head = F.format_string("### File: %s ###\n", F.col("path"))
    rows = files.select(key, "path", text(F.col("content")).alias("content")).withColumn("head", head)
    order = Window.partitionBy(key).orderBy(F.length("content"), "path")
    ran = rows.withColumn("size", F.length("head") + F.length("content") + 2).withColumn("end", F.sum("size").over(order)).withColumn("pos", F.row_number().over(order))
    fits = F.col("end") <= most
    room = most - (F.col("end") - F.col("size"))
    first_over = ~fits & (room >= 0) & (F.col("end") - F.col("size") <= most)
    cut = first_over & (room > F.length("head"))
    kept = ran.withColumn("fits", fits).withColumn("cut", cut).withColumn("prior", F.min(F.when(~fits, F.col("pos"))).over(Window.partitionBy(key)))
    used = kept.filter(F.col("fits") & (F.col("prior").isNull() | (F.col("pos") < F.col("prior"))) | F.col("cut") & (F.col("pos") == F.col("prior")))
    block = F.concat("head", F.when(F.col("fits"), F.col("content")).otherwise(F.expr(f"substr(content, 1, cast({most} - (end - size) - length(head) as int))")), F.lit("\n\n"))
    packed = used.groupBy(key).agg(
        F.count_if("fits").alias("included"), F.count_if(~F.col("fits")).alias("truncated"),
        F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("blocks"),
    )
    whole = strip(F.array_join(F.transform("blocks", lambda x: x["b"]), ""))
    every = files.select(key).distinct()
    return every.join(packed.select(key, "included", "truncated", whole.alias("context")), key, "left").select(
        key, F.coalesce("included", F.lit(0)).alias("included"), F.coalesce("truncated", F.lit(0)).alias("truncated"), F.coalesce("context", F.lit("")).alias("context")
    )


def budget(left_tokens: Column, most: int = TOKENS) -> Column:
    """Tokens that chunks may take beside a left context."""
    return F.greatest(F.lit(0), F.lit(most - PROMPT - HEADROOM) - F.least(left_tokens, F.lit(LEFT)))


def token_budget(chunks: DataFrame, most: int = TOKENS) -> DataFrame:
    """(qid, rk, n_tokens, taken) of the chunks of each query that are taken into its prompt, in rank order; the first that doesn't fit is cut if more than 20 tokens are left for it, and ends the packing.

    chunks: qid, rk, left_tokens, n_tokens.
    """
    order = Window.partitionBy("qid").orderBy("rk")
    ran = chunks.withColumn("end", F.sum("n_tokens").over(order)).withColumn("room", budget(F.col("left_tokens"), most))
    over = F.min(F.when(F.col("end") > F.col("room"), F.col("rk"))).over(Window.partitionBy("qid"))
    left = F.col("room") - (F.col("end") - F.col("n_tokens"))
    return ran.withColumn("over", over).withColumn(
        "taken", F.when(F.col("over").isNull() | (F.col("rk") < F.col("over")), F.col("n_tokens")).when((F.col("rk") == F.col("over")) & (left > LEAST), left).otherwise(0)
    ).filter("taken > 0 or (n_tokens = 0 and (over is null or rk < over))").select("qid", "rk", "n_tokens", "taken")
