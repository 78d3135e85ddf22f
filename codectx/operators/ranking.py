"""Lexical retrieval: token overlap, learned weights, prefixes; top-k, oracle and hard negatives.

Queries meet chunks in an equi-join on the candidates' group (a repository, or one constant for a global pool) and token,
so no pair without a common token is formed. Chunks without overlap can only win by their type bonus and order; of these, k for each
group are enough. So it is with chunks that share only tokens which very many chunks of the group have: of those with the same such
tokens, k are enough (``contenders``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Signals of the lexical score. Fixed values.
OVERLAP, TYPE_BONUS, PREFIX_BONUS = 1.5, 0.15, 2.0
BONUS_TYPES = ("method", "function", "class_header")
#: A token of more chunks of a group than these is frequent there; pairs that share no other are not formed one by one.
FREQUENT = 500
#: Groups that queries and chunks have in common are broadcast up to this number, joined as any other table beyond.
MOST_GROUPS = 100_000
LEXICAL, ORACLE, CONTEXT = ("defined_symbols", "used_symbols", "call_names"), ("defined_symbols", "call_names", "method_names"), ("defined_symbols", "call_names")


def symbol_set(columns: tuple[str, ...]) -> Column:
    """Distinct non-null symbols of several columns, in order; null columns are empty."""
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns))))


def type_bonus(kind: Column) -> Column:
    return F.when(kind.isin(*BONUS_TYPES), TYPE_BONUS).otherwise(0.0)


def overlaps(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, cid, n): distinct tokens that a query and a chunk of its group share. queries: qid, grp, tokens; chunks: cid, grp, tokens."""
    q = queries.select("qid", "grp", F.explode(F.array_distinct("tokens")).alias("token"))
    c = chunks.select("cid", "grp", F.explode("tokens").alias("token"))
    return q.join(c, ["grp", "token"]).groupBy("qid", "cid").agg(F.count("*").alias("n"))


def contenders(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, cid, n): every chunk that can be among a query's k best by shared tokens, then ``bonus`` (larger first), then ``pos``; n is the number of shared tokens, which may be 0.

    queries: qid, grp, tokens; chunks: cid, grp, pos, bonus, tokens. A pair that shares a token which isn't frequent in the group is met in a join on that token. Any other pair is known by the
    two sets of frequent tokens: of each such set of chunks the k first stand for all, of each such set of queries one is searched for, and a chunk that is not among the k best by frequent
    tokens has k before it by all tokens, as these can only add to what those share.
    """
    groups = chunks.select("grp").distinct().join(queries.select("grp").distinct(), "grp")
    small = F.broadcast if groups.count() <= MOST_GROUPS else lambda df: df
    own = chunks.select("cid", "grp", "pos", "bonus", F.array_distinct("tokens").alias("tokens")).join(small(groups), "grp")
    asked = queries.select("qid", "grp", F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")).alias("tokens"))
    many = own.select("grp", F.explode("tokens").alias("token")).groupBy("grp", "token").agg(F.count("*").alias("n")).filter(F.col("n") > FREQUENT)
    known = small(groups.join(many.groupBy("grp").agg(F.collect_list("token").alias("_known")), "grp", "left").select("grp", F.coalesce("_known", F.array().cast("array<string>")).alias("_known")))

    def parted(df: DataFrame) -> DataFrame:
        return df.join(known, "grp").withColumn("often", F.array_sort(F.array_intersect("tokens", "_known"))).withColumn("rare", F.array_except("tokens", "_known")).drop("tokens", "_known")

    own, asked = parted(own), parted(asked)
    met = asked.select("qid", "grp", "often", F.explode("rare").alias("token")).join(own.select("cid", "grp", F.col("often").alias("_often"), F.explode("rare").alias("token")), ["grp", "token"])
    both = met.select("qid", "cid", F.size(F.array_intersect("often", "_often")).alias("m")).groupBy("qid", "cid").agg((F.count("*") + F.max("m")).alias("n"))
    order = [F.desc("bonus"), F.asc("pos")]
    heads = top_k(own.select("cid", "grp", "pos", "bonus", "often"), k, order, ["grp", "often"]).drop("rk")
    kinds = asked.select("grp", "often").distinct()
    alike = kinds.select("grp", "often", F.explode("often").alias("token")).join(heads.select("cid", "grp", "pos", "bonus", F.explode("often").alias("token")), ["grp", "token"])
    none = kinds.join(top_k(heads, k, order, "grp").select("grp", "cid", "pos", "bonus"), "grp").withColumn("m", F.lit(0))
    each = alike.select("grp", "often", "cid", "pos", "bonus", F.lit(1).alias("m")).unionByName(none).groupBy("grp", "often", "cid", "pos", "bonus").agg(F.sum("m").alias("n"))
    best = top_k(each, k, [F.desc("n"), *order], ["grp", "often"]).select("grp", "often", "cid", "n")
    rest = asked.select("qid", "grp", "often").join(best, ["grp", "often"]).select("qid", "cid", "n")
    return both.unionByName(rest).groupBy("qid", "cid").agg(F.max("n").alias("n"))


def top_k(scored: DataFrame, k: int, order: list[Column], by: str | list[str] = "qid") -> DataFrame:
    """The k best of each query with their rank ``rk`` from 1; Spark limits each group before and after the shuffle."""
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rk") <= max(0, k))


def best_without_overlap(queries: DataFrame, chunks: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """(qid, cid, n = 0): the first k chunks of each query's group in the order that holds among chunks without overlap."""
    first = top_k(chunks.select("grp", "cid", *(c for c in chunks.columns if c not in ("grp", "cid", "tokens"))), k, order, "grp")
    return queries.select("qid", "grp").join(first.select("grp", "cid"), "grp").select("qid", "cid", F.lit(0).cast("long").alias("n"))


def lexical_scores(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, cid, pos, score) of every chunk that can be among a query's k best. chunks: cid, grp, pos, chunk_type, tokens."""
    every = contenders(queries, chunks.withColumn("bonus", type_bonus(F.col("chunk_type"))), k)
    meta = chunks.select("cid", "pos", "chunk_type")
    return every.join(meta, "cid").select("qid", "cid", "pos", (OVERLAP * F.col("n") + type_bonus(F.col("chunk_type"))).alias("score"))


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rk, cid, score). Ties go by position. A query without tokens gets the first k chunks of its group, as they stand, with score 0."""
    some = queries.filter(F.size("tokens") > 0)
    none = queries.filter(F.coalesce(F.size("tokens"), F.lit(0)) <= 0)
    ranked = top_k(lexical_scores(some, chunks, k), k, [F.desc("score"), F.asc("pos")])
    first = best_without_overlap(none, chunks, k, [F.asc("pos")]).join(chunks.select("cid", "pos"), "cid").withColumn("score", F.lit(0.0))
    return ranked.select("qid", "rk", "cid", "score").unionByName(top_k(first, k, [F.asc("pos")]).select("qid", "rk", "cid", "score"))


def proxy_top_k(queries: DataFrame, chunks: DataFrame, weights: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rk, cid, score) by overlap, learned weights of the chunk's tokens, a prefix bonus and the type bonus; ties by chunk id, descending.

    queries: qid, grp, tokens, prefix. chunks: cid, grp, chunk_id, chunk_type, tokens, symbols. weights: token, w.
    A chunk without overlap can win by its weights or by a symbol that begins with the prefix; prefixes are joined on their first three
    characters (shorter ones on what they have) before they are compared.
    """
    learned = chunks.select("cid", F.explode("tokens").alias("token")).join(weights, "token").groupBy("cid").agg(F.sum("w").alias("learned"))
    base = chunks.join(learned, "cid", "left").select(
        "cid", "grp", "chunk_id", (F.coalesce("learned", F.lit(0.0)) + type_bonus(F.col("chunk_type"))).alias("own")
    )
    short = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("symbol")))).alias("width")
    begins = chunks.select("cid", "grp", F.explode(F.array_distinct("symbols")).alias("symbol")).filter("symbol <> ''").select("cid", "grp", "symbol", short).select("cid", "grp", "symbol", F.expr("substr(symbol, 1, width)").alias("head"), "width").distinct()
    asked = queries.filter("prefix <> ''").select("qid", "grp", "prefix", F.substring("prefix", 1, 3).alias("head"), F.least(F.lit(3), F.length("prefix")).alias("width"))
    prefixed = asked.join(begins, ["grp", "head", "width"]).filter("startswith(symbol, prefix)").select("qid", "cid").distinct().withColumn("p", F.lit(PREFIX_BONUS))
    hit = overlaps(queries, chunks).withColumn("p", F.lit(0.0))
    rest = best_without_overlap(queries, base.withColumn("tokens", F.lit(None)), k, [F.desc("own"), F.desc("chunk_id"), F.desc("cid")]).withColumn("p", F.lit(0.0))
    every = hit.unionByName(rest).unionByName(prefixed.withColumn("n", F.lit(0).cast("long")).select("qid", "cid", "n", "p")).groupBy("qid", "cid").agg(F.max("n").alias("n"), F.max("p").alias("p"))
    scored = every.join(base, "cid").select("qid", "cid", "chunk_id", (OVERLAP * F.col("n") + F.col("own") + F.col("p")).alias("score"))
    return top_k(scored, k, [F.desc("score"), F.desc("chunk_id"), F.desc("cid")]).select("qid", "rk", "cid", "score")


def oracle_top_k(targets: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rk, cid, overlap) of chunks whose symbols hit the target; none where nothing hits. targets: qid, grp, tokens; chunks: cid, grp, pos, symbols."""
    every = contenders(targets, chunks.select("cid", "grp", "pos", F.lit(0.0).alias("bonus"), F.col("symbols").alias("tokens")), k)
    hit = every.filter("n > 0").join(chunks.select("cid", "pos"), "cid")
    return top_k(hit, k, [F.desc("n"), F.asc("pos")]).select("qid", "rk", "cid", F.col("n").alias("overlap"))


def hard_negatives(ranked: DataFrame, targets: DataFrame, chunks: DataFrame, k: int = 3, most: int = 10) -> DataFrame:
    """(qid, rk, cid): of a query's ranked pool (qid, rk, cid), the first that share no symbol with the target, ``most`` and then k at most.

    A query whose target has no identifiers has none.
    """
    asked = ranked.join(targets.filter(F.size("tokens") > 0).select("qid"), "qid", "left_semi")
    q = targets.select("qid", F.explode("tokens").alias("token"))
    c = chunks.select("cid", F.explode("symbols").alias("token"))
    touched = asked.select("qid", "cid").join(q, "qid").join(c, ["cid", "token"]).select("qid", "cid").distinct()
    free = asked.join(touched, ["qid", "cid"], "left_anti").withColumnRenamed("rk", "_rk")
    return top_k(free, min(k, most), [F.asc("_rk")]).select("qid", "rk", "cid")
