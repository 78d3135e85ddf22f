"""Dense retrieval over vector tables: normalised vectors, exact top-k in blocks, lookups, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.operators.ranking import top_k

NORM_FLOOR = 1e-8
#: Numbers of query vectors that a task holds; more queries are searched block by block.
QUERY_BLOCK = 4096
#: Vectors of a group that a task holds.
GROUP_SLICE = 16_384


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Divided by its length, which counts as 1e-8 at least."""
    # lists of one, as their element is computed once, while v and its length would be computed anew for each value of v
    sized = lambda w: F.array(F.struct(w.alias("v"), F.greatest(norm(w), F.lit(NORM_FLOOR)).alias("n")))
    return F.transform(F.array(v), lambda w: F.transform(sized(w), lambda o: F.transform(o["v"], lambda x: x.cast("double") / o["n"]))[0])[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def group_top_k(queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rk, cid, score): the k largest inner products of each query (qid, grp, qvec) with the vectors (cid, grp, vec, pos) of its group, a sample's own candidates; ties by position.

    A group is cut into blocks of queries and slices of vectors, and each block meets each slice in a task that multiplies them and keeps what can be among a query's k best, so pairs are no
    rows and a large group is no single task. What has no vector takes no part.
    """
    q, v = queries.filter("qvec is not null"), vectors.filter("vec is not null")
    slices = v.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_SLICE).cast("int").alias("slices"))
    blocks = q.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    cells = slices.join(blocks, "grp")
    left = q.join(cells, "grp").select("grp", F.expr("cast(pmod(xxhash64(qid), blocks) as int)").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("qid").cast("long").alias("qid"), "qvec")
    right = v.join(cells, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.expr("cast(pmod(xxhash64(cid), slices) as int)").alias("slice"), F.col("cid").cast("long").alias("cid"), F.col("pos").cast("long").alias("pos"), "vec")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found = best_pairs(matrix_of(a["qvec"]), matrix_of(b["vec"]), b["pos"].to_numpy(), k) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        i, j, score = found
        return pa.table({"qid": a["qid"].take(pa.array(i)), "cid": b["cid"].take(pa.array(j)), "pos": b["pos"].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    keys = ("grp", "block", "slice")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "qid long, cid long, pos long, score double")
    return top_k(found, k, [F.desc(F.round("score", 12)), F.asc("pos")]).select("qid", "rk", "cid", "score")


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])


def best_pairs(a: np.ndarray, b: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, inner product) of all that can be among the k best rows of b for a row of a by the product rounded to 12 decimals, then ``pos``.

    The matrix product may differ in the last bits from a sum in order, so what is near the edge is summed again.
    """
    m, out = min(max(0, k), len(b)), []
    slack = 1e-9 + 1e-12 * np.linalg.norm(a, axis=1) * (np.linalg.norm(b, axis=1).max() if len(b) else 0)
    step = max(1, 2**22 // max(1, len(b)))
    for at in range(0, len(a) if m else 0, step):
        s = a[at : at + step] @ b.T
        edge = np.partition(s, len(b) - m, axis=1)[:, len(b) - m]
        i, j = np.nonzero(s >= (edge - slack[at : at + step])[:, None])
        exact = np.zeros(len(i))
        for d in range(a.shape[1]):
            exact += a[at + i, d] * b[j, d]
        order = np.lexsort((pos[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        new = np.r_[True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])]
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))  # among equal products of the row
        keep = (place < k) & (exact >= exact[first + m - 1] - 2e-12)
        out.append((at + i[keep], j[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, skip_self: bool = False) -> DataFrame:
    """(qid, rk, cid, score): the k largest inner products of each query (qid, qvec) with all vectors (cid, vec, pos); ties by position.

    A stated set of queries is searched against all vectors: blocks of at most QUERY_BLOCK queries are broadcast, each task multiplies its
    vectors with them and keeps k for each query, and only these are shuffled.
    """
    spark = vectors.sparkSession
    n = queries.count()
    found = None
    for block in range(max(1, -(-n // QUERY_BLOCK))):
        rows = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(-(-n // QUERY_BLOCK) or 1)) == block).select("qid", "qvec").toArrow().to_pandas() if n else pd.DataFrame({"qid": [], "qvec": []})
        ids = rows["qid"].to_numpy(np.int64)
        matrix = np.stack([np.asarray(v, np.float64) for v in rows["qvec"]]) if len(rows) else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            keep: list[pd.DataFrame] = []
            for b in batches:
                if not len(ids) or not len(b):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in b["vec"]])
                cid, pos = b["cid"].to_numpy(), b["pos"].to_numpy()
                s = matrix @ x.T
                if skip_self:
                    s[ids[:, None] == cid[None, :]] = -np.inf
                m = min(k, len(cid))
                edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                # the matrix product may differ in the last bits from one vector's; near the edge everything is kept
                q, c = np.nonzero((s >= edge[:, None] - 1e-9) & (s > -np.inf))
                exact = np.einsum("ij,ij->i", matrix[q], x[c])
                keep.append(pd.DataFrame({"qid": ids[q], "cid": cid[c], "pos": pos[c], "score": exact}))
                if len(keep) > 8:
                    keep = [cut(pd.concat(keep))]
            yield cut(pd.concat(keep)) if keep else pd.DataFrame({"qid": [], "cid": [], "pos": [], "score": []})

        def cut(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.assign(r=rows["score"].round(12)).sort_values(["qid", "r", "pos"], ascending=[True, False, True], kind="stable").drop(columns="r")
            return rows[rows.groupby("qid").cumcount() < k + 8]

        part = vectors.select("cid", "vec", "pos").mapInPandas(best, "qid long, cid long, pos long, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, [F.desc(F.round("score", 12)), F.asc("pos")]).select("qid", "rk", "cid", "score")


def vectors_by_id(ids: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, found, vec) for each row of ids (id); an unknown id has the zero vector. vectors: cid, vec."""
    v = vectors.select(F.col("cid").alias("id"), "vec")
    return ids.join(v, "id", "left").select("id", F.col("vec").isNotNull().alias("found"), F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("vec"))


def mean_similarity(pairs: DataFrame, by: str = "qid") -> DataFrame:
    """(by, mean_sim): the mean score of each query's retrieved set."""
    return pairs.groupBy(by).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_sim"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and key only, and can be had in any SQL engine."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def temperature_sample(scores: DataFrame, temperatures: list[float], k: int, seed: int) -> DataFrame:
    """(qid, draw, rk, cid): k candidates a draw without replacement, with probabilities softmax(score / temperature), by Gumbel noise.

    Draw 0.. are the temperatures in order; one below 1e-6 takes the k best. scores: qid, cid, score.
    """
    draws = F.array(*(F.lit(float(x)) for x in temperatures))
    rows = scores.select("qid", "cid", "score", F.posexplode(draws).alias("draw", "temperature"))
    noise = -F.ln(-F.ln(uniform(seed, F.col("qid"), F.col("draw"), F.col("cid"))))
    key = F.when(F.col("temperature") < 1e-6, F.col("score")).otherwise(F.col("score") / F.greatest(F.col("temperature"), F.lit(1e-6)) + noise)
    ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy("qid", "draw").orderBy(F.desc(key), F.asc("cid"))))
    return ranked.filter(F.col("rk") <= k).select("qid", "draw", "rk", "cid")


def cached_top_k(queries: DataFrame, candidates: DataFrame, cache: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(qid, rk, cid, score, cached): a query uses cached vectors if all its candidates have one, else live vectors for all of them.

    queries: qid, qvec; candidates: qid, cid, pos; cache and live: cid, vec.
    """
    both = candidates.join(cache.select("cid", F.col("vec").alias("c")), "cid", "left").join(live.select("cid", F.col("vec").alias("l")), "cid", "left")
    whole = both.withColumn("cached", F.count_if(F.col("c").isNull()).over(Window.partitionBy("qid")) == 0)
    scored = whole.join(queries, "qid").select("qid", "cid", "pos", "cached", dot(F.col("qvec"), F.when(F.col("cached"), F.col("c")).otherwise(F.col("l"))).alias("score"))
    return top_k(scored, k, [F.desc("score"), F.asc("pos")]).select("qid", "rk", "cid", "score", "cached")


def combined_score(gate: Column, similarity: Column, is_stop: Column) -> Column:
    """The gate's log probability of stopping for the empty context, else that of going on and the mean similarity."""
    p = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), gate))
    return F.when(is_stop, F.ln(1 - p)).otherwise(F.ln(p) + similarity)
