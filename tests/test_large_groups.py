"""Groups with very many chunks: as many rows as there are results, not as there are pairs."""

import random

import pytest
from pyspark.sql import functions as F

from codectx.operators import dense, ranking, utility

SYMBOLS = "cid long, grp string, pos long, chunk_type string, tokens array<string>, symbols array<string>"
QUERY = "qid long, grp string, tokens array<string>"


def test_a_token_of_all_chunks_makes_no_pairs(spark):
    c = spark.range(600).select(F.col("id").alias("cid"), F.lit("g").alias("grp"), F.col("id").alias("pos"), F.lit("global").alias("chunk_type"), F.array(F.lit("self")).alias("tokens"), F.array(F.lit("self")).alias("symbols"))
    q = spark.range(50).select(F.col("id").alias("qid"), F.lit("g").alias("grp"), F.array(F.lit("self")).alias("tokens"))
    assert ranking.lexical_scores(q, c, 3).count() == 150
    assert {(r.qid, r.rk, r.cid, r.overlap) for r in ranking.oracle_top_k(q, c, 3).collect()} == {(i, k + 1, k, 1) for i in range(50) for k in range(3)}


@pytest.mark.parametrize("frequent", [4])
def test_best_by_shared_tokens_whatever_is_frequent(spark, monkeypatch, frequent):
    monkeypatch.setattr(ranking, "FREQUENT", frequent, raising=False)
    rng = random.Random(frequent)
    words = [f"w{k}" for k in range(25)]
    pick = lambda most: list({words[min(24, int(rng.expovariate(0.25)))] for _ in range(rng.randrange(most))})
    chunks = [(k, rng.choice("gggh"), k, rng.choice(["method", "global"]), t := pick(6), t) for k in range(90)]
    queries = [(k, rng.choice("gghz"), pick(9)) for k in range(40)]
    c, q = spark.createDataFrame(chunks, SYMBOLS), spark.createDataFrame(queries, QUERY)
    lexical, oracle = set(), set()
    for qid, grp, tokens in queries:
        pool = [(len(set(tokens) & set(x[4])), x[3] == "method", x[0]) for x in chunks if x[1] == grp]
        best = sorted(pool, key=lambda x: (-x[0], -x[1], x[2]) if tokens else x[2])
        lexical |= {(qid, k + 1, x[2]) for k, x in enumerate(best[:5])}
        oracle |= {(qid, k + 1, x[2], x[0]) for k, x in enumerate(sorted((x for x in pool if x[0]), key=lambda x: (-x[0], x[2]))[:3])}
    assert {(r.qid, r.rk, r.cid) for r in ranking.lexical_top_k(q, c, 5).collect()} == lexical
    assert {(r.qid, r.rk, r.cid, r.overlap) for r in ranking.oracle_top_k(q, c, 3).collect()} == oracle


def test_sizes_of_contexts_are_not_computed_for_each_token(spark):
    s = spark.createDataFrame([(1, "a b a", "a c")], "sid long, left_context string, target string")
    c = spark.createDataFrame([(1, "stop", None)], "sid long, strategy string, text string")
    plan = utility.smoothed_unigram_nll(s, c)._jdf.queryExecution().optimizedPlan().toString()
    assert all("array_distinct" not in x.split("\n")[0] for x in plan.split("aggregate(")[1:])


def test_vectors_of_a_group_are_searched_in_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "GROUP_SLICE", 40, raising=False)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 16)
    rng = random.Random(5)
    vec = lambda: [float(rng.randrange(-2, 3)) / 3 for _ in range(4)]  # noqa: E731, many equal products
    vectors, queries = [(k, rng.choice("gggh"), 1000 - k, vec()) for k in range(150)], [(k, rng.choice("gghz"), vec()) for k in range(60)] + [(60, "g", [0.0] * 4)]
    r = dense.group_top_k(spark.createDataFrame(queries, "qid long, grp string, qvec array<double>"), spark.createDataFrame(vectors, "cid long, grp string, pos long, vec array<double>"), 5)
    want = set()
    for qid, grp, x in queries:
        pool = sorted((-round(sum(a * b for a, b in zip(x, y)), 12), pos, cid) for cid, g, pos, y in vectors if g == grp)
        want |= {(qid, k + 1, cid) for k, (_, _, cid) in enumerate(pool[:5])}
    assert {(x.qid, x.rk, x.cid) for x in r.collect()} == want
    assert "zip_with" not in r._jdf.queryExecution().optimizedPlan().toString()  # pairs are no rows
