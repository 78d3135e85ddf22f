import math
import random

import pytest
from pyspark.sql import functions as F

from codectx.operators import dense, evaluation, intent, packing, ranking, sampling, strategies, utility
from codectx.plans import config, proxy
from codectx.sources import readers, sinks
from codectx.storage import written

CHUNKS = "cid long, grp string, pos long, chunk_id string, chunk_type string, text string, defined_symbols array<string>, used_symbols array<string>, call_names array<string>, method_names array<string>"


def chunk_frame(spark, rows):
    df = spark.createDataFrame(rows, CHUNKS)
    return df.withColumn("tokens", ranking.symbol_set(ranking.LEXICAL)).withColumn("symbols", ranking.symbol_set(ranking.ORACLE))


def random_chunks(rng, n):
    pick = lambda k: [rng.choice(["alpha", "beta", "gamma", "delta", "eps", None]) for _ in range(rng.randrange(k))]
    return [(i, rng.choice("gh"), i, f"c{i % 7}", rng.choice(["method", "global", "fallback"]), "t", rng.choice([None, pick(3)]), pick(4), pick(3), rng.choice([None, pick(2)])) for i in range(n)]


def test_lexical_ranking_is_what_scoring_every_pair_gives(spark):
    rng = random.Random(1)
    rows = random_chunks(rng, 60)
    queries = [(k, rng.choice("ghz"), [rng.choice(["alpha", "beta", "gamma", "zeta"]) for _ in range(rng.randrange(4))], rng.choice(["", "al", "gamma", "alph"])) for k in range(20)]
    q = spark.createDataFrame(queries, "qid long, grp string, tokens array<string>, prefix string")
    c = chunk_frame(spark, rows)
    sets = {r[0]: {x for a in (r[6], r[7], r[8]) for x in a or [] if x} for r in rows}
    bonus = {r[0]: 0.15 if r[4] == "method" else 0.0 for r in rows}
    want, proxied = set(), set()
    w = {"alpha": -0.4, "delta": 3.1}
    for k, g, toks, prefix in queries:
        pool = [r for r in rows if r[1] == g]
        score = {r[0]: (1.5 * len(set(toks) & sets[r[0]]) + bonus[r[0]]) if toks else 0.0 for r in pool}
        want |= {(k, i + 1, cid) for i, cid in enumerate(sorted(score, key=lambda x: (-score[x], x))[:3])}
        s = {}
        for r in pool:
            names = [x for a in (r[6], r[8], r[9]) for x in a or [] if x]
            s[r[0]] = 1.5 * len(set(toks) & sets[r[0]]) + bonus[r[0]] + sum(w.get(x, 0) for x in sets[r[0]]) + (2.0 if prefix and any(x.startswith(prefix) for x in names) else 0.0)
        ids = {r[0]: r[3] for r in pool}
        proxied |= {(k, i + 1, cid) for i, cid in enumerate(sorted(s, key=lambda x: (round(s[x], 9), ids[x], x), reverse=True)[:3])}
    assert {(r.qid, r.rk, r.cid) for r in ranking.lexical_top_k(q, c, 3).collect()} == want
    weights = spark.createDataFrame(list(w.items()), "token string, w double")
    assert {(r.qid, r.rk, r.cid) for r in ranking.proxy_top_k(q, c, weights, 3).collect()} == proxied
    assert ranking.lexical_top_k(q.limit(0), c, 3).collect() == [] and ranking.lexical_top_k(q, c.limit(0), 3).collect() == []


def test_oracle_and_hard_negatives(spark):
    c = chunk_frame(spark, [(1, "g", 1, "a", "method", "", ["x"], ["y"], ["f"], []), (2, "g", 2, "b", "method", "", ["z"], ["x"], [], None), (3, "g", 3, "c", "global", "", None, None, None, None)])
    t = spark.createDataFrame([(1, "g", ["x", "f"]), (2, "g", []), (3, "g", ["q"])], "qid long, grp string, tokens array<string>")
    assert [(r.qid, r.rk, r.cid, r.overlap) for r in ranking.oracle_top_k(t, c).collect()] == [(1, 1, 1, 2)]
    ranked = spark.createDataFrame([(q, i, i) for q in (1, 2, 3) for i in (1, 2, 3)], "qid long, rk int, cid long")
    assert {(r.qid, r.rk, r.cid) for r in ranking.hard_negatives(ranked, t, c).collect()} == {(1, 1, 2), (1, 2, 3), (3, 1, 1), (3, 2, 2), (3, 3, 3)}


def test_dense(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 3, [0.5, 0.5]), (4, 4, [0.0, 1.0])], "cid long, pos long, vec array<double>")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "qid long, qvec array<double>")
    assert [(r.rk, r.cid) for r in dense.dense_top_k(q, v, 3).orderBy("rk").collect()] == [(1, 2), (2, 4), (3, 3)]
    assert dense.dense_top_k(q.limit(0), v, 3).collect() == [] and dense.dense_top_k(q, v.limit(0), 3).collect() == []
    got = {r.id: (r.found, r.vec) for r in dense.vectors_by_id(spark.createDataFrame([(1,), (7,)], "id long"), v, 2).collect()}
    assert got == {1: (True, [1.0, 0.0]), 7: (False, [0.0, 0.0])}
    cand = spark.createDataFrame([(9, 1, 1), (9, 2, 2), (8, 1, 1)], "qid long, cid long, pos long")
    qs = spark.createDataFrame([(9, [0.0, 1.0]), (8, [1.0, 0.0])], "qid long, qvec array<double>")
    out = {(r.qid, r.cid): r.cached for r in dense.cached_top_k(qs, cand, v.filter("cid = 1"), v, 2).collect()}
    assert out == {(9, 1): False, (9, 2): False, (8, 1): True}
    cold = {(r.draw, r.rk, r.cid) for r in dense.temperature_sample(v.select(F.lit(1).alias("qid"), "cid", F.col("pos").cast("double").alias("score")), [0.0, 5.0], 2, 3).collect()}
    assert {(0, 1, 4), (0, 2, 3)} < cold and len(cold) == 4


def test_intent_scope_and_gate(spark):
    left = "from services import UserService\n\nservice = UserService(db)\nuser = service.fetch_"
    s = intent.with_sketch(spark.createDataFrame([(left, 1), ("", 1), (None, 1)], "x string, _lines int"), "x").select("sketch.*").collect()
    assert (s[0].prefix, s[0].member_owner, s[0].member_prefix) == ("fetch_", "service", "fetch_") and "UserService" in s[0].class_hints and "services" in s[0].import_hints and "member_owner: service" in s[0].query
    assert s[1].query == s[2].query == "### Intent sketch\n### Left context tail"
    code = "import os\nclass A(B):\n    def f(self, a, *b: int, c=1):\n        x = a\n        for y in b:\n            z == y\n"
    df = spark.createDataFrame([(code, 5), (code, 0), (code, 99), ("", 3), (None, 1)], "x string, c int")
    out = intent.with_scope(df, "x", "c").select("scope.*", intent.scope_prompt(F.col("scope"), F.lit("p.py")).alias("p")).collect()
    assert out[0].parent_class == "class A(B):" and out[0].parent_function == "    def f(self, a, *b: int, c=1):" and out[0].local_variables == ["a", "*b", "c", "x", "y"] and out[0].cursor_line == 5
    assert out[1].cursor_line == 1 and out[1].parent_class is None and out[2].cursor_line == 6 and out[3].imports == [] and out[0].p.startswith("[Path]\np.py\n\n[Imports]\nimport os\n\n[Current scope]\n    def f")
    g = spark.createDataFrame([(left,), ("x",), ("  ",), (None,)], "x string").select(*intent.gate_features(F.col("x")), intent.gate_probability(F.col("x")), intent.gate_decision(F.col("x"), "rule")).collect()
    assert tuple(g[0])[:2] == (1.0, 1.0) and g[0][3] == pytest.approx(1 / (1 + math.exp(-0.7))) and [r[4] for r in g] == [True, False, False, False]
    with pytest.raises(ValueError):
        intent.gate_decision(F.col("x"), "other")


def test_utilities_pairs_and_labels(spark):
    rows = [(1, "stop", 0, True, 10.0), (1, "helpful", 1, False, 4.0), (1, "noisy", 2, False, 12.0), (2, "stop", 0, True, 5.0), (2, "a", 1, False, 5.0), (3, "stop", 0, True, 1.0)]
    ranked = utility.utilities(spark.createDataFrame(rows, "sid long, strategy string, pos int, is_stop boolean, nll double"))
    assert [(r.strategy, r.utility) for r in ranked.filter("sid = 1").orderBy("rk").collect()] == [("helpful", 6.0), ("stop", 0.0), ("noisy", -2.0)]
    assert {(r.sid, r.chosen, r.rejected, r.gap) for r in utility.preference_pairs(ranked, 6.0).collect()} == {(1, "helpful", "stop", 6.0), (1, "helpful", "noisy", 8.0)}
    assert utility.preference_pairs(ranked, 0.1, 0).count() == 1
    assert {r.sid: (r.retrieve_is_better, r.best_strategy) for r in utility.gate_labels(ranked).collect()} == {1: (True, "helpful"), 2: (False, "a")}
    assert tuple(utility.gate_counts(utility.gate_labels(ranked)).first()) == (1, 1, 0.5, 3.0)


def test_unigram_scorer_and_leave_one_out(spark):
    s = spark.createDataFrame([(1, "a b a", "a c"), (2, "x", ""), (3, None, "q")], "sid long, left_context string, target string")
    c = spark.createDataFrame([(1, "stop", None), (1, "bm25", "c c"), (1, "bm25", "c d"), (2, "stop", None), (3, "stop", None)], "sid long, strategy string, text string")
    nll = {(r.sid, r.strategy): r.nll for r in utility.smoothed_unigram_nll(s, c).collect()}
    assert nll[1, "stop"] == pytest.approx((-math.log(3 / 6) - math.log(1 / 6)) / 2) and nll[1, "bm25"] == pytest.approx((-math.log(3 / 11) - math.log(4 / 11)) / 2) and nll[2, "stop"] == 0.0 and nll[3, "stop"] == 0.0
    loo = spark.createDataFrame([(1, "full", 4.0), (1, "without 1", 8.0), (1, "without 2", 3.0)], "sid long, strategy string, nll double")
    assert tuple(utility.leave_one_out(loo).first()) == (1, 2, 1, 1, 1.5, 0.5)
    sets = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "z")], "sid long, rk int, text string")
    assert {(r.sid, r.strategy, r.text) for r in utility.without_each(sets).collect()} == {(1, "full", "a"), (1, "full", "b"), (1, "without 1", "b"), (1, "without 2", "a")}
    one = spark.range(1).select(utility.dpo_loss(F.lit(0.3), F.lit(0.1), F.lit(0.3), F.lit(0.1)), utility.gate_loss(F.lit(0.5), F.lit(True))).first()
    assert one[0] == pytest.approx(math.log(2)) and one[1] == pytest.approx(math.log(2) - 0.01 * math.log(2))


def test_evaluation(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.2), (False, 0.8), (False, 0.1), (None, 0.4)], "l boolean, p double")
    assert tuple(evaluation.gate_metrics(df, F.col("l"), F.col("p")).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 4)
    assert evaluation.auc(df, F.col("l"), F.col("p")).first()[0] == 0.75
    assert evaluation.auc(df.filter("l"), F.col("l"), F.col("p")).first()[0] is None and evaluation.auc(df.limit(0), F.col("l"), F.col("p")).first()[0] is None
    rng = random.Random(2)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(300)]
    pos, neg = [p for a, p in rows if a], [p for a, p in rows if not a]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluation.auc(spark.createDataFrame(rows, "l boolean, p double"), F.col("l"), F.col("p")).first()[0] == pytest.approx(want)
    xy = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0), ("c", None, 3.0)], "g string, x double, y double")
    assert {r[0]: r[1] for r in xy.groupBy("g").agg(evaluation.safe_corr(F.col("x"), F.col("y"))).collect()} == {"a": pytest.approx(1.0), "b": 0.0, "c": 0.0}
    for f1, status in ((0.79, "compute_reduction_without_quality_loss"), (0.78, "gate_claim_not_supported")):
        p = spark.createDataFrame([("learned", 0.50, 0.70, f1, 0.40), ("always_retrieve", 0.51, 0.71, 0.80, 0.70)], "policy string, em double, edit double, f1 double, rate double")
        assert evaluation.gate_claim(p).first().status == status


def test_splits_batches_and_budgets(spark):
    ids = spark.range(101).withColumnRenamed("id", "k")
    for n, want in ((0, 0), (1, 0), (2, 1), (10, 1), (101, 10)):
        assert sampling.train_eval_split(ids.limit(n), "k").filter("split = 'eval'").count() == want
    a = {r.k: r.batch_no for r in sampling.epoch_batches(ids, "k", 0).collect()}
    assert sorted(a.values()) == sorted(i // 4 for i in range(101)) and a != {r.k: r.batch_no for r in sampling.epoch_batches(ids, "k", 1).collect()}
    assert a == {r.k: r.batch_no for r in sampling.epoch_batches(ids.repartition(7), "k", 0).collect()}
    with pytest.raises(ValueError):
        sampling.level_shares({"line": 1.0})
    files = spark.createDataFrame([(1, "b", "xx"), (1, "a", "xx"), (1, "c", "y" * 50), (2, "d", None), (3, "e", "z" * 90)], "k int, path string, content string")
    out = {r.k: (r.included, r.truncated, r.context) for r in packing.crossfile_pack(files, "k", 70).collect()}
    assert out[1][:2] == (2, 1) and out[1][2].startswith("### File: a ###\nxx\n\n### File: b ###") and out[1][2].endswith("y" * 14) and out[2][:2] == (1, 0) and out[3][:2] == (0, 1)
    t = spark.createDataFrame([(1, 1, 10, 50), (1, 2, 10, 60), (1, 3, 10, 5), (2, 1, 2000, 3), (3, 1, 0, 400)], "qid int, rk int, left_tokens int, n_tokens int")
    assert {(r.qid, r.rk, r.taken) for r in packing.token_budget(t, 50 + 256 + 10 + 80).collect()} == {(1, 1, 50), (1, 2, 30), (3, 1, 90)}


def test_sources(spark, tmp_path):
    raw = ['{"a": "1", "b": null}', '[{"path": "p", "text": "x"}, {"path": "p", "text": "y"}, 3, {"text": "z"}]', "{broken", None, "", "7", "[]"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "item_id int, crossfile_context string")
    got = [r.m for r in df.select("item_id", readers.crossfile_pairs(F.col("crossfile_context")).alias("m")).orderBy("item_id").collect()]
    assert got[0] == {"a": "1", "b": None} and got[3:] == [{}, {}, {}, {}]
    assert [r.task_id for r in readers.eval_rows(df, 2).collect()] == ["task_0", "task_1"]
    rows = [(False, "x", "0"), (False, "y", "1"), (True, "a", "2"), (True, "b", "3"), (False, "c", "4"), (None, "d", "5"), (True, "e", "6"), (False, "f", "7")]
    spark.createDataFrame(rows, "first boolean, path string, content string").coalesce(1).write.parquet(str(tmp_path / "r"))
    repos = readers.repo_files(spark, str(tmp_path / "r")).orderBy("file_seq").collect()
    assert [(r.repo_id, r.path) for r in repos] == [(0, "x"), (0, "y"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (3, "f")]
    (tmp_path / "src" / "build").mkdir(parents=True)
    (tmp_path / "src" / "m.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "src" / "n.txt").write_text("n")
    (tmp_path / "src" / "build" / "o.py").write_text("o")
    assert [(r.path, r.content) for r in readers.file_tree(spark, str(tmp_path / "src")).collect()] == [("m.py", "x = '\ufffd'\n")]
    v = spark.createDataFrame([(1, [1.0, 2.0])], "cid long, vec array<double>")
    sinks.save_index(v, str(tmp_path / "ix"), 2, "abc")
    assert sinks.load_index(spark, str(tmp_path / "ix"), 2).count() == 1 and sinks.load_index(spark, str(tmp_path / "ix"), 3) is None and sinks.load_index(spark, str(tmp_path / "no"), 2) is None
    assert sinks.index_valid(spark, str(tmp_path / "ix"), "abc") and not sinks.index_valid(spark, str(tmp_path / "ix"), "x")


def test_configuration_and_schedules():
    from codectx.plans import cli

    c = config.NeuralConfig(warmup_steps=2, num_rounds=3, steps_per_round_prompt=5, steps_per_round_dpo=7)
    assert config.schedule(c, "adapter_first") == [("prompt", 17), ("preference", 0), ("dpo", 21), ("refresh", 0)]
    assert config.schedule(c, "retriever_first") == [("preference_without_adapter", 0), ("dpo", 21), ("refresh", 0), ("prompt_with_retriever", 17)]
    assert len(config.schedule(c)) == 13
    assert config.resolved(config.NeuralConfig("always_skip")).adapter_type == "none"
    assert config.inference_strategy("intent_main") == "current" and config.guard_inference("bm25") == "bm25"
    for bad in ("oracle", "hard_neg", "target_symbol", "gold_overlap"):
        with pytest.raises(RuntimeError):
            config.guard_inference(bad)
    _, p, n = cli.configuration(["train", "--samples", "a", "--chunks", "b"])
    assert (p.retriever_lr, p.gate_lr, p.soft_prompt_lr, n.max_pairs_per_sample, n.leave_one_out_samples) == (0.2, 0.1, 0.05, 4, 25)
    _, p, n = cli.configuration(["train", "--samples", "a", "--chunks", "b", "--use-neural", "--gate-lr", "0.5", "--num-rounds", "9"])
    assert (p.retriever_lr, p.gate_lr, n.num_rounds) == (2e-5, 0.5, 9)


METHOD = {"chunk_id": "s.py::L1-3::method", "chunk_type": "method", "defined_symbols": ["fetch_user"], "used_symbols": ["UserService", "user_id"], "call_names": ["fetch_user"], "method_names": []}


def test_proxy_training_one_sample_in_order_and_bulk(spark):
    cfg = config.ProxyConfig(epochs=2, top_k=2, sampled_contexts=2)
    sample = {"left_context": "service = UserService(db)\nuser = service.fetch_", "target": "fetch_user(user_id)"}
    history, weights, liking = proxy.proxy_in_order([sample], [METHOD], cfg)
    assert len(history) == 2 and "fetch_user" in weights and liking["fetch_user"] == pytest.approx(0.1)
    chunks = spark.createDataFrame([(1, "g", METHOD["chunk_id"], "method", ["fetch_user"], ["UserService", "user_id"], ["fetch_user"], [])], "cid long, grp string, chunk_id string, chunk_type string, defined_symbols array<string>, used_symbols array<string>, call_names array<string>, method_names array<string>")
    samples = spark.createDataFrame([(1, "g", sample["left_context"], sample["target"])], "qid long, grp string, left_context string, target string")
    state = proxy.train(samples, chunks, cfg, written)
    assert len(state.history) == 2 and state.history[0][1:4] == pytest.approx(history[0][1:4])
    assert {r.token: r.w for r in state.weights.collect()}["fetch_user"] == pytest.approx(weights["fetch_user"], rel=1e-2)
    assert proxy.predict(samples, chunks, state, cfg).first().completion == "fetch_user(user_id)"


def test_strategies_and_neural_run(spark):
    from codectx.plans import neural

    samples = spark.createDataFrame([(1, "a b", "c d"), (2, "x", "y")], "sid long, left_context string, target string")
    top = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "sid long, rk int, cid long")
    rows = strategies.strategy_union(samples, {"bm25": top, "oracle": top.filter("rk = 1")})
    assert {(r.sid, r.strategy) for r in rows.collect()} == {(1, "stop"), (2, "stop"), (1, "bm25"), (1, "oracle")}
    assert {r.strategy for r in strategies.strategy_union(samples, {"oracle": top}, train=False).collect()} == {"stop"}
    with pytest.raises(ValueError):
        strategies.strategy_union(samples, {"other": top})
    texts = spark.createDataFrame([(10, "c d e"), (11, "f")], "cid long, text string")
    models = neural.DefaultModels()
    out = neural.run(models, samples, lambda: rows, texts, config.NeuralConfig(warmup_steps=1, num_rounds=1))
    assert out["status"] == "ok" and out["pairs"].count() >= 1 and [p for p, _ in models.log][:3] == ["prompt", "prompt", "preference"]
    assert neural.run(models, samples, lambda: rows, texts.limit(0), config.NeuralConfig()) == {"status": "no_chunks"}
    v = {r.id: r.vec for r in models.encode(texts.withColumnRenamed("cid", "id").unionByName(spark.createDataFrame([(12, "")], "id long, text string"))).collect()}
    assert sum(x * x for x in v[10]) == pytest.approx(1.0) and sum(v[12]) == 0.0


def test_streamed_files_are_chunked(spark, tmp_path):
    from codectx import streaming

    spark.createDataFrame([("a.py", "def f():\n    pass\n")], "path string, content string").withColumn("at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    got = []
    streaming.append_chunks(streaming.new_files(spark, str(tmp_path / "in")).select("path", "content"), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert [(r.file_path, r.chunk_type) for r in got] == [("a.py", "function")]


def test_plans_push_down_and_stay_in_the_jvm(spark, tmp_path):
    df = spark.createDataFrame(random_chunks(random.Random(3), 30), CHUNKS)
    df.write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c")).withColumn("tokens", ranking.symbol_set(ranking.LEXICAL))
    q = spark.createDataFrame([(1, "g", ["alpha"])], "qid long, grp string, tokens array<string>")
    plan = ranking.lexical_top_k(q, c, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "CartesianProduct" not in plan and "text" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_built_samples_put_their_files_together_again(spark):
    from codectx.operators import samples

    body = "import os\n" + "".join(f"def f{i}(a):\n    x = a + {i}\n    # note\n    if x:\n        return x\n    return {i}\n" for i in range(20))
    files = [("r", f"m{i}.py", body.replace("note", f"note {i}")) for i in range(3)] + [("q", "big.go", "x\n" * 130), ("q", "n.py", None), ("s", "short.py", "x = 1\n"), ("r", "m.txt", "tiny")]
    df = spark.createDataFrame(files, "repo_id string, path string, content string")
    made, cross = samples.build_samples(df, 12, 60, least_lines=50, least_chars=100, least_left=10)
    rows = made.collect()
    text = {p: c for _, p, c in files}
    assert len(rows) == 12 and len({r.sample_id for r in rows}) == 12
    for r in rows:
        assert "\n".join([r.left_context, r.target, r.right_context]) == text[r.path] and r.target.strip() and not r.target.strip().startswith(("#", "import"))
        assert r.left_context.count("\n") + 1 >= 10 and r.n_lines == r.target.count("\n") + 1 and r.path != "m.txt"
    others = {(c.sample_id, c.path) for c in cross.collect()}
    assert others == {(r.sample_id, p) for r in rows for g, p, c in files if g == r.repo_id and p != r.path and c is not None}
    again = samples.build_samples(df.repartition(5), 12, 60, least_lines=50, least_chars=100, least_left=10)[0].collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    assert samples.build_samples(df.limit(0), 5, 5)[0].collect() == []


def test_checkpoints_reports_warmup_and_joint_scores(spark, tmp_path):
    w = spark.createDataFrame([("a", 0.5)], "token string, w double")
    h = spark.createDataFrame([(1, 0.5, 1.0, 2, 0.1, 0.2)], "epoch int, avg_quality double, retrieval_rate double, dpo_pairs int, gate_loss double, prompt_loss double")
    sinks.save_checkpoint(spark, str(tmp_path / "ck"), w, w.withColumnRenamed("w", "affinity"), {"weights": [1, 2, 3, 4]}, h, {"top_k": 3})
    weights, liking, gate = sinks.load_checkpoint(spark, str(tmp_path / "ck"))
    assert weights.first().w == 0.5 and liking.first().affinity == 0.5 and gate == {"weights": [1, 2, 3, 4]}
    sinks.text_report(spark.createDataFrame([("t", "body")], "title string, content string"), str(tmp_path / "rep"))
    assert "=== t ===" in [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()]
    s = spark.createDataFrame([(i, i / 10) for i in range(10)], "sid long, u double")
    one = s.select("sid", F.lit(1).alias("rk"), F.col("sid").alias("cid"))
    kinds = {r.sid: (r.kind, r.cid) for r in strategies.warmup_contexts(s, one.filter("sid <> 3"), one, 0.2, 0.5, F.col("u")).collect()}
    assert kinds[0] == ("none", None) and kinds[2] == ("oracle", 2) and kinds[3] == ("oracle", None) and kinds[7] == ("noisy", 7)
    r = spark.range(1).select(dense.combined_score(F.lit(0.25), F.lit(0.5), F.lit(True)), dense.combined_score(F.lit(0.25), F.lit(0.5), F.lit(False))).first()
    assert r[0] == pytest.approx(math.log(0.75)) and r[1] == pytest.approx(math.log(0.25) + 0.5)


def test_proxy_queries_take_all_samples(spark):
    from codectx.plans import catalog

    d = "/root/testdata/sf0.001"
    n = catalog.table(spark, d, "training_samples").count()
    assert catalog.proxy_predict(spark, d).count() == n == catalog.search_samples(spark, d).count()


def test_scope_by_tree_and_by_indentation(spark):
    from codectx.operators import intent

    code = "import os\nfrom a import (\n    b,\n)\n\n@deco\nclass A:\n    def f(self, p):\n        x = 1\n        return x\n\ndef g():\n    y = 2\n\nz = 3\n"
    broken = code + "def h(:\n    w = 1\n"
    java = "package p;\nimport a.B;\nclass C {\n  void f() {\n    int x;\n  }\n}\n"
    go = "package p\n\nimport (\n\t\"fmt\"\n)\n\nfunc f() {}\n"
    rows = [(1, code, "a.py", 9), (2, code, "a.py", 15), (3, broken, "a.py", 9), (4, java, "a.java", 5), (5, go, "a.go", 7), (6, None, None, 0), (7, code, "a.py", 6), (8, code, "a.py", 3)]
    df = spark.createDataFrame(rows, "k int, t string, p string, c int")
    got = {r.k: r.s for r in intent.with_scope(df, "t", "c", "s", path_col="p").collect()}
    assert got[1].imports == ["import os", "from a import (\n    b,\n)"] and (got[1].parent_class, got[1].parent_function) == ("class A:", "    def f(self, p):") and got[1].local_code == "    def f(self, p):\n        x = 1" and got[1].local_variables == ["p", "x"]
    assert (got[2].parent_class, got[2].parent_function) == ("class A:", "def g():")  # nothing encloses it: the nearest headers above
    assert (got[3].parent_class, got[3].parent_function) == ("class A:", "    def f(self, p):") and got[3].imports == ["import os", "from a import ("]
    assert got[4].imports == ["import a.B;"] and got[4].parent_class is None and got[5].imports == ["import (\n\t\"fmt\"\n)"] and got[6].imports == [] and got[6].cursor_line == 1
    assert got[8].imports == ["import os"]
    scanned = {r.k: r.s for r in intent.with_scope(df, "t", "c", "s", path_col="p", tree=False).collect()}
    assert scanned[4].imports == ["import a.B;"] and scanned[5].imports == []
    q = intent.retrieval_query(spark.createDataFrame([(None,), ("a.b",)], "l string"), "l", "raw").collect()
    assert [r.query for r in q] == ["", "a.b"]
    with pytest.raises(ValueError):
        intent.retrieval_query(df, "t", "other")


def test_from_a_repository_to_a_checkpoint(spark, tmp_path):
    from codectx.plans import runner
    from codectx.sources import readers

    body = "import os\n" + "".join(f"def fun{i}(a):\n    value{i} = a + {i}\n    if value{i}:\n        return fun{i - 1}(value{i})\n    return {i}\n" for i in range(20))
    rows = [(k % 3 == 0, f"m{k}.py" if k != 4 else "m4.txt", body.replace("value", f"value{k}_")) for k in range(9)]
    spark.createDataFrame(rows, "first boolean, path string, content string").coalesce(1).write.parquet(str(tmp_path / "repos"))
    cfg = runner.RunConfig(str(tmp_path / "repos"), str(tmp_path / "ck"), "mixed", 12, 40, 6, 50, 100, 10)
    out = runner.train(spark, cfg, config.ProxyConfig(epochs=1))
    assert out["num_samples"] == 6 and out["epochs"] == 1 and out["num_chunks"] > 10
    weights, liking, gate = sinks.load_checkpoint(spark, str(tmp_path / "ck"))
    assert liking.count() > 0 and len(gate["weights"]) == 4
    kept, chunks = runner.training_set(readers.repo_files(spark, cfg.dataset_path), cfg)
    assert {r.chunk_type for r in chunks.filter("file_path = 'm4.txt'").select("chunk_type").collect()} <= {"fallback"}
    places = [(r.grp, r.pos) for r in chunks.orderBy("grp", "pos").collect()]
    assert all(b[1] == a[1] + 1 for a, b in zip(places, places[1:]) if a[0] == b[0])
    with pytest.raises(RuntimeError):
        runner.train(spark, runner.RunConfig(str(tmp_path / "repos"), str(tmp_path / "no"), min_file_lines=10**6, attempts=0), config.ProxyConfig())


def test_table_functions_indexes_snapshots_and_draws(spark, tmp_path):
    from codectx.functions import tables
    from codectx.operators import sampling
    from codectx.plans import neural
    from codectx.sources import readers

    tables.register(spark)
    spark.createDataFrame([("a.py", "x = 1\ndef f():\n    pass\n")], "p string, t string").createOrReplaceTempView("files_")
    assert [tuple(r) for r in spark.sql("SELECT l.chunk_no, l.start_line, l.end_line FROM files_, LATERAL line_chunks(t, 2) l ORDER BY 1").collect()] == [(0, 1, 2), (1, 3, 3)]
    assert {r.kind for r in spark.sql("SELECT s.kind FROM files_, LATERAL entity_spans(t) s").collect()} == {"global", "function"}
    assert [r.content for r in spark.sql("SELECT w.content FROM files_, LATERAL structural_windows(p, t, 100) w").collect()] == ["x = 1\ndef f():\n    pass\n"]
    m = neural.DefaultModels()
    c = spark.createDataFrame([(1, "a", "x y"), (2, "a", "z"), (3, "b", None)], "cid long, chunk_id string, text string")
    first = {r.cid for r in neural.build_index(m, c, str(tmp_path / "ix"), m.dim).collect()}
    assert first == {2, 3} and {r.cid for r in neural.build_index(m, c, str(tmp_path / "ix"), m.dim).collect()} == first
    assert sinks.load_index(spark, str(tmp_path / "none"), 64) is None and not sinks.index_valid(spark, str(tmp_path / "none"), "f") and sinks.load_index(spark, str(tmp_path / "ix"), 3) is None
    m.step("prompt", 3, None), m.snapshot("initial"), m.save(spark, str(tmp_path / "m"))
    other = neural.DefaultModels(dim=2)
    other.load(spark, str(tmp_path / "m"))
    assert other == m and m.loss(spark.createDataFrame([(0.0,)], "gap double")) == pytest.approx(math.log(2))
    g = spark.createDataFrame([(f"g{i % 3}", i) for i in range(30)], "g string, k long")
    draws = [{r.k for r in sampling.one_of_each(g, "g", "k", e).collect()} for e in (0, 1, 2)]
    assert all(len(x) == 3 for x in draws) and len(set(map(frozenset, draws))) > 1
    spark.createDataFrame([(i, f"l{i}") for i in range(5)], "n int, left_context string").coalesce(1).write.parquet(str(tmp_path / "d" / "repoeval" / "test.parquet"))
    assert [r.task_id for r in readers.eval_set(spark, most=2, base=str(tmp_path / "d")).collect()] == ["task_0", "task_1"] and readers.eval_path("repoeval_update", "java") == "data/repoeval_update/java/test.parquet"
    likes = proxy.affinity_order(spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "token string, affinity double")).collect()
    assert [r.token for r in likes] == ["c", "a", "b"]
