"""Proxy training: a sparse retriever with learned token weights, a logistic gate, symbol affinities and a generator proxy.

Training goes by parts of an epoch's samples: within one all samples see the same weights, and their steps are summed up and applied at
its end. (The reference applies them sample by sample; ``proxy_in_order`` does so for a bounded number of samples.) Samples, contexts and
gradients stay distributed; what the driver keeps are three gate weights and one row of history an epoch.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codectx.functions import quality
from codectx.functions import text as t
from codectx.operators import intent, ranking, sampling
from codectx.plans.config import ProxyConfig
from codectx.schemas import HISTORY


def completion(left: Column, target: Column, symbols: Column, affine: Column) -> Column:
    """The generator proxy's text: it reads the target, so it stands for training only.

    symbols: defined, called and method names of the context in order; affine: whether learned affinities reach a target token. The first symbol that
    extends the prefix or is a target token decides; a symbol that does both extends.
    """
    prefix, wanted = t.trailing_identifier(left), t.identifiers(target)
    extends = lambda s: (prefix != "") & s.startswith(prefix)
    first = F.get(F.filter(symbols, lambda s: extends(s) | F.array_contains(wanted, s)), F.lit(0))
    grown = F.when(F.startswith(t.text(target), prefix), t.text(target)).otherwise(F.concat(prefix, first))
    return F.when(first.isNull(), F.when(affine, t.text(target)).otherwise(prefix)).when(extends(first), grown).otherwise(t.text(target))


def context_symbols(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, draw, cids, symbols, hits, used) of contexts (qid, draw, rk, cid): ordered symbols of three kinds for the generator, symbols that count as hits, and all of them for affinities."""
    e = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    c = chunks.select("cid", F.concat(e("defined_symbols"), e("call_names"), e("method_names")).alias("_s"), F.concat(e("defined_symbols"), e("call_names")).alias("_h"), F.concat(e("defined_symbols"), e("call_names"), e("used_symbols")).alias("_u"))
    rows = contexts.join(c, "cid").groupBy("qid", "draw").agg(F.array_sort(F.collect_list(F.struct("rk", "cid", "_s", "_h", "_u"))).alias("_l"))
    flat = lambda name: F.flatten(F.transform("_l", lambda x: x[name]))
    return rows.select("qid", "draw", F.transform("_l", lambda x: x["cid"]).alias("cids"), flat("_s").alias("symbols"), F.array_distinct(flat("_h")).alias("hits"), F.array_distinct(flat("_u")).alias("used"))


def update_tokens(query: Column, defined: Column, used: Column, calls: Column, methods: Column) -> Column:
    """A chunk's symbols, distinct and in order, that the query has or the chunk defines or calls."""
    asked = t.identifiers(query)
    own = F.array_distinct(F.concat(defined, calls, methods, used))
    return F.filter(own, lambda s: F.array_contains(asked, s) | F.array_contains(defined, s) | F.array_contains(calls, s))


def dpo_gradient(pairs: DataFrame, chunks: DataFrame, weights: DataFrame, reference: DataFrame, beta: float, lr: float) -> DataFrame:
    """(token, grad): the summed step of pairs (qid, query, chosen, rejected; the last two are lists of cids) from given weights and reference weights.

    Pairs whose two sets are equal add nothing. Overlap with the query cancels out of the logit, so scores are sums of weights alone.
    """
    live = pairs.filter(F.array_sort(F.array_distinct("chosen")) != F.array_sort(F.array_distinct("rejected")))
    sides = live.select("qid", "query", F.explode("chosen").alias("cid"), F.lit(1.0).alias("side")).unionByName(live.select("qid", "query", F.explode("rejected").alias("cid"), F.lit(-1.0).alias("side")))
    e = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    c = chunks.select("cid", *(e(x).alias(x) for x in ("defined_symbols", "used_symbols", "call_names", "method_names")))
    rows = sides.join(c, "cid")
    moved = weights.select("token", F.col("w").alias("d")).unionByName(reference.select("token", (-F.col("w")).alias("d"))).groupBy("token").agg(F.sum("d").alias("d")).filter("d <> 0")
    scored = rows.select("qid", "side", F.explode(ranking.symbol_set(ranking.LEXICAL)).alias("token")).join(moved, "token")
    logit = scored.groupBy("qid").agg((beta * F.sum(F.col("side") * F.col("d"))).alias("logit"))
    step = live.select("qid").join(logit, "qid", "left").select("qid", (lr * beta * (1.0 - t.sigmoid(F.coalesce("logit", F.lit(0.0))))).alias("g"))
    own = update_tokens(F.col("query"), F.col("defined_symbols"), F.col("used_symbols"), F.col("call_names"), F.col("method_names"))
    touched = rows.select("qid", "side", F.explode(own).alias("token"))
    return touched.join(step, "qid").groupBy("token").agg(F.sum(F.col("side") * F.col("g")).alias("grad"))


def affinity_steps(best: DataFrame, lr: float) -> DataFrame:
    """(token, affinity): lr for each target token that the best context has, or for all of them if it has none. best: target, used."""
    wanted = t.identifier_set(F.col("target"))
    useful = F.array_intersect(wanted, F.coalesce("used", F.array().cast("array<string>")))
    return best.select(F.explode(F.when(F.size(useful) > 0, useful).otherwise(wanted)).alias("token")).groupBy("token").agg((F.count("*") * lr).alias("affinity"))


def affinity_order(affinities: DataFrame) -> DataFrame:
    """The strongest first; of equal ones the token that comes first. A range-partitioned sort, no task has all of them."""
    return affinities.orderBy(F.desc("affinity"), "token")


def scored_contexts(samples: DataFrame, contexts: DataFrame, chunks: DataFrame, affinities: DataFrame) -> DataFrame:
    """(qid, draw, cids, used, quality) of all contexts and the empty one (the last draw, -1) of samples (qid, left_context, target)."""
    packed = context_symbols(contexts, chunks)
    affine = samples.select("qid", F.explode(t.identifier_set(F.col("target"))).alias("token")).join(affinities, "token", "left_semi").select("qid").distinct().withColumn("affine", F.lit(True))
    empty = F.array().cast("array<string>")
    none = samples.select("qid", F.lit(-1).alias("draw"), F.array().cast("array<bigint>").alias("cids"), empty.alias("symbols"), empty.alias("hits"), empty.alias("used"))
    rows = packed.unionByName(none).join(samples, "qid").join(affine, "qid", "left")
    predicted = completion(F.col("left_context"), F.col("target"), F.col("symbols"), F.coalesce("affine", F.lit(False)) & (F.col("draw") >= 0))
    return rows.withColumn("predicted", predicted).select("qid", "draw", "cids", "used", "left_context", "target", quality.proxy_quality(F.col("predicted"), F.col("target"), F.col("hits")).alias("quality"))


def best_and_worst(scored: DataFrame) -> DataFrame:
    """(qid, left_context, target, best, worst, used, best_quality, worst_quality, retrieve); ties go to the earlier draw, for the worst to the later, and the empty context is the last."""
    place = F.when(F.col("draw") < 0, F.lit(1 << 20)).otherwise(F.col("draw"))
    rows = scored.withColumn("_p", place)
    a = F.max_by(F.struct("cids", "used", "quality", "draw"), F.struct("quality", -F.col("_p"))).alias("a")
    z = F.min_by(F.struct("cids", "quality"), F.struct("quality", -F.col("_p"))).alias("z")
    g = rows.groupBy("qid").agg(a, z, F.first("left_context").alias("left_context"), F.first("target").alias("target"))
    return g.select(
        "qid", "left_context", "target", F.col("a.cids").alias("best"), F.col("z.cids").alias("worst"), F.col("a.used").alias("used"),
        F.col("a.quality").alias("best_quality"), F.col("z.quality").alias("worst_quality"), (F.size("a.cids") > 0).alias("retrieve"),
    )


@dataclass
class ProxyState:
    weights: DataFrame
    affinities: DataFrame
    gate: list[float] = field(default_factory=lambda: [*intent.GATE_WEIGHTS, intent.GATE_BIAS])
    history: list[tuple] = field(default_factory=list)

    def history_frame(self) -> DataFrame:
        return self.weights.sparkSession.createDataFrame(self.history, HISTORY)


def train(samples: DataFrame, chunks: DataFrame, config: ProxyConfig, keep: Callable[[DataFrame], DataFrame], batches: int = 4) -> ProxyState:
    """Train on samples (qid, grp, left_context, target) with candidate chunks (cid, grp, chunk_id, chunk_type and the symbol columns) of the same group.

    keep: cuts a frame's lineage, by a written table in a shared folder. An epoch goes through ``batches`` parts of the samples, drawn by a seeded hash; each retrieves with the weights
    that the parts before have left, and preferences are measured against the weights of the epoch's start. The gate makes a step a part, by the mean of its gradients.
    """
    spark = samples.sparkSession
    state = ProxyState(spark.createDataFrame([], "token string, w double"), spark.createDataFrame([], "token string, affinity double"))
    n = samples.count()
    prepared = chunks.withColumn("tokens", ranking.symbol_set(ranking.LEXICAL)).withColumn("symbols", ranking.symbol_set(ranking.ORACLE))
    queries = samples.select("qid", "grp", t.identifier_set(F.col("left_context")).alias("tokens"), t.trailing_identifier(F.col("left_context")).alias("prefix"))
    batch = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(config.random_seed)), F.col("qid").cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(batches)).cast("int")
    samples = samples.select("qid", "grp", "left_context", "target", batch.alias("batch"))
    for epoch in range(1, config.epochs + 1):
        reference, totals = state.weights, [0.0] * 5
        for b in range(batches):
            part = samples.filter(F.col("batch") == b)
            queries = part.select("qid", "grp", t.identifier_set(F.col("left_context")).alias("tokens"), t.trailing_identifier(F.col("left_context")).alias("prefix"))
            pool = max(4 * config.top_k, config.top_k + 1)
            ranked = keep(ranking.proxy_top_k(queries, prepared, state.weights, pool))
            contexts = sampling.sampled_contexts(ranked, config.top_k, config.sampled_contexts, config.random_seed + epoch)
            chosen = keep(best_and_worst(scored_contexts(part.select("qid", "left_context", "target"), contexts, chunks, state.affinities)))
            step = dpo_gradient(pairs_of(chosen), chunks, state.weights, reference, config.dpo_beta, config.retriever_lr)
            weights = state.weights.unionByName(step.withColumnRenamed("grad", "w")).groupBy("token").agg(F.sum("w").alias("w"))
            affinities = state.affinities.unionByName(affinity_steps(chosen, config.soft_prompt_lr)).groupBy("token").agg(F.sum("affinity").alias("affinity"))
            sums = gate_sums(chosen, state.gate).first()
            state.gate = [w + config.gate_lr * (g or 0.0) / max(1, sums["n"]) for w, g in zip(state.gate, sums[6:])]
            totals = [x + (y or 0) for x, y in zip(totals, sums[1:6])]
            state.weights, state.affinities = keep(weights), keep(affinities)
        mean = [x / max(1, n) for x in totals]
        state.history.append((epoch, mean[0], mean[1], int(totals[2]), mean[3], mean[4]))
    return state


def pairs_of(chosen: DataFrame) -> DataFrame:
    """(qid, query, chosen, rejected) of the samples whose best context is better than the worst."""
    better = chosen.filter((F.col("best_quality") > F.col("worst_quality")) & (F.col("best") != F.col("worst")))
    return better.select("qid", F.col("left_context").alias("query"), F.col("best").alias("chosen"), F.col("worst").alias("rejected"))


def gate_sums(chosen: DataFrame, gate: list[float]) -> DataFrame:
    """One row: n, sums of quality, retrievals, pairs, gate loss and prompt loss, and the gate's gradient (three weights and the bias)."""
    p = intent.gate_probability(F.col("left_context"), tuple(gate[:3]), gate[3])
    label = F.col("retrieve").cast("double")
    useful = F.size(F.array_intersect(t.identifier_set(F.col("target")), F.coalesce("used", F.array().cast("array<string>"))))
    pair = (F.col("best_quality") > F.col("worst_quality")) & (F.col("best") != F.col("worst"))
    f = intent.gate_features(F.col("left_context"))
    return chosen.agg(
        F.count("*").alias("n"), F.sum("best_quality"), F.sum(label), F.count_if(pair), F.sum(-(label * F.ln(p + 1e-8) + (1 - label) * F.ln(1 - p + 1e-8))), F.sum(1.0 / (useful + 1)), *(F.sum((label - p) * x) for x in (*f, F.lit(1.0)))
    )


def predict(samples: DataFrame, chunks: DataFrame, state: ProxyState, config: ProxyConfig) -> DataFrame:
    """(qid, retrieve, completion): the gate decides, the top k are put together, the generator proxy completes."""
    prepared = chunks.withColumn("tokens", ranking.symbol_set(ranking.LEXICAL)).withColumn("symbols", ranking.symbol_set(ranking.ORACLE))
    asked = samples.withColumn("retrieve", intent.gate_probability(F.col("left_context"), tuple(state.gate[:3]), state.gate[3]) >= config.gate_threshold)
    queries = asked.filter("retrieve").select("qid", "grp", t.identifier_set(F.col("left_context")).alias("tokens"), t.trailing_identifier(F.col("left_context")).alias("prefix"))
    contexts = ranking.proxy_top_k(queries, prepared, state.weights, config.top_k).withColumn("draw", F.lit(0))
    packed = context_symbols(contexts.select("qid", "draw", "rk", "cid"), chunks).select("qid", "symbols")
    affine = samples.select("qid", F.explode(t.identifier_set(F.col("target"))).alias("token")).join(state.affinities, "token", "left_semi").select("qid").distinct().withColumn("affine", F.lit(True))
    rows = asked.join(packed, "qid", "left").join(affine, "qid", "left")
    symbols = F.coalesce("symbols", F.array().cast("array<string>"))
    return rows.select("qid", "retrieve", completion(F.col("left_context"), F.col("target"), symbols, F.coalesce("affine", F.lit(False)) & F.col("retrieve")).alias("completion"))


IDENTIFIER = re.compile(t.IDENTIFIER)


def proxy_in_order(samples: list[dict], chunks: list[dict], config: ProxyConfig, most: int = 2000) -> tuple[list[tuple], dict[str, float], dict[str, float]]:
    """(history, weights, affinities) of the sample-by-sample training of at most ``most`` samples (left_context, target), each of which has all chunks for candidates.

    It is a sequential algorithm, kept for small sets and as a check; ``train`` is the one that scales.
    """
    if len(samples) > most:
        raise ValueError(f"more than {most} samples: use train")
    rng = random.Random(config.random_seed)
    weights: dict[str, float] = {}
    liking: dict[str, float] = {}
    gate = [*intent.GATE_WEIGHTS, intent.GATE_BIAS]
    every = {c["chunk_id"]: c for c in chunks}
    lexical = {k: set(c["defined_symbols"]) | set(c["used_symbols"]) | set(c["call_names"]) for k, c in every.items()}
    history = []
    for epoch in range(1, config.epochs + 1):
        before = dict(weights)
        total = [0.0, 0, 0, 0.0, 0.0]
        for s in samples:
            asked, left, target = set(IDENTIFIER.findall(s["left_context"])), s["left_context"].rstrip(), s["target"]
            wanted = set(IDENTIFIER.findall(target))
            prefix = (m := re.search(t.IDENTIFIER + r"$", left)) and m.group() or ""

            def score(k: str) -> float:
                c = every[k]
                head = 2.0 if prefix and any(x.startswith(prefix) for x in (*c["defined_symbols"], *c["call_names"], *c["method_names"])) else 0.0  # noqa: B023
                return 1.5 * len(asked & lexical[k]) + sum(weights.get(x, 0.0) for x in lexical[k]) + head + (0.15 if c["chunk_type"] in ranking.BONUS_TYPES else 0.0)  # noqa: B023

            order = [k for _, k in sorted(((score(k), k) for k in every), reverse=True)]
            pool = order[: max(4 * config.top_k, config.top_k + 1)]
            draws = [order[: config.top_k]] + [rng.sample(pool, min(config.top_k, len(pool))) for _ in range(config.sampled_contexts - 1)] + [[]]
            rated = []
            for d in draws:
                names = [x for k in d for x in (*every[k]["defined_symbols"], *every[k]["call_names"], *every[k]["method_names"])]
                hit = next((x for x in names if prefix and x.startswith(prefix) or x in wanted), None)
                if hit is None:
                    out = target if d and wanted & liking.keys() else prefix
                elif prefix and hit.startswith(prefix):
                    out = target if target.startswith(prefix) else prefix + hit
                else:
                    out = target
                got = set(IDENTIFIER.findall(out))
                recall = len(got & wanted) / len(wanted) if got and wanted else 0.0
                near = any(x in wanted for k in d for x in (*every[k]["defined_symbols"], *every[k]["call_names"]))
                rated.append((quality.PROXY[0] * (1.0 if out == target else SequenceMatcher(None, out, target).ratio()) + quality.PROXY[1] * recall + (quality.HIT if near else 0.0), d))
            best, worst = max(rated, key=lambda r: r[0]), min(reversed(rated), key=lambda r: r[0])
            end = (left.splitlines() or [left])[-1]
            f = [float("." in end), float(bool(re.search(t.IDENTIFIER + r"_$", end))), min(1.0, len(s["left_context"]) / 2000.0), 1.0]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(gate, f))))
            y = float(bool(best[1]))
            gate = [w + config.gate_lr * (y - p) * x for w, x in zip(gate, f)]
            if best[1] != worst[1] and best[0] > worst[0]:
                total[2] += 1
                if set(best[1]) != set(worst[1]):
                    moved = lambda d: sum(weights.get(x, 0.0) - before.get(x, 0.0) for k in d for x in lexical[k])
                    g = config.dpo_beta * (1 - 1 / (1 + math.exp(-config.dpo_beta * (moved(best[1]) - moved(worst[1])))))
                    for side, d in ((1, best[1]), (-1, worst[1])):
                        for k in d:
                            c = every[k]
                            for x in dict.fromkeys((*c["defined_symbols"], *c["call_names"], *c["method_names"], *c["used_symbols"])):
                                if x in asked or x in c["defined_symbols"] or x in c["call_names"]:
                                    weights[x] = weights.get(x, 0.0) + side * config.retriever_lr * g
            useful = wanted & {x for k in best[1] for x in lexical[k]}
            for x in useful or wanted:
                liking[x] = liking.get(x, 0.0) + config.soft_prompt_lr
            total[0] += best[0]
            total[1] += bool(best[1])
            total[3] -= y * math.log(p + 1e-8) + (1 - y) * math.log(1 - p + 1e-8)
            total[4] += 1 / (len(useful) + 1)
        n = max(1, len(samples))
        history.append((epoch, total[0] / n, total[1] / n, total[2], total[3] / n, total[4] / n))
    return history, weights, liking
