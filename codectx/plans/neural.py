"""The phases around trainable models: index, warm-up, preference data, DPO, refresh, evaluation. Models are given from outside.

A model set has ``encode`` (a frame of id and text to id and vec, by the weights as they are or by a snapshot), ``score`` (samples and contexts to nll), ``step`` (one training phase),
``loss`` (of preference pairs), ``snapshot``, ``save`` and ``load``.
The defaults are deterministic and need no accelerator: hashed bags of identifiers, the smoothed unigram scorer, and a training that only keeps its log.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codectx.functions.text import identifier_set, identifiers
from codectx.operators import chunking, dense, intent, ranking, strategies, utility
from codectx.plans.config import NeuralConfig, guard_inference, inference_strategy, resolved, schedule
from codectx.sources import sinks
from codectx.storage import spread, written


class Models(Protocol):
    def encode(self, texts: DataFrame, snapshot: str | None = None) -> DataFrame: ...
    def score(self, samples: DataFrame, contexts: DataFrame) -> DataFrame: ...
    def step(self, phase: str, steps: int, data: DataFrame | None) -> None: ...
    def loss(self, pairs: DataFrame, beta: float) -> float: ...
    def snapshot(self, name: str) -> None: ...
    def save(self, spark: SparkSession, path: str) -> None: ...
    def load(self, spark: SparkSession, path: str) -> None: ...


@dataclass
class DefaultModels:
    dim: int = 64
    log: list[tuple[str, int]] = field(default_factory=list)
    snapshots: dict[str, int] = field(default_factory=dict)  # name -> steps made by then

    def encode(self, texts: DataFrame, snapshot: str | None = None) -> DataFrame:
        """(id, vec): counts of identifiers in ``dim`` hashed slots, normalised."""
        slots = texts.select("id", F.explode(identifiers(F.col("text"))).alias("w")).groupBy("id", F.pmod(F.xxhash64("w"), F.lit(self.dim)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
        sparse = slots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("n").cast("double").alias("n")))).alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0)))
        return texts.select("id").join(sparse, "id", "left").select("id", dense.normalised(full).alias("vec"))

    def score(self, samples: DataFrame, contexts: DataFrame) -> DataFrame:
        return utility.smoothed_unigram_nll(samples, contexts)

    def step(self, phase: str, steps: int, data: DataFrame | None) -> None:
        self.log.append((phase, steps))

    def loss(self, pairs: DataFrame, beta: float = 0.1) -> float:
        """The mean preference loss of pairs (gap: the chosen utility less the rejected one) against a reference that has not moved."""
        zero = F.lit(0.0)
        return pairs.agg(F.coalesce(F.avg(utility.dpo_loss(F.col("gap"), zero, zero, zero, beta)), zero)).first()[0]

    def snapshot(self, name: str) -> None:
        self.snapshots[name] = sum(n for _, n in self.log)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps({"dim": self.dim, "log": self.log, "snapshots": self.snapshots}),)], "state string").coalesce(1).write.mode("overwrite").json(path)

    def load(self, spark: SparkSession, path: str) -> None:
        state = json.loads(spark.read.json(path).first()["state"])
        self.dim, self.log, self.snapshots = state["dim"], [tuple(x) for x in state["log"]], state["snapshots"]


def build_index(models: Models, chunks: DataFrame, path: str, dim: int) -> DataFrame:
    """The vectors (cid, vec) of chunks (cid, chunk_id, text), read from ``path`` if these very chunks were indexed there, else encoded and saved; to refresh after training, give another path or delete it.

    Of a chunk id that comes twice, the chunk of the larger cid counts.
    """
    spark = chunks.sparkSession
    last = chunks.groupBy("chunk_id").agg(F.max("cid").alias("cid"))
    kept = chunks.join(last, ["chunk_id", "cid"], "left_semi")
    fingerprint = chunking.index_fingerprint(kept, "chunk_id").first()[0]
    if not sinks.index_valid(spark, path, fingerprint):
        sinks.save_index(models.encode(kept.select(F.col("cid").alias("id"), "text")).select(F.col("id").alias("cid"), "vec"), path, dim, fingerprint)
    return sinks.load_index(spark, path, dim)


def fan_out(models: Models, samples: DataFrame, chunks: DataFrame, config: NeuralConfig, train: bool = True) -> DataFrame:
    """(sid, strategy, pos, is_stop, rk, cid): what every strategy offers each sample (sid, grp, left_context, target) of the chunks (cid, grp, pos, chunk_type, text, tokens, symbols) of its group.

    The query is the sketch or the raw left context as ``intent_mode`` says. dense_frozen encodes by the snapshot 'initial', current by the weights as they are; the strategies that look at the target serve training only.
    """
    asked = written(intent.retrieval_query(spread(samples.select("sid", "grp", "left_context")), "left_context", config.intent_mode).select("sid", "grp", "query"))
    texts, chunks = spread(chunks.select(F.col("cid").alias("id"), "text")), written(chunks.select("cid", "grp", "pos", "chunk_type", "tokens", "symbols"))
    queries = asked.select(F.col("sid").alias("qid"), "grp", identifier_set(F.col("query")).alias("tokens"))
    pool = written(ranking.lexical_top_k(queries, chunks, max(config.pool_top_k, config.top_k)).select("qid", "rk", "cid"))
    lists = {"bm25": pool.filter(F.col("rk") <= config.top_k)}
    for name, snapshot in (("dense_frozen", "initial"), ("current", None)):
        vectors = written(chunks.select("cid", "grp", "pos").join(models.encode(texts, snapshot).withColumnRenamed("id", "cid"), "cid"))
        q = written(asked.select(F.col("sid").alias("qid"), "grp").join(models.encode(asked.select(F.col("sid").alias("id"), F.col("query").alias("text")), snapshot).select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid"))
        lists[name] = dense.group_top_k(q, vectors, config.top_k)
    if train:
        goals = samples.select(F.col("sid").alias("qid"), "grp", identifier_set(F.col("target")).alias("tokens"))
        lists["hard_neg"] = ranking.hard_negatives(pool, goals, chunks, config.top_k, config.num_hard_negatives)
        lists["oracle"] = ranking.oracle_top_k(goals, chunks, config.top_k)
    return strategies.strategy_union(samples.select("sid"), {k: v.select(F.col("qid").alias("sid"), "rk", "cid") for k, v in lists.items()}, train)


def preference_data(models: Models, samples: DataFrame, rows: DataFrame, texts: DataFrame, config: NeuralConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked utilities, pairs, gate labels) of strategy rows (sid, strategy, pos, is_stop, rk, cid) with chunk texts (cid, text)."""
    contexts = rows.join(texts, "cid", "left").select("sid", "strategy", "text")
    nll = models.score(samples, contexts)
    names = rows.select("sid", "strategy", "pos", "is_stop").distinct()
    ranked = utility.utilities(names.join(nll, ["sid", "strategy"]))
    return ranked, utility.preference_pairs(ranked, config.preference_margin, config.max_pairs_per_sample), utility.gate_labels(ranked, config.utility_margin)


def run(models: Models, samples: DataFrame, offered: Callable[[], DataFrame], texts: DataFrame, config: NeuralConfig, order: str = "alternating") -> dict:
    """Run a schedule: preference data are made anew where the schedule says so and handed to the next DPO phase. offered: gives the strategies' rows as they are then."""
    config = resolved(config)
    guard_inference(inference_strategy(config.experiment_mode))
    if texts.isEmpty():
        return {"status": "no_chunks"}
    pairs = None
    models.snapshot("initial")
    for phase, steps in schedule(config, order):
        if phase.startswith("preference"):
            pairs = preference_data(models, samples, offered(), texts, config)[1]
        if phase == "dpo":
            models.snapshot("reference")
        models.step(phase, steps, pairs if phase == "dpo" else None)
    ranked, pairs, labels = preference_data(models, samples, offered(), texts, config)
    return {"status": "ok", "ranked": ranked, "pairs": pairs, "labels": labels}
