"""From a repository Parquet to a checkpoint: files, samples, candidates of each sample, training, sinks."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codectx.functions.text import strip
from codectx.operators import chunking, entities, samples, sampling
from codectx.plans import proxy
from codectx.plans.config import ProxyConfig
from codectx.sources import readers, sinks
from codectx.storage import written


@dataclass(frozen=True)
class RunConfig:
    dataset_path: str
    checkpoint_dir: str
    completion_level: str = "line"
    wanted: int = 2000
    attempts: int = 20_000
    max_train_samples: int = 0
    min_file_lines: int = 200
    min_file_chars: int = 2000
    min_left_context_lines: int = 30
    max_chunk_lines: int = 120
    fallback_lines: int = 40


def candidate_chunks(crossfile: DataFrame, key: str, most: int = entities.MOST_LINES, fallback: int = entities.FALLBACK_LINES) -> DataFrame:
    """Chunks of the files (key, path, content) of each sample's cross-file map, as candidates of that sample: by path and place in the file, ``pos`` counts from 0.

    Columns: grp (the sample), pos, cid (a number of sample and place), chunk_id and those of a chunk. Null contents are empty files.
    """
    chunks = entities.entity_chunks(crossfile, [key], "path", "content", most, fallback, python_only=True)
    ranked = chunks.withColumn("pos", chunking.place_within(F.col(key), F.col("file_path"), F.col("chunk_pos")))
    name = chunking.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"))
    return ranked.select(F.col(key).alias("grp"), "pos", F.xxhash64(F.col(key), "pos").alias("cid"), name.alias("chunk_id"), *(c for c in chunks.columns if c not in (key, "chunk_pos")))


def training_set(files: DataFrame, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(samples: qid, grp, left_context, target; their candidate chunks) of repository files (repo_id, path, content). Blank targets are left out; of the rest the first max_train_samples stay, 0 keeps all."""
    shares = None if config.completion_level == "mixed" else {x: float(x == config.completion_level) for x in sampling.LEVELS}
    made, crossfile = samples.build_samples(files, config.wanted, config.attempts, least_lines=config.min_file_lines, least_chars=config.min_file_chars, least_left=config.min_left_context_lines, shares=shares)
    full = made.filter(strip(F.col("target")) != "")
    kept = written((full.orderBy("sample_id").limit(config.max_train_samples) if config.max_train_samples > 0 else full).select(F.col("sample_id").alias("qid"), F.col("sample_id").alias("grp"), "left_context", "target"))
    own = crossfile.join(kept.select(F.col("qid").alias("sample_id")), "sample_id", "left_semi")
    return kept, written(candidate_chunks(own, "sample_id", config.max_chunk_lines, config.fallback_lines))


def train(spark: SparkSession, run: RunConfig, config: ProxyConfig) -> dict:
    """Read, build, train, save. A repository Parquet that gives no sample is an error."""
    kept, chunks = training_set(readers.repo_files(spark, run.dataset_path), run)
    n = kept.count()
    if not n:
        raise RuntimeError("the repositories gave no sample: are they long enough for the filters?")
    state = proxy.train(kept, chunks, config, written)
    settings = {**asdict(config), **asdict(run), "num_samples": n, "num_chunks": chunks.select("chunk_id").distinct().count()}
    sinks.save_checkpoint(spark, run.checkpoint_dir, state.weights, state.affinities, {"weights": state.gate}, state.history_frame(), settings)
    return {"status": "ok", "checkpoint": run.checkpoint_dir, "num_samples": n, "num_chunks": settings["num_chunks"], "epochs": len(state.history)}
