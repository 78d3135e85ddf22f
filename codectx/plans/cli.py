"""Command line: train in proxy mode over Parquet tables of samples and chunks."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codectx.functions.text import strip
from codectx.plans import proxy, runner
from codectx.plans.config import EXPERIMENTS, NeuralConfig, ProxyConfig
from codectx.sources import sinks
from codectx.storage import written

#: Learning rates of retriever, gate and soft prompt by mode. Fixed values.
RATES = {False: (0.2, 0.1, 0.05), True: (2e-5, 1e-4, 5e-3)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codectx", description="Retrieval of code contexts on Spark")
    t = p.add_subparsers(dest="command", required=True).add_parser("train", help="train the proxy models")
    t.add_argument("--dataset-path", help="Parquet of repository files: path, content, and first, which begins a repository")
    t.add_argument("--samples", help="instead of a dataset, Parquet of qid, grp, left_context, target")
    t.add_argument("--chunks", help="with samples, Parquet of cid, grp, chunk_id, chunk_type and symbols")
    t.add_argument("--completion-level", choices=("line", "block", "mixed"), default="line")
    t.add_argument("--max-samples", type=int, default=2000)
    t.add_argument("--max-train-samples", type=int, default=0)
    for name, value in (("min-file-lines", 200), ("min-file-chars", 2000), ("min-left-context-lines", 30), ("max-chunk-lines", 120), ("fallback-lines", 40)):
        t.add_argument(f"--{name}", type=int, default=value)
    t.add_argument("--intent-mode", choices=("static", "raw"), default="static")
    t.add_argument("--checkpoint-dir", default="checkpoints/codectx")
    t.add_argument("--num-epochs", type=int, default=1)
    t.add_argument("--top-k", type=int, default=3)
    t.add_argument("--sampled-contexts", type=int, default=3)
    t.add_argument("--dpo-beta", type=float, default=0.1)
    t.add_argument("--gate-threshold", type=float, default=0.5)
    t.add_argument("--random-seed", type=int, default=13)
    t.add_argument("--use-neural", action="store_true")
    t.add_argument("--experiment-mode", choices=EXPERIMENTS, default="intent_main")
    for name in ("retriever", "gate", "soft-prompt"):
        t.add_argument(f"--{name}-lr", type=float)
    for f, value in asdict(NeuralConfig()).items():
        if f not in ("experiment_mode", "top_k", "random_seed") and not isinstance(value, str):
            t.add_argument(f"--{f.replace('_', '-')}", type=type(value), default=value)
    return p


def configuration(argv: list[str]) -> tuple[argparse.Namespace, ProxyConfig, NeuralConfig]:
    a = parser().parse_args(argv)
    rates = [x if x is not None else d for x, d in zip((a.retriever_lr, a.gate_lr, a.soft_prompt_lr), RATES[a.use_neural])]
    own = ProxyConfig(a.num_epochs, a.top_k, a.sampled_contexts, a.dpo_beta, *rates, a.gate_threshold, a.random_seed)
    neural = NeuralConfig(**{f: getattr(a, f) for f in asdict(NeuralConfig()) if hasattr(a, f)})
    return a, own, neural


def main(argv: list[str] | None = None) -> dict:
    import sys

    a, config, _ = configuration(sys.argv[1:] if argv is None else argv)
    if a.use_neural:
        raise SystemExit("neural mode needs models: call codectx.plans.neural.run with your own")
    if not a.dataset_path and not (a.samples and a.chunks):
        raise SystemExit("give --dataset-path, or --samples and --chunks")
    spark = SparkSession.builder.appName("codectx").getOrCreate()
    if a.dataset_path:
        run = runner.RunConfig(
            a.dataset_path, a.checkpoint_dir, a.completion_level, a.max_samples, 10 * a.max_samples, a.max_train_samples, a.min_file_lines, a.min_file_chars, a.min_left_context_lines, a.max_chunk_lines, a.fallback_lines
        )
        summary = runner.train(spark, run, config)
        print(json.dumps(summary))
        return summary
    samples = spark.read.parquet(a.samples).filter(strip(F.col("target")) != "")
    if samples.isEmpty():
        raise SystemExit("there are no samples with a target")
    state = proxy.train(samples, spark.read.parquet(a.chunks), config, written)
    sinks.save_checkpoint(spark, a.checkpoint_dir, state.weights, state.affinities, {"weights": state.gate}, state.history_frame(), asdict(config))
    summary = {"status": "ok", "checkpoint": a.checkpoint_dir, "epochs": len(state.history)}
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
