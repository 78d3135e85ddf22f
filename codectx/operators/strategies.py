"""What each retrieval strategy offers a sample, one under the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the strategies, on which ties depend. The last two look at the target and serve training only. Fixed values.
ORDER = ("stop", "bm25", "dense_frozen", "current", "hard_neg", "oracle")


def strategy_union(samples: DataFrame, lists: dict[str, DataFrame], train: bool = True) -> DataFrame:
    """(sid, strategy, pos, is_stop, rk, cid): a stop row without chunk for each sample (sid), and the rows (sid, rk, cid) of each strategy.

    A strategy that has nothing for a sample has no row there; without ``train`` the strategies that know the target are left out.
    """
    unknown = set(lists) - set(ORDER[1:])
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    stop = samples.select("sid", F.lit("stop").alias("strategy"), F.lit(0).alias("pos"), F.lit(True).alias("is_stop"), F.lit(0).alias("rk"), F.lit(None).cast("long").alias("cid"))
    used = [s for s in ORDER[1:] if s in lists and (train or s not in ("hard_neg", "oracle"))]
    rest = [lists[s].select("sid", F.lit(s).alias("strategy"), F.lit(ORDER.index(s)).alias("pos"), F.lit(False).alias("is_stop"), "rk", "cid") for s in used]
    return reduce(DataFrame.unionByName, rest, stop)


def warmup_contexts(samples: DataFrame, oracle: DataFrame, noisy: DataFrame, no_context: float, oracle_share: float, draw) -> DataFrame:
    """(sid, kind, rk, cid): each sample's warm-up context is empty, the oracle's or a noisy one by a drawn number; an empty oracle list leaves the context empty. draw: a column in (0, 1)."""
    kinds = samples.select("sid", F.when(draw < no_context, "none").when(draw < no_context + oracle_share, "oracle").otherwise("noisy").alias("kind"))
    rows = oracle.select("sid", F.lit("oracle").alias("kind"), "rk", "cid").unionByName(noisy.select("sid", F.lit("noisy").alias("kind"), "rk", "cid"))
    return kinds.join(rows, ["sid", "kind"], "left")
