"""How much a context helps: utilities, preference pairs, gate labels, leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.functions.text import identifiers


def smoothed_unigram_nll(samples: DataFrame, contexts: DataFrame) -> DataFrame:
    """(sid, strategy, nll) by the default scorer: the mean over a target's tokens of -ln((c + 1) / (N + V)).

    c counts the token in the sample's left context and the strategy's chunks together, N all their tokens, V the different ones and the target's.
    samples: sid, left_context, target; contexts: sid, strategy, text (several rows make one context, a null text is an empty context). An empty target costs 0.
    A context is the few chunks that a strategy offers, so its tokens are put together in its row, and counted there for the target's tokens only: one shuffle by sample and strategy, one join.
    """
    own = contexts.groupBy("sid", "strategy").agg(F.flatten(F.collect_list(identifiers(F.col("text")))).alias("own"))
    texts = samples.select("sid", identifiers(F.col("left_context")).alias("left"), identifiers(F.col("target")).alias("goal"))
    rows = own.join(texts, "sid").select("sid", "strategy", F.concat("left", "own").alias("tokens"), "goal")
    size = (F.size("tokens") + F.size(F.array_distinct(F.concat("tokens", "goal")))).cast("double")
    held = F.filter("tokens", lambda x: F.array_contains("goal", x))
    # a list of one, as its element is computed once, while a column would be computed anew for each token of the target
    once = F.array(F.struct(size.alias("size"), held.alias("held")))
    cost = F.transform(once, lambda o: F.aggregate("goal", F.lit(0.0), lambda s, w: s - F.ln((F.size(F.filter(o["held"], lambda x: x == w)) + 1.0) / o["size"])))[0]
    return rows.select("sid", "strategy", F.when(F.size("goal") > 0, cost / F.size("goal")).otherwise(0.0).alias("nll"))


def utilities(scores: DataFrame) -> DataFrame:
    """(sid, strategy, pos, is_stop, nll, utility, rk): utility is the stop context's nll minus one's own; ranked by utility, then order of the strategies.

    scores: sid, strategy, pos, is_stop, nll, with one stop row for each sid.
    """
    of = Window.partitionBy("sid")
    stop = F.max(F.when(F.col("is_stop"), F.col("nll"))).over(of)
    with_utility = scores.withColumn("utility", F.when(F.col("is_stop"), 0.0).otherwise(stop - F.col("nll")))
    return with_utility.withColumn("rk", F.row_number().over(of.orderBy(F.desc("utility"), F.asc("nll"), F.asc("pos"))))


def preference_pairs(ranked: DataFrame, margin: float = 0.1, most: int = 4) -> DataFrame:
    """(sid, chosen, rejected, gap) of strategies whose utilities are at least ``margin`` apart, the first ``most`` in rank order (at least one)."""
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.rk") < F.col("b.rk")) & (F.col("a.utility") - F.col("b.utility") >= margin))
    order = Window.partitionBy("a.sid").orderBy("a.rk", "b.rk")
    kept = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, most))
    return kept.select(
        F.col("a.sid").alias("sid"), F.col("a.strategy").alias("chosen"), F.col("b.strategy").alias("rejected"), (F.col("a.utility") - F.col("b.utility")).alias("gap")
    )


def gate_labels(ranked: DataFrame, margin: float = 0.05) -> DataFrame:
    """(sid, retrieve_is_better, max_utility, best_strategy) from the contexts that aren't the stop; better means more than ``margin``."""
    best = ranked.filter(~F.col("is_stop")).groupBy("sid").agg(F.min(F.struct("rk", "utility", "strategy")).alias("b"))
    return best.select("sid", (F.col("b.utility") > margin).alias("retrieve_is_better"), F.col("b.utility").alias("max_utility"), F.col("b.strategy").alias("best_strategy"))


def gate_counts(labels: DataFrame) -> DataFrame:
    """One row: positives, negatives, positive ratio, mean of the largest utilities."""
    return labels.agg(
        F.count_if("retrieve_is_better").alias("positives"), F.count_if(~F.col("retrieve_is_better")).alias("negatives"),
        F.coalesce(F.avg(F.col("retrieve_is_better").cast("double")), F.lit(0.0)).alias("positive_ratio"), F.coalesce(F.avg("max_utility"), F.lit(0.0)).alias("mean_max_utility"),
    )


def pair_types(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return pairs.groupBy(F.concat_ws(">", F.col(chosen), F.col(rejected)).alias("pair_type")).agg(F.count("*").alias("n"))


def without_each(contexts: DataFrame) -> DataFrame:
    """(sid, strategy, text): for each set of more than one chunk the whole set ('full') and the set without each chunk ('without <rk>'). contexts: sid, rk, text."""
    sized = contexts.withColumn("_n", F.count("*").over(Window.partitionBy("sid"))).filter("_n > 1")
    full = sized.select("sid", F.lit("full").alias("strategy"), "text")
    left_out = sized.select("sid", F.col("rk").alias("_out"))
    rest = left_out.join(sized.select("sid", "rk", "text"), "sid").filter("rk <> _out")
    return full.unionByName(rest.select("sid", F.format_string("without %d", "_out").alias("strategy"), "text"))


def leave_one_out(nll: DataFrame) -> DataFrame:
    """One row over all sets: sets, chunks, positive and negative contributions, their mean, the share of noisy ones. nll: sid, strategy ('full', 'without ..'), nll."""
    full = nll.filter("strategy = 'full'").select("sid", F.col("nll").alias("whole"))
    each = nll.filter("strategy <> 'full'").join(full, "sid").select("sid", (F.col("nll") - F.col("whole")).alias("gain"))
    return each.agg(
        F.count_distinct("sid").alias("sets"), F.count("*").alias("chunks"), F.count_if(F.col("gain") > 1e-12).alias("positive"), F.count_if(F.col("gain") < -1e-12).alias("negative"),
        F.coalesce(F.avg("gain"), F.lit(0.0)).alias("mean_contribution"), F.coalesce(F.try_divide(F.count_if(F.col("gain") < -1e-12).cast("double"), F.count("*")), F.lit(0.0)).alias("noisy_fraction"),
    )


def dpo_loss(chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column, beta: float = 0.1) -> Column:
    """-ln sigmoid(beta * ((chosen - rejected) - (chosen_ref - rejected_ref))); ln 2 where nothing has moved."""
    return F.log1p(F.exp(-beta * ((chosen - rejected) - (chosen_ref - rejected_ref))))


def gate_loss(p: Column, label: Column, entropy: float = 0.01) -> Column:
    """Binary cross entropy minus a little of the prediction's own entropy."""
    q = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), p))
    return -F.when(label, F.ln(q)).otherwise(F.ln(1 - q)) + entropy * (q * F.ln(q) + (1 - q) * F.ln(1 - q))
