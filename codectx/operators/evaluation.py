"""Evaluation: confusion, AUC, correlation, gate statistics, policy variants and the gate's claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most quality that may be lost, and retrieval rate that must be saved, for the claim of equal quality. Fixed values.
TOLERANCE, REDUCTION, EPSILON = 0.01, 0.20, 1e-12


def gate_metrics(df: DataFrame, label: Column, p: Column, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1, n. Rows with a null label or probability are left out."""
    rows = df.select(label.alias("l"), (p >= threshold).alias("y")).filter("l is not null and y is not null")
    c = rows.agg(F.count_if(F.expr("l and y")).alias("tp"), F.count_if(F.expr("not l and y")).alias("fp"), F.count_if(F.expr("not l and not y")).alias("tn"), F.count_if(F.expr("l and not y")).alias("fn"), F.count("*").alias("n"))
    precision, recall = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "tn", "fn", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "n")


def auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: the area under the ROC curve, ties counting half; null if a class is missing.

    Counts of each distinct score are summed up, so rows are aggregated before anything is ordered. Ranges of scores
    are summed apart from each other and shifted by the sums of the ranges before, so no task orders all scores.
    """
    rows = df.select(label.alias("l"), score.alias("s")).filter("l is not null and s is not null and not isnan(s)")
    each = rows.groupBy("s").agg(F.count_if(F.expr("l")).alias("p"), F.count_if(F.expr("not l")).alias("q"))
    parts = each.repartitionByRange(F.col("s")).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = parts.withColumn("b", F.coalesce(F.sum("q").over(w), F.lit(0)))
    sums = below.groupBy("part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)).alias("won"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    total = sums.withColumn("b", F.coalesce(F.sum("q").over(before), F.lit(0))).agg(F.sum(F.col("won") + F.col("p") * F.col("b")).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return total.select(F.try_divide(F.col("won"), F.col("p") * F.col("q")).alias("auc"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r of an aggregation; 0 for fewer than two rows or a side without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    r = F.try_divide(F.covar_pop(a, b), sx * sy)
    return F.when((F.count(a) < 2) | (sx <= EPSILON) | (sy <= EPSILON), 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def gate_stats(p: Column, threshold: float = 0.5) -> list[Column]:
    """Aggregates: mean, sample standard deviation (0 for one row) and rate of decisions to retrieve."""
    return [F.avg(p).alias("mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("std"), F.avg((p >= threshold).cast("double")).alias("rate")]


def policy_variants(rows: DataFrame) -> DataFrame:
    """(policy, em, edit, f1, nll, rate) under learned, always_retrieve and always_skip.

    rows: retrieve (the learned decision) and em, edit, f1, nll with and without context (``_with``, ``_without``). Each measure is computed once for
    a row, whatever the number of policies.
    """
    spark = rows.sparkSession
    policies = F.broadcast(spark.createDataFrame([("learned",), ("always_retrieve",), ("always_skip",)], "policy string"))  # three rows
    use = F.when(F.col("policy") == "learned", F.col("retrieve")).otherwise(F.col("policy") == "always_retrieve")
    each = rows.crossJoin(policies).withColumn("use", use)
    pick = lambda c: F.avg(F.when(F.col("use"), F.col(f"{c}_with")).otherwise(F.col(f"{c}_without"))).alias(c)
    return each.groupBy("policy").agg(pick("em"), pick("edit"), pick("f1"), pick("nll"), F.avg(F.col("use").cast("double")).alias("rate"))


def gate_claim(policies: DataFrame, tolerance: float = TOLERANCE, reduction: float = REDUCTION) -> DataFrame:
    """One row: the deltas of learned against always_retrieve, the rate saved and what the gate can claim. policies: policy, em, edit, f1, rate."""
    one = policies.filter("policy = 'learned'").select(*(F.col(c).alias(f"l_{c}") for c in ("em", "edit", "f1", "rate")))
    two = policies.filter("policy = 'always_retrieve'").select(*(F.col(c).alias(f"a_{c}") for c in ("em", "edit", "f1", "rate")))
    d = one.crossJoin(F.broadcast(two))  # one row each
    deltas = [F.col(f"l_{c}") - F.col(f"a_{c}") for c in ("em", "edit", "f1")]
    saved = F.col("a_rate") - F.col("l_rate")
    least, most = F.least(*deltas), F.greatest(*deltas)
    status = (
        F.when((least >= 0) & (most > 0), "adaptive_quality_improvement")
        .when((least >= -tolerance - EPSILON) & (saved >= reduction - EPSILON), "compute_reduction_without_quality_loss")
        .otherwise("gate_claim_not_supported")
    )
    return d.select(*(x.alias(f"delta_{c}") for c, x in zip(("em", "edit", "f1"), deltas)), saved.alias("rate_reduction"), status.alias("status"))
