"""All similar pairs between set-valued records: a prefix-filtered similarity join.

Records with equal sets form a class. Classes are joined, not records: tokens
are ordered by rarity, each class offers only the prefix that the threshold
determines, candidate pairs pass length and positional filters, and what is
left is verified on the whole sets. Members are joined back at the end.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import written

#: Classes with a value that one part of its rows is meant to have.
PART = 5_000


def value_set(columns: list[str]) -> Column:
    """The distinct non-null values of several array columns together; null arrays are empty.

    >>> # ['a', None, 'a'] and None and ['b'] -> ['a', 'b']
    """
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(F.col(c), empty) for c in columns))))


def set_classes(df: DataFrame, id_col: str, columns: list[str], min_size: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of the records whose set has at least ``min_size`` values.

    classes: class_id (smallest id of the class), tokens (sorted 64-bit hashes of the values), n.
    members: class_id, id. A class is known by its set size and two 64-bit hashes of its sorted values,
    so no group of equal records is gathered anywhere.
    """
    hashed = df.select(F.col(id_col).alias("id"), F.array_sort(F.transform(value_set(columns), lambda x: F.xxhash64(x))).alias("tokens"))
    keyed = hashed.filter(F.size("tokens") >= min_size).select(
        "id", "tokens", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), F.col("tokens")).alias("h2")
    )
    ids = keyed.groupBy("n", "h1", "h2").agg(F.min("id").alias("class_id"))
    members = written(keyed.select("id", "n", "h1", "h2").join(ids, ["n", "h1", "h2"]).select("class_id", "id"))
    classes = keyed.join(ids.select(F.col("class_id").alias("id")), "id", "left_semi").select(F.col("id").alias("class_id"), "tokens", "n")
    return classes, members


def class_pairs(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b, shared, either) of every pair a < b of classes with shared >= threshold * either."""
    p, q = threshold.numerator, threshold.denominator
    tokens = classes.select("class_id", "n", F.explode("tokens").alias("t"))
    counts = tokens.groupBy("t").agg(F.count("*").alias("df"))
    #: A value of one class only can't be shared, so it may stand anywhere in the order; it comes first and is no key.
    ranked = tokens.join(counts, "t").groupBy("class_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "t"))).alias("order"))
    ranked = written(ranked)
    prefix = ranked.select(
        "class_id", "n", F.posexplode(F.expr(f"slice(order, 1, n - (n * {p} + {q - 1}) div {q} + 1)")).alias("pos", "key")
    ).filter("key.df > 1").select("class_id", "n", "pos", F.col("key.t").alias("t"), F.ceil(F.col("key.df") / PART).cast("int").alias("parts"))
    # a value of very many classes is split: one side's rows are dealt to parts, the other's go to each of them
    a = prefix.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")).alias("a")
    b = prefix.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    pairs = (
        a.join(b, F.expr(
            f"a.t = b.t and a.part = b.part and a.class_id < b.class_id and a.n * {q} >= b.n * {p} and b.n * {q} >= a.n * {p}"
            # shared <= 1 + what follows on the shorter side, and shared * (p + q) >= p * (|a| + |b|) is wanted
            f" and (least(a.n - a.pos, b.n - b.pos) + least(a.pos, b.pos)) * {p + q} >= (a.n + b.n) * {p}"
        ))
        .select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"))
        .distinct()
    )
    sets = ranked.select("class_id", F.transform("order", lambda x: x["t"]).alias("tokens"))
    both = (
        pairs.join(sets.select(F.col("class_id").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(sets.select(F.col("class_id").alias("b"), F.col("tokens").alias("tb")), "b")
        .withColumn("shared", F.size(F.array_intersect("ta", "tb")))
        .select("a", "b", "shared", (F.size("ta") + F.size("tb") - F.col("shared")).alias("either"))
    )
    return both.filter(f"shared * {q} >= either * {p}")


def similar_sets(df: DataFrame, id_col: str, columns: list[str], threshold: Fraction = Fraction(7, 10), min_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes and their members.

    Returns (pairs: a, b, shared, either; members: class_id, id). Records of one class are similar to each
    other without standing in ``pairs``. Null arrays are empty, null values are left out, repeated values count once,
    records of fewer than ``min_size`` values (all of an empty table) take no part. Other columns of ``df`` are
    not looked at.
    """
    classes, members = set_classes(df, id_col, columns, min_size)
    return class_pairs(classes, threshold), members


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(lo, hi) of all records of paired classes, and of those within a class; each pair once."""
    m = members
    across = (
        pairs.select("a", "b")
        .join(m.select(F.col("class_id").alias("a"), F.col("id").alias("x")), "a")
        .join(m.select(F.col("class_id").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    )
    other = m.select("class_id", F.col("id").alias("hi"))
    within = m.select("class_id", F.col("id").alias("lo")).join(other, "class_id").filter("lo < hi").select("lo", "hi")
    return across.unionByName(within)


def record_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: id, class_id, copies (records of its class), links (records of other classes similar to it).

    Nothing is expanded into pairs of records: class sizes are summed over class pairs.
    """
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = (
        both.join(sizes.select(F.col("class_id").alias("b"), "copies"), "b")
        .groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("links"))
    )
    return (
        members.join(sizes, "class_id").join(links, "class_id", "left")
        .select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
