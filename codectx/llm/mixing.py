"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.llm.common import spread, written

#: A byte-level BPE of 50,256 ranks; any file of lines 'base64 rank' will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that this vocabulary's texts are cut by. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 17
#: Slices of the hash by which a source's fractional repetition is drawn; only one slice is ordered.
SLICES = 1 << 12
#: Rows up to which a table with one row for each source is broadcast.
BROADCAST_ROWS = 100_000
#: What weights are multiplied by where something is divided by them, so that the smallest ones don't give infinity. A power of two, which changes no digit.
SCALE = 2.0**128


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """One spelling of a source: no outer white space, lower case, '_' for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): source in one spelling, tokens of the whole text; null texts have none. The vocabulary's file goes to the executors with the job."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(encode(x)) for x in b["text"]]})

    texts = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return spread(texts).mapInPandas(run, "doc_id long, source string, tokens long")


def word_counts(documents: DataFrame) -> DataFrame:
    """As token_counts(), with runs of ASCII letters, digits and underscores for tokens: sizes that need no vocabulary."""
    n = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))
    return documents.select("doc_id", source_key(F.col("source")).alias("source"), n.cast("long").alias("tokens"))


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    tokens: int
    repeats: int
    wanted: float  # tokens to take, after clamping


def fill(sources: list[tuple[str, float, int, int]], total: float) -> list[Share]:
    """Tokens to take of each (source, weight, tokens, most repeats), together ``total`` or all there is.

    A source whose part would exceed its cap (tokens times repeats) is clamped to it; what is left goes to the others in
    proportion to their weights, until no cap is exceeded. Sources of weight 0 or without tokens get nothing.

    >>> [round(s.wanted) for s in fill([("a", .5, 100, 1), ("b", .25, 1000, 1), ("c", .25, 1000, 1)], 400)]
    [100, 150, 150]
    """
    open_ = {s: (w, float(n * r)) for s, w, n, r in sources if w > 0 and n * r > 0}
    got = {s: 0.0 for s, *_ in sources}
    left = float(total)
    while open_ and left > 0:
        weight = sum(w for w, _ in open_.values())
        full = {s: cap for s, (w, cap) in open_.items() if left * (w / weight) >= cap}
        if not full:
            got.update({s: left * (w / weight) for s, (w, _) in open_.items()})
            break
        for s, cap in full.items():
            got[s] = cap
            left -= cap
            del open_[s]
    return [Share(s, w, n, r, got[s]) for s, w, n, r in sources]


def plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n, wanted) of the sources of ``targets`` (source, target_share, max_repeats): tokens there are and tokens to take.

    total: tokens of the mix; by default those of all documents of these sources. Spellings of one source count as one, their shares add up.
    A null share or number of repeats counts as 0, a null source is left out.

    This is where fill() ends, found without its rounds: in the order of cap / weight, a source is clamped if what is left for it and those behind it
    would still lift it to its cap. The window runs over one row for each source, not over documents.
    """
    wanted = targets.filter(F.col("source").isNotNull()).groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("r")
    )
    have = counts.groupBy("source").agg(F.sum("tokens").alias("n"))
    every = wanted.join(have, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("cap", (F.col("n") * F.col("r")).cast("double"))
    active = (F.col("w") > 0) & (F.col("cap") > 0)
    order = Window.partitionBy("active").orderBy("ratio", "source")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("active")
    goal = F.sum("n").over(whole).cast("double") if total is None else F.lit(float(total))
    left, weight = goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(behind)
    rows = every.withColumn("active", active).withColumn("ratio", F.when(active, F.try_divide("cap", F.col("w") * SCALE))).withColumn("left", left).withColumn("weight", weight)
    rows = rows.withColumn("full", F.col("left") * F.try_divide("w", "weight") >= F.col("cap"))
    first = F.min(F.when(~F.col("full"), F.struct("ratio", "source", "left", "weight"))).over(whole)
    take = F.when(~F.col("active"), 0.0).when(F.col("full"), F.col("cap")).otherwise(F.greatest(first["left"], F.lit(0.0)) * F.try_divide(F.col("w"), first["weight"]))
    return rows.select("source", F.col("w").alias("target_share"), F.col("r").alias("max_repeats"), "n", F.round(take, 3).alias("wanted"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most so many rows; a larger one is joined as any other."""
    return F.broadcast(df) if df.count() <= rows else df


def draw(counts: DataFrame, shares: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents in the mix.

    Every document of a source is taken the whole number of times; the fraction is the source's documents in
    the order of a seeded hash until its tokens are reached. Where that point lies is found from sums over slices of the hash
    (aggregated before they are shuffled), and only the documents of the slice it lies in are ordered, so a source may hold any part of all rows.
    """
    whole = F.floor(F.try_divide("wanted", "n"))
    share = small(shares.filter("wanted > 0").select("source", whole.cast("int").alias("whole"), F.round(F.col("wanted") - whole * F.col("n"), 3).alias("part")))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")), 256), 1, 13), 16, 10).cast("long")
    docs = counts.filter("tokens > 0").join(share, "source").withColumn("h", h).withColumn("slice", (F.col("h") / ((1 << 52) // SLICES)).cast("int"))
    sums = docs.groupBy("source", "slice", "part").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n"))
    border = small(written(before.filter("before < part").groupBy("source").agg(F.max("slice").alias("border"), F.max("before").alias("before"))))
    placed = docs.join(border, "source", "left")
    inner = Window.partitionBy("source").orderBy("h", "doc_id")
    ordered = placed.filter("slice = border").withColumn("run", F.sum("tokens").over(inner) - F.col("tokens") + F.col("before"))
    extra = ordered.withColumn("repeats", F.col("whole") + (F.col("run") + F.col("tokens") / 2 <= F.col("part")).cast("int"))
    rest = placed.filter("border is null or slice <> border").withColumn("repeats", F.col("whole") + F.coalesce(F.col("slice") < F.col("border"), F.lit(False)).cast("int"))
    columns = ["doc_id", "source", "tokens", "repeats"]
    return rest.select(columns).unionByName(extra.select(columns)).filter("repeats > 0")


def mix_counts(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, report by source) from sizes (doc_id, source, tokens); see mix()."""
    shares = written(plan(counts, targets, total))
    drawn = draw(counts, shares, seed)
    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_drawn"), F.max("repeats").alias("most_repeats"))
    joined = shares.join(sums, "source", "left").withColumn("tokens_drawn", F.coalesce("tokens_drawn", F.lit(0)))
    everything = Window.partitionBy()
    return drawn, joined.select(
        "source", F.round("target_share", 9).alias("target_share"), F.round(F.coalesce(F.try_divide(F.col("tokens_drawn"), F.sum("tokens_drawn").over(everything)), F.lit(0.0)), 6).alias("reached_share"),
        F.col("n").alias("tokens_available"), "tokens_drawn", F.round(F.coalesce(F.try_divide(F.col("tokens_drawn"), F.col("n")), F.lit(0.0)), 6).alias("mean_repeats"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, report by source).

    documents: doc_id, source, text; targets: source, target_share, max_repeats. Documents of sources without a target, of null source or
    without tokens are not drawn. The report has every target: the share wanted and reached (of all drawn tokens), tokens there are, tokens
    drawn, mean and most repeats. Empty tables give an empty mix and shares of 0.
    """
    return mix_counts(written(token_counts(documents, vocabulary)), targets, total, seed)


def copies(drawn: DataFrame, report: DataFrame) -> DataFrame:
    """One row for each time a document is used: doc_id, copy_no (from 1), source, tokens, and the share its source was to have and has reached."""
    each = drawn.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy_no"))
    return each.join(small(written(report.select("source", "target_share", "reached_share"))), "source").select("doc_id", "copy_no", "source", "tokens", "target_share", "reached_share")
