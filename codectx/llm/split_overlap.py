"""Same or near-same records across splits: winnowing fingerprints, collinear chains of seeds, alignment.

Records with equal tokens form a class; classes are compared, not records. Of each window of consecutive
k-token runs one is selected as fingerprint: the rarest by a table of counts of fixed size, ties by hash. Any order of
the runs keeps winnowing's guarantee (two texts that share ``WINDOW`` consecutive runs share a fingerprint), and this
one keeps boilerplate from becoming a join key where anything rarer stands near.

Fingerprints of train and held-out classes are joined. A fingerprint that stands in very many classes is split: its train
rows are dealt to parts, its held-out rows go to each of them, so no task gets all of them. A row carries its class's number of
runs and a parity signature of them, from which a bound of what two texts can share follows; pairs below it are dropped in the join, before
anything is shuffled for them. The pairs left, each once, are verified on the whole texts; seeds of the verified ones are chained
and extended token by token to say how much of each text is covered.

Why a pair at the threshold shares a fingerprint: let s runs be common to two texts and stand in b + 1 blocks that are in a row in both. Each
of the b breaks costs each text at least 3 runs (those that span it) and 7 in all (an inserted token: 3 and 4; a replaced one: 4 and 4; a moved
block: 3 and 3 at each of its ends). At 0.6 the runs not shared are at most 2s/3, so b <= s/9, and the mean length of a block
is at least s / (s/9 + 1), which is over WINDOW - 1 = 5 from s = 12 on. Texts of at most SHORT runs, which may share fewer, offer all of theirs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import spread, written
from codectx.llm.tokens import TOKEN, owners, portions, run_hashes, token_hashes

__all__ = ["TOKEN", "overlap_coverage", "overlap_report", "record_overlaps", "split_overlaps"]

RUN, WINDOW = 4, 6
#: Texts of at most so many runs offer all of them; in longer ones a pair above the threshold shares WINDOW runs in a row.
SHORT = 32
THRESHOLD = Fraction(3, 5)
#: Counts of runs are kept in 2**SKETCH_BITS numbers, whatever the corpus' size.
SKETCH_BITS = 18
#: Classes above the usual number of a slot's classes that one part of a fingerprint is meant to have.
PART = 5_000
TRAIN, HELD_OUT = "train", ("valid", "test", "repoeval")


def text_of() -> Column:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(e("left_context"), F.lit("\n"), e("target")).alias("text")


def slots(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def distinct(runs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, numbers of their texts) of the different runs of each text, by text and run."""
    order = np.lexsort((runs, own))
    runs, own = runs[order], own[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (own[1:] != own[:-1])
    return runs[first], own[first]


def signatures(runs: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) 64-bit numbers: for each of 128 classes of runs, whether a text has an odd number of them."""
    bits = np.bincount(own * 128 + (runs & np.uint64(127)).astype(np.int64), minlength=n * 128).reshape(n, 128) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def selected(runs: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which runs are the fingerprints of their texts. rank: the place of each slot, the rarest first."""
    n = len(runs)
    counts = np.diff(ends, prepend=0)
    out = np.repeat(counts <= SHORT, counts)
    if n < WINDOW:
        return out
    key = (rank[slots(runs)].astype(np.uint64) << np.uint64(64 - SKETCH_BITS)) | (runs >> np.uint64(SKETCH_BITS))
    m = n - WINDOW + 1
    least = key[:m].copy()
    for k in range(1, WINDOW):
        np.minimum(least, key[k : k + m], out=least)
    whole = np.repeat(ends, counts)[:m] - np.arange(m) >= WINDOW
    for k in range(WINDOW):
        out[k : k + m] |= whole & (key[k : k + m] == least)
    return out


KEYS = "kind byte, sample_id long, split_name string, source string, h1 long, h2 long, runs int"


def keys_and_counts(rows: DataFrame) -> DataFrame:
    """Kind 0: sample_id, split_name, source, two hashes of the tokens, number of runs. Kind 1: h1 a slot, h2 how many texts of the task have a run of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            first, second, runs_of = [], [], []
            for s in portions(texts):
                tokens, ends = token_hashes(texts[s])
                runs, run_ends = run_hashes(tokens, ends, RUN)
                table += np.bincount(slots(distinct(runs, owners(run_ends))[0]), minlength=len(table))
                runs_of.append(np.diff(run_ends, prepend=0))
                for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    h = xxhash.xxh3_128_intdigest(tokens[lo:hi].tobytes())
                    first.append(h >> 64), second.append(h & 0xFFFFFFFFFFFFFFFF)
            n = len(texts)
            whole = [np.array(x, np.uint64).view(np.int64) for x in (first, second)]
            sizes = np.concatenate(runs_of).astype(np.int32) if runs_of else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), b.column("sample_id"), b.column("split_name"), b.column("source"), pa.array(whole[0]), pa.array(whole[1]), pa.array(sizes)], names=[c.split()[0] for c in KEYS.split(", ")])
        at = np.flatnonzero(table)
        none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), *none, pa.array(at), pa.array(table[at]), pa.nulls(len(at), pa.int32())], names=[c.split()[0] for c in KEYS.split(", ")])

    return spread(rows.select("sample_id", "split_name", "source", "text")).mapInArrow(run, KEYS)


def sketch_of(keys: DataFrame) -> np.ndarray:
    """How many texts have a run of each slot; its size doesn't depend on the corpus."""
    rows = keys.filter("kind = 1").groupBy("h1").agg(F.sum("h2").alias("n")).toArrow()
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    table[rows["h1"].to_numpy()] = rows["n"].to_numpy()
    return table


def ranks_and_parts(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each slot by its count, equal counts alike; parts that a fingerprint of the slot is dealt to).

    What a slot has beyond twice the middle one belongs to few runs, as the slots' rare runs add up to about the same everywhere.
    """
    _, rank = np.unique(sketch, return_inverse=True)
    beyond = np.maximum(sketch - 2 * np.median(sketch), 0)
    return rank.astype(np.int32), np.maximum(np.ceil(beyond / PART), 1).astype(np.int32)


PRINTS = "class_id long, train boolean, held boolean, n int, g0 long, g1 long, fp long, parts int"


def fingerprints(classes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(class_id, train, held, n, g0, g1, fp, parts): n is the number of different runs of the class's text, g0 and g1 their signature."""
    shared = classes.sparkSession.sparkContext.broadcast(ranks_and_parts(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, parts = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in portions(texts):
                tokens, ends = token_hashes(texts[s])
                runs, run_ends = run_hashes(tokens, ends, RUN)
                every = owners(run_ends)
                different, of = distinct(runs, every)
                marks = signatures(different, of, len(run_ends))
                sizes = np.bincount(of, minlength=len(run_ends)).astype(np.int32)
                chosen = selected(runs, run_ends, rank)
                r, own = distinct(runs[chosen], every[chosen])
                part = b.slice(s.start, s.stop - s.start)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("class_id").take(take), part.column("train").take(take), part.column("held").take(take), pa.array(sizes[own]), pa.array(marks[own, 0]), pa.array(marks[own, 1]), pa.array(r.view(np.int64)), pa.array(parts[slots(r)])],
                    names=[c.split()[0] for c in PRINTS.split(", ")],
                )

    return classes.select("class_id", "train", "held", "text").mapInArrow(run, PRINTS)


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest list of seeds that go forward in both texts."""
    tails: list[int] = []
    where: list[int] = []
    back: list[int] = []
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    for k, (_, y) in enumerate(seeds):
        at = bisect_left(tails, y)
        back.append(where[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y), where.append(k)
        else:
            tails[at], where[at] = y, k
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def extend(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], gap: int = 3) -> tuple[int, int]:
    """(tokens of a, tokens of b) in agreement along a chain: seeds grow both ways over equal tokens and, between seeds, over up to ``gap`` substitutions in a row."""
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for x, y in seeds:
        if used_a[x] and used_b[y]:
            continue
        for step in (1, -1):
            i, j, bad = (x, y, 0) if step > 0 else (x - 1, y - 1, 0)
            while 0 <= i < len(a) and 0 <= j < len(b) and bad <= gap:
                if a[i] == b[j]:
                    used_a[i] = used_b[j] = True
                    bad = 0
                else:
                    bad += 1
                i, j = i + step, j + step
    return int(used_a.sum()), int(used_b.sum())


def classes_of(samples: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(classes: class_id, train, held, text, of those with runs; members: class_id, sample_id, split_name, source; counts of runs). Rows of other splits take no part."""
    rows = samples.filter(F.col("split_name").isin(TRAIN, *HELD_OUT)).select("sample_id", "split_name", "source", text_of())
    keys = written(keys_and_counts(rows))
    known = keys.filter("kind = 0 and runs > 0")
    ids = known.groupBy("h1", "h2").agg(
        F.min("sample_id").alias("class_id"), F.max(F.col("split_name") == TRAIN).alias("train"), F.max(F.col("split_name") != TRAIN).alias("held")
    )
    members = written(known.join(ids, ["h1", "h2"]).select("class_id", "sample_id", "split_name", "source", "train", "held"))
    leaders = members.filter("sample_id = class_id").select("sample_id", "class_id", "train", "held")
    return rows.select("sample_id", "text").join(leaders, "sample_id").select("class_id", "train", "held", "text"), members.drop("train", "held"), sketch_of(keys)


PAIR = "a long, b long, shared int, either int, seeds int, covered_a double, covered_b double"


def close_enough(threshold: Fraction) -> str:
    """Whether two classes can be a pair by their numbers of runs and their signatures: of |a| + |b| runs, at least as many are not shared as the signatures have bits apart."""
    p, q = threshold.numerator, threshold.denominator
    shared = "(t.n + h.n - bit_count(t.g0 ^ h.g0) - bit_count(t.g1 ^ h.g1))"  # twice the bound
    return f"t.n * {q} >= h.n * {p} and h.n * {q} >= t.n * {p} and {shared} * {p + q} >= 2 * {p} * (t.n + h.n)"


def class_overlaps(classes: DataFrame, sketch: np.ndarray, texts: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(a, b, shared, either, seeds, covered_a, covered_b) of pairs of a class with train rows and another with held-out rows.

    shared and either count different runs, seeds the chain's length, covered the share of each text's tokens in agreement. texts: class_id, text.
    """
    p, q = threshold.numerator, threshold.denominator
    prints = written(fingerprints(classes, sketch))
    rank = classes.sparkSession.sparkContext.broadcast(ranks_and_parts(sketch)[0])
    t = prints.filter("train").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")).alias("t")
    h = prints.filter("held").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("h")
    pairs = (
        t.join(h, F.expr(f"t.fp = h.fp and t.part = h.part and t.class_id <> h.class_id and {close_enough(threshold)}"))
        .select(F.col("t.class_id").alias("a"), F.col("h.class_id").alias("b")).distinct()
    )
    both = (
        pairs.join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("class_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in portions(batch["ta"].tolist(), 1 << 19):
                part = batch.iloc[s]
                known = dict(zip([*part["a"], *part["b"]], [*part["ta"], *part["tb"]]))
                at = {key: k for k, key in enumerate(known)}
                tokens, ends = token_hashes(list(known.values()))
                runs, run_ends = run_hashes(tokens, ends, RUN)
                chosen = selected(runs, run_ends, rank.value)
                span = lambda e, k: slice(e[k - 1] if k else 0, e[k])  # noqa: B023, E731
                sets: dict[int, np.ndarray] = {}
                for one, two in zip(part["a"], part["b"]):
                    i, j = at[one], at[two]
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = np.unique(runs[span(run_ends, k)])
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    either = len(sets[i]) + len(sets[j]) - shared
                    if shared * q >= either * p:
                        x, y = ({r: n for n, (r, c) in reversed(list(enumerate(zip(runs[span(run_ends, k)].tolist(), chosen[span(run_ends, k)].tolist())))) if c} for k in (i, j))
                        line = chain([(n, y[r]) for r, n in x.items() if r in y])
                        u, v = tokens[span(ends, i)], tokens[span(ends, j)]
                        cu, cv = extend(u, v, line)
                        rows.append((one, two, shared, either, len(line), cu / len(u), cv / len(v)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")])

    return both.mapInPandas(verify, PAIR)


def split_overlaps(samples: DataFrame, threshold: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members). Rows of one class agree wholly and don't stand in the pairs.

    samples: sample_id, split_name, source, left_context, target. Null texts are empty; rows with fewer than RUN tokens have no
    runs and are in no pair, not even with equal rows; rows of a null or other split take no part. Repeated rows are members of one class.
    Thresholds below 0.6 would void the reason given above, so they are refused.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"a threshold below {THRESHOLD} isn't sure to give a common fingerprint")
    classes, members, sketch = classes_of(samples)
    return class_overlaps(classes, sketch, samples.select(F.col("sample_id").alias("class_id"), text_of()), threshold), members


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return members.filter(F.col("split_name") == TRAIN), members.filter(F.col("split_name") != TRAIN)


def record_overlaps(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(train_id, held_id) of all rows of paired classes and of those within a class."""
    train, held = _sides(members)
    t, h = train.select("class_id", F.col("sample_id").alias("train_id")), held.select("class_id", F.col("sample_id").alias("held_id"))
    across = pairs.select("a", "b").join(t.withColumnRenamed("class_id", "a"), "a").join(h.withColumnRenamed("class_id", "b"), "b").select("train_id", "held_id")
    return across.unionByName(t.join(h, "class_id").select("train_id", "held_id"))


def overlap_report(samples: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """For each split and source of held-out rows: rows, rows with a train partner, pairs, and the mean coverage of the rows with one.

    Partners are counted by class sizes; no pair of rows is formed.
    """
    pairs, members = split_overlaps(samples, threshold)
    pairs = written(pairs)
    train, held = _sides(members)
    size = train.groupBy("class_id").agg(F.count("*").alias("n"))
    own = size.select(F.col("class_id").alias("b"), "n", F.lit(1.0).alias("covered"))
    other = pairs.join(size.withColumnRenamed("class_id", "a"), "a").select("b", "n", F.col("covered_b").alias("covered"))
    linked = own.unionByName(other).groupBy("b").agg(F.sum("n").alias("n"), F.max("covered").alias("covered"))
    rows = held.join(linked.withColumnRenamed("b", "class_id"), "class_id", "left")
    found = rows.groupBy("split_name", "source").agg(
        F.count("n").alias("overlapping_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.avg("covered"), 6).alias("mean_coverage")
    )
    total = samples.filter(F.col("split_name").isin(*HELD_OUT)).groupBy("split_name", "source").agg(F.count("*").alias("all_rows"))
    t, f = total.alias("t"), found.alias("f")
    return t.join(f, F.col("t.split_name").eqNullSafe(F.col("f.split_name")) & F.col("t.source").eqNullSafe(F.col("f.source")), "left").select(
        "t.split_name", "t.source", F.col("all_rows").alias("rows"), F.coalesce("overlapping_rows", F.lit(0)).alias("overlapping_rows"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "mean_coverage"
    )


def overlap_coverage(samples: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row for each held-out row with a train partner: sample_id, class_id, split_name, source, links (train rows), best_class and the coverage of its tokens by that one.

    The best class covers most; of equals the one of the smallest id. Rows that agree wholly with a train row are covered by their own class.
    """
    pairs, members = split_overlaps(samples, threshold)
    pairs = written(pairs)
    train, held = _sides(members)
    size = train.groupBy("class_id").agg(F.count("*").alias("n"))
    own = size.select(F.col("class_id").alias("b"), F.col("class_id").alias("a"), "n", F.lit(1.0).alias("covered"))
    other = pairs.join(size.withColumnRenamed("class_id", "a"), "a").select("b", "a", "n", F.col("covered_b").alias("covered"))
    best = own.unionByName(other).groupBy("b").agg(F.sum("n").alias("links"), F.min(F.struct((-F.col("covered")).alias("less"), F.col("a"))).alias("best"))
    return held.join(best.withColumnRenamed("b", "class_id"), "class_id").select(
        "sample_id", "class_id", "split_name", "source", "links", F.col("best.a").alias("best_class"), F.round(-F.col("best.less"), 6).alias("coverage")
    )
