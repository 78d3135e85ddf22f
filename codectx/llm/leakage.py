"""Evaluation texts leaking into training text: spaced-seed hashing.

Each mask reads some of the token positions under it and ignores the rest, so a seed also hits where ignored tokens
were replaced. The seeds of the evaluation items are joined with those of the documents, inside the tasks that read
the documents or, for very many items, after a filter; around each hit the texts are aligned on the hit's diagonal and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import spread, written
from codectx.llm.tokens import MIX, TOKEN, owners, portions, token_hashes

#: Masks over token positions. No mask is longer than the shortest run that must be found, so that run holds a whole seed of each. Fixed values.
MASKS = ("11101001101011", "110010110111")
MIN_RUN = 15
#: Tokens of evaluation text that an index inside the tasks holds; the seeds of larger sets are joined.
BLOCK_TOKENS = 2_000_000
#: Bits by which seeds are looked for in the index and in the filter before the join, and parts of the documents' seeds there.
INDEX_BITS, FILTER_BITS, PARTS = 22, 26, 8
OUT = "doc_id long, item_id long, run int, aligned int, covered double"


def tokens(text: str) -> list[str]:
    """Maximal runs of ASCII letters, digits and underscores after lower-casing."""
    return TOKEN.findall(text.lower())


def passages(items: DataFrame) -> DataFrame:
    """(item_id, text): left_context, groundtruth, a line break, right_context; null counts as empty."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return items.select("item_id", F.concat(e("left_context"), e("groundtruth"), F.lit("\n"), e("right_context")).alias("text"))


def seeds(x: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the tokens that a mask reads, for each place where it fits into a row of token hashes."""
    n = len(x) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k, c in enumerate(mask):
        if c == "1" and n > 0:
            out = (out ^ x[k : k + n]) * MIX
            out ^= out >> np.uint64(29)
    return out


def seeds_of(tokens: np.ndarray, ends: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, numbers of their texts, places in these) of many texts one after the other."""
    v = seeds(tokens, mask)
    own = owners(ends)[: len(v)]
    begins = np.concatenate(([0], ends[:-1]))
    at = np.arange(len(v))
    whole = at + len(mask) <= ends[own] if len(v) else np.zeros(0, bool)
    return v[whole], own[whole], (at - begins[own])[whole]


def verified(x: np.ndarray, y: np.ndarray, diagonals: list[int]) -> tuple[int, int]:
    """(longest exact run, tokens aligned with substitutions) of two rows of token hashes on any of some diagonals."""
    run = best = 0
    for d in diagonals:
        i, j = max(0, d), max(0, -d)
        n = min(len(x) - i, len(y) - j)
        same = x[i : i + n] == y[j : j + n]
        off = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        run, best = max(run, int(np.diff(off).max()) - 1), max(best, aligned(same))
    return run, best


class SeedIndex:
    """Seeds of items: seed -> (item, place), with a bitmap of them before the search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [key for key, _ in items]
        tokens, self.ends = token_hashes([text for _, text in items])
        self.texts = np.split(tokens, self.ends[:-1]) if len(items) else []
        self.seeds = []
        for mask in MASKS:
            h, item, pos = seeds_of(tokens, self.ends, mask) if len(items) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(h, kind="stable")
            there = np.zeros(1 << INDEX_BITS, bool)
            there[(h >> np.uint64(64 - INDEX_BITS)).astype(np.int64)] = True
            self.seeds.append((h[order], item[order], pos[order], there))

    def search(self, texts: list[str], min_run: int) -> list[tuple[int, int, int, int, float]]:
        """[(number of the text, item id, longest exact run, tokens aligned with substitutions, share of the item)] with a run of at least ``min_run``."""
        tokens, ends = token_hashes(texts)
        begins = np.concatenate(([0], ends[:-1]))
        met: dict[tuple[int, int], set[int]] = {}
        for mask, (h, item, pos, there) in zip(MASKS, self.seeds):
            if not len(h):
                continue
            v = seeds(tokens, mask)
            at = np.flatnonzero(there[(v >> np.uint64(64 - INDEX_BITS)).astype(np.int64)])
            own = np.searchsorted(ends, at, "right")
            ok = at + len(mask) <= ends[own] if len(at) else np.zeros(0, bool)
            at, own = at[ok], own[ok]
            lo, hi = np.searchsorted(h, v[at], "left"), np.searchsorted(h, v[at], "right")
            n = hi - lo
            hit = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            diagonal = np.repeat(at - begins[own], n) - pos[hit]
            for t, k, d in set(zip(np.repeat(own, n).tolist(), item[hit].tolist(), diagonal.tolist())):
                met.setdefault((t, k), set()).add(d)
        out = []
        for (t, k), diagonals in met.items():
            run, al = verified(tokens[begins[t] : ends[t]], self.texts[k], list(diagonals))
            if run >= min_run:
                out.append((t, self.ids[k], run, al, al / len(self.texts[k])))
        return out


def aligned(same: np.ndarray) -> int:
    """Matching tokens of the best stretch of a diagonal, where a match counts 1 and a substitution -2."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(total[: end + 1].argmin())
    return int(same[start:end].sum())


def seed_rows(texts: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """(key, mask, seed, pos) of texts (key, text); with a bitmap, of the seeds whose first bits it has."""
    shared = None if bitmap is None else texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = b.column("text").to_pylist()
            for s in portions(all_texts):
                tokens, ends = token_hashes(all_texts[s])
                keys = b.column(key).slice(s.start, s.stop - s.start)
                for m, mask in enumerate(MASKS):
                    h, own, pos = seeds_of(tokens, ends, mask)
                    if shared is not None:
                        slot = h >> np.uint64(64 - FILTER_BITS)
                        ok = (shared.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                        h, own, pos = h[ok], own[ok], pos[ok]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(np.full(len(h), m, np.int8)), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32))], names=[key, "mask", "seed", "pos"])

    return texts.select(key, "text").mapInArrow(run, f"{key} long, mask byte, seed long, pos int")


def joined_leaks(docs: DataFrame, own: DataFrame, min_run: int) -> DataFrame:
    """find_leaks() for items of any number: one pass over the documents keeps the seeds that a bitmap of the items' seeds has (its size is fixed), these are joined with the items' ones,
    and each document and item that met is verified on the diagonals they met on. Documents' seeds are dealt to parts, to each of which the items' go, so a hot seed is in no one task."""
    spark = docs.sparkSession
    items = written(seed_rows(own, "item_id"))
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = items.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    hits = seed_rows(docs, "doc_id", bitmap).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    dealt = items.withColumnRenamed("pos", "at").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = hits.join(dealt, ["mask", "seed", "part"]).select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("d")).distinct()
    pairs = met.groupBy("doc_id", "item_id").agg(F.collect_list("d").alias("ds"))  # no more than the two texts have tokens
    both = pairs.join(docs, "doc_id").join(own.select("item_id", F.col("text").alias("passage")), "item_id").select("doc_id", "item_id", "ds", "text", "passage")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, item, ds, text, passage in b.itertuples(index=False):
                tokens, ends = token_hashes([text, passage])
                x, y = tokens[: ends[0]], tokens[ends[0] :]
                length, al = verified(x, y, ds.tolist())
                if length >= min_run:
                    rows.append((doc, item, length, al, al / len(y)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return both.mapInPandas(run, OUT)


def find_leaks(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, run, aligned, covered) for each document and item of which ``min_run`` consecutive tokens agree.

    documents: doc_id, text; items: item_id and the columns of passages(). run is the longest exact run, aligned the
    matching tokens of the longest stretch that a few substitutions may interrupt, covered its share of the item.
    Null texts are empty; texts and items with fewer than ``min_run`` tokens can't match; equal documents are each
    reported. The documents are read once. Items of at most ``block_tokens`` tokens are searched inside the tasks that read the documents, by a broadcast index of bounded size, and no
    document is shuffled; of more items the seeds are joined (see joined_leaks). Both ways give the same rows.
    """
    if min_run < max(map(len, MASKS)):
        raise ValueError(f"a run shorter than {max(map(len, MASKS))} tokens may hold no whole seed")
    spark = documents.sparkSession
    own = passages(items).withColumn("n", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).filter(F.col("n") >= min_run)
    size = own.agg(F.sum("n")).first()[0] or 0
    docs = spread(documents.filter(F.length("text") >= 2 * min_run - 1).select("doc_id", "text"))
    if size > block_tokens:
        return joined_leaks(docs, own.select("item_id", "text"), min_run)
    index = spark.sparkContext.broadcast(SeedIndex([tuple(r) for r in own.select("item_id", "text").collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = index.value
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].tolist()
            rows = [(keys[s.start + t], *hit) for s in portions(texts) for t, *hit in found.search(texts[s], min_run)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return docs.mapInPandas(run, OUT)
