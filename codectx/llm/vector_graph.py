"""Most similar vectors for every vector: robust-pruned directed graphs, built and searched in overlapping cells.

Vectors that are equal form a class, and classes are indexed. Cells are leaves of a bisecting clustering that is fitted to a
sample of bounded size, so that dense regions get as many cells as their mass asks for; a cell that gets too many rows is split again by a
sample of its own, so cells stay of one size whatever the collection's. Every class goes to its nearest cells;
in each of them a graph is built (greedy searches propose neighbours, pruning with a relaxed distance keeps diverse edges),
and every class of the cell is searched in it with a beam. What the cells find is scored in double precision and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codectx.llm.common import written

NEAREST = 5
#: Classes that are meant to be in a cell, cells that a class is in, and how many times CELL_ROWS a cell may have before it is split again.
CELL_ROWS, CELLS_EACH, MOST = 1000, 3, 8
#: Rows that the first cells are fitted to, those that a cell is split by, and the least of these for a cell below; cells below one cell; rounds of splitting.
SAMPLE, CELL_SAMPLE, LEAST_LEAF, FANOUT, CELL_BITS, LEVELS = 20_000, 8_000, 4, 400, 11, 5
#: Rows of a cell that one task places in the cells below.
SLICE = 50_000
#: Steps of a unit vector's elements that tell directions apart, and classes of one direction that are indexed.
STEP, ALIKE = 1e-5, 24
#: Cells that a vector is in on the average: those near a border are in the further ones, by a margin that a sample tells.
COPIES = 1.6
#: Edges of a node, beam of a search that proposes them and of one that answers, nodes expanded at once, nodes that searches begin at.
DEGREE, BEAM, WIDE, RELAX, EXPAND, ENTRIES = 24, 24, 32, 1.1, 4, 32
BATCH = 512


def bisect(points: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = points[rng.choice(len(points), 2, replace=False)]
    side = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        side = (points @ centres.T).argmax(1)
        if side.min() == side.max():
            side = np.arange(len(points)) % 2
        centres = np.stack([points[side == k].mean(0) for k in (0, 1)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return points[side == 0], points[side == 1]


def fit_cells(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centres of about ``cells`` cells with about equally many rows of the sample each."""
    rng = np.random.default_rng(seed)
    leaf = max(LEAST_LEAF, len(sample) / max(1, cells))
    stack, leaves = [sample], []
    while stack:
        p = stack.pop()
        if len(p) <= 1.25 * leaf or len(p) < 2 * LEAST_LEAF:
            leaves.append(p.mean(0))
        else:
            stack += [x for x in bisect(p, rng) if len(x)]
    centres = np.stack(leaves)
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _distinct(ids: np.ndarray, sims: np.ndarray) -> None:
    """Sets the similarity of repeated and of absent (-1) ids in a row to minus infinity."""
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    again = np.zeros(s.shape, bool)
    again[:, 1:] = s[:, 1:] == s[:, :-1]
    rows = np.nonzero(again)
    sims[rows[0], order[rows]] = -np.inf
    sims[ids < 0] = -np.inf


def _top(ids: np.ndarray, sims: np.ndarray, width: int, *more: np.ndarray) -> list[np.ndarray]:
    if ids.shape[1] > width:
        part = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, more = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1), tuple(np.take_along_axis(m, part, 1) for m in more)
    order = np.argsort(-sims, axis=1, kind="stable")
    return [np.take_along_axis(m, order, 1) for m in (ids, sims, *more)]


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best ``width`` nodes found for each query, best first; id -1 where fewer are reached.

    All queries advance together: each step expands the best EXPAND nodes of every beam that aren't expanded yet. Only nodes that a query meets for the first time are scored.
    """
    n = len(queries)
    ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    done = np.zeros((n, width), bool)
    met = np.full((n, len(x)), -1, np.int32)
    live = np.arange(n)

    def meet(rows: np.ndarray, nodes: np.ndarray) -> None:
        """Scores the nodes that are new to their queries, and puts those that are better than the worst of a beam into it."""
        fresh = met[rows, nodes] < 0
        rows, nodes = rows[fresh], nodes[fresh]
        mark = np.arange(len(rows), dtype=np.int32)
        met[rows, nodes] = mark
        once = met[rows, nodes] == mark  # of several edges to a node the last one counts
        rows, nodes = rows[once], nodes[once]
        s = np.einsum("ij,ij->i", x[nodes], queries[rows])
        good = s > sims[rows, -1]
        rows, nodes, s = rows[good], nodes[good], s[good]
        touched, first, count = np.unique(rows, return_index=True, return_counts=True)
        if not len(touched):
            return
        place = np.arange(len(rows)) - np.repeat(first, count)
        at = np.repeat(np.arange(len(touched)), count)
        more = int(count.max())
        new_ids, new_sims = np.full((len(touched), more), -1, np.int32), np.full((len(touched), more), -np.inf, np.float32)
        new_ids[at, place], new_sims[at, place] = nodes, s
        all_sims = np.concatenate([sims[touched], new_sims], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        take = lambda a: np.take_along_axis(a, order, 1)
        sims[touched] = take(all_sims)
        ids[touched] = take(np.concatenate([ids[touched], new_ids], 1))
        done[touched] = take(np.concatenate([done[touched], np.zeros((len(touched), more), bool)], 1))

    meet(np.repeat(live, starts.shape[1]), starts.ravel())
    e = min(EXPAND, width)
    while True:
        open_ = ~done[live] & (ids[live] >= 0)
        going = open_.any(1)
        live, open_ = live[going], open_[going]
        if not len(live):
            return ids.astype(np.int64), sims
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :e]  # beams are sorted: the first open ones are the best
        ok = np.take_along_axis(open_, pick, 1)
        rows = np.broadcast_to(live[:, None], pick.shape)[ok]
        done[rows, pick[ok]] = True
        found = graph[ids[rows, pick[ok]]]
        there = found >= 0
        meet(np.broadcast_to(rows[:, None], found.shape)[there], found[there])


def prune(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node: the nearest is kept, and those that it is nearer to than the node is, by the relaxed distance, go."""
    sims = np.where(ids == nodes[:, None], -np.inf, sims)
    _distinct(ids, sims)
    ids, sims = _top(ids, sims, min(ids.shape[1], 64))
    v = x[ids]
    between = 1 - v @ v.transpose(0, 2, 1)
    far = 1 - sims
    alive = sims > -np.inf
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = alive.argmax(1)
        ok = alive[rows, best]
        if not ok.any():
            break
        out[ok, k] = ids[rows, best][ok]
        alive &= relax * relax * between[rows, best] > far
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, relax: float = RELAX, seed: int = 1) -> np.ndarray:
    """Neighbours (n, degree), -1 where a node has fewer. Nodes are inserted in random order, in batches that double."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    if n < 2:
        return graph
    order = np.random.default_rng(seed).permutation(n)
    first = min(n, 2 * width)
    near = order[:first]
    s = x[near] @ x[near].T
    graph[near] = prune(x, near, np.broadcast_to(near, (first, first)).copy(), s, degree, relax)
    entries = near[:ENTRIES]
    at, size = first, first
    while at < n:
        batch = order[at : at + min(size, BATCH)]
        at += len(batch)
        size *= 2
        ids, sims = beam_search(x, graph, x[batch], np.broadcast_to(entries, (len(batch), len(entries))), width)
        peers = x[batch] @ x[batch].T  # members of a batch don't find each other in the graph
        k = min(len(batch), 8)
        mates = np.argpartition(-peers, k - 1, axis=1)[:, :k]
        ids, sims = np.concatenate([ids, batch[mates]], 1), np.concatenate([sims, np.take_along_axis(peers, mates, 1)], 1)
        graph[batch] = prune(x, batch, ids, sims, degree, relax)
        _reverse(x, graph, batch, degree, relax)
    return graph


def _reverse(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, relax: float) -> None:
    """Adds the edges back from the neighbours of a batch; where a node's edges get too many they are pruned."""
    src = np.repeat(batch, degree)
    dst = graph[batch].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
    most = min(int(count.max()), 3 * degree) if len(count) else 0
    for lo in range(0, len(nodes), BATCH):
        part, s, c = nodes[lo : lo + BATCH], start[lo : lo + BATCH], np.minimum(count[lo : lo + BATCH], most)
        k = np.arange(most)
        new = np.where(k[None, :] < c[:, None], src[np.minimum(s[:, None] + k[None, :], len(src) - 1)], -1)
        ids = np.concatenate([graph[part], new], 1)
        used = np.sort(np.where(ids < 0, np.iinfo(np.int64).max, ids), axis=1)
        few = (used[:, 1:] != used[:, :-1]).sum(1) < degree
        sims = (x[ids] @ x[part][:, :, None])[:, :, 0]
        if few.any():
            a, b = ids[few], sims[few]
            _distinct(a, b)
            a, b = _top(a, b, degree)
            graph[part[few]] = np.where(b > -np.inf, a, -1)
        if (~few).any():
            graph[part[~few]] = prune(x, part[~few], ids[~few], sims[~few], degree, relax)


def search_cell(x: np.ndarray, want: int, width: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``want`` nodes nearest to each row of a cell, itself left out. Each search begins at the row's own node."""
    n = len(x)
    if n <= 2 * width:  # the graph would be complete
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(want, n - 1)
        ids, sims = _top(np.broadcast_to(np.arange(n), (n, n)).copy(), s, max(k, 1))
        return (ids, sims) if n > 1 else (np.full((n, 1), -1), np.full((n, 1), -np.inf, np.float32))
    graph = build_graph(x)
    out = [], []
    for lo in range(0, n, BATCH):
        own = np.arange(lo, min(n, lo + BATCH))
        ids, sims = beam_search(x, graph, x[own], own[:, None], width)
        sims = np.where(ids == own[:, None], -np.inf, sims)
        ids, sims = _top(ids, sims, want)
        out[0].append(ids), out[1].append(sims)
    return np.concatenate(out[0]), np.concatenate(out[1])


def prepared(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, h1, h2, d0, d1) of the usable vectors of ``dim`` elements: null, non-finite and all-zero ones are left out.

    h1 and h2 are hashes of the elements; d0 and d1 hashes of the direction on two grids, of which one is shifted, as copies of a
    scaled vector may lie on both sides of a line.
    """
    rng = np.random.default_rng(dim)
    weights = rng.integers(1, 1 << 63, (4, dim), dtype=np.uint64) | np.uint64(1)

    def hashed(u: np.ndarray, k: int) -> np.ndarray:
        h = ((u ^ (u >> np.uint64(32))) * weights[k]).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec"), dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x, keys = x[good] + 0.0, b.column("vec_id").filter(pa.array(good))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True) / STEP
            h = [hashed(x.view(np.uint64), k) for k in (0, 1)] + [hashed(np.floor(unit + by).astype(np.int64).view(np.uint64), k) for k, by in ((2, 0.25), (3, 0.75))]
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, h)], names=["vec_id", "h1", "h2", "d0", "d1"])

    return vectors.filter(F.size("vec") == dim).select("vec_id", "vec").mapInArrow(run, "vec_id long, h1 long, h2 long, d0 long, d1 long")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists of ``dim`` elements, in double precision; null elements become NaN."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(-1, dim)


def margin_of(sample: np.ndarray, centres: np.ndarray) -> float:
    """How many times as far as its nearest centre another one may be for a vector to be in that cell too, so that vectors are in COPIES cells on the average."""
    far = np.sort(1 - sample @ centres.T, axis=1)[:, :CELLS_EACH]
    ratios = np.sort((far[:, 1:] / np.maximum(far[:, :1], 1e-6)).ravel())
    return float(ratios[min(len(ratios) - 1, int((COPIES - 1) * len(far)))]) if len(ratios) else 1.0


def placed_rows(b: pa.RecordBatch | pa.Table, centres: np.ndarray, margin: float, rank: np.ndarray, cell: np.ndarray) -> pa.Table:
    """Rows (class_id, cell, slice, rank, vec) of vectors in the cells below theirs: the nearest one, and for those of rank 0 the next ones up to CELLS_EACH that aren't farther by the margin."""
    x = unit(matrix(b.column("vec"), centres.shape[1]))
    each = min(CELLS_EACH, len(centres))
    sims = x @ centres.T
    near = np.argsort(-sims, axis=1, kind="stable")[:, :each]
    far = 1 - np.take_along_axis(sims, near, 1)
    keep = (np.arange(each)[None, :] < np.maximum(CELLS_EACH - rank, 1)[:, None]) & ((far <= margin * np.maximum(far[:, :1], 1e-6)) | (np.arange(each)[None, :] == 0))
    at, place = np.nonzero(keep)
    out = (cell[at] << CELL_BITS) | near[at, place]
    take = pa.array(at)
    ranks = np.maximum(rank[at], place).astype(np.int8)
    return pa.table({"class_id": b.column("class_id").take(take), "cell": out, "slice": np.zeros(len(at), np.int32), "rank": ranks, "vec": b.column("vec").take(take)})


def in_cells(classes: DataFrame, sample: np.ndarray, n: int, dim: int, cell_rows: int, most: int) -> DataFrame:
    """(class_id, cell, slice, rank, vec): every class in the cells it belongs to, of which none has more than ``most`` rows.

    The first cells are fitted to a sample of all classes. Those that have got too large, because there are very many rows or a region is dense, are
    fitted and split again, each by a bounded sample of its own; its rows are dealt to slices for that, so that no task gets a whole one. What LEVELS
    rounds could not split (vectors that are nearly the same) is cut into slices by a hash.
    """
    kind = classes.schema["vec"].dataType.elementType.simpleString()
    schema = f"class_id long, cell long, slice int, rank byte, vec array<{kind}>"
    spark = classes.sparkSession
    top = fit_cells(sample, int(min(FANOUT, max(1, -(-n // cell_rows)))))
    centres = spark.sparkContext.broadcast((top, margin_of(sample, top)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            yield from placed_rows(b, *centres.value, np.zeros(m, np.int8), np.ones(m, np.int64)).to_batches()

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        rows, x = t.column("n")[0].as_py() / COPIES, unit(matrix(t.column("vec"), dim))
        c = fit_cells(x, int(min(FANOUT, max(2, -(-rows // cell_rows)))))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "n": t.column("n").slice(0, 1), "margin": pa.array([margin_of(x, c)]), "centres": pa.array([c.ravel()], pa.list_(pa.float32()))})

    def below(key: tuple, t: pa.Table, split: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"class_id": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "slice": pa.array([], pa.int32()), "rank": pa.array([], pa.int8()), "vec": t.column("vec")})
        c = matrix(split.column("centres"), dim).astype(np.float32)
        return placed_rows(t, c, split.column("margin")[0].as_py(), t.column("rank").to_numpy(), t.column("cell").to_numpy())

    current, done = written(classes.select("class_id", "vec").mapInArrow(first, schema)), []
    for level in range(LEVELS + 1):
        sizes = written(current.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most))
        if not sizes.head(1):
            break
        done.append(current.join(sizes, "cell", "left_anti").select("class_id", "cell", "slice", "rank", "vec"))
        over = current.join(sizes, "cell")
        part = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("n") / (most if level == LEVELS else SLICE))).cast("int")
        if level == LEVELS:
            current = over.select("class_id", "cell", part.alias("slice"), "rank", "vec")
            break
        order = F.xxhash64(F.lit(3), "class_id")
        some = over.filter(F.pmod(order, F.col("n")) < 2 * CELL_SAMPLE).withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(order, "class_id")))
        splits = written(some.filter(F.col("place") <= CELL_SAMPLE).select("cell", "n", "vec").groupBy("cell").applyInArrow(fit, "cell long, n long, margin double, centres array<float>"))
        dealt = over.withColumn("slice", part).select("class_id", "cell", "slice", "rank", "vec").groupBy("cell", "slice")
        each = splits.select("cell", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / SLICE) - 1).cast("int"))).alias("slice"), "margin", "centres").groupBy("cell", "slice")
        current = written(dealt.cogroup(each).applyInArrow(below, schema))
    for x in done:
        current = current.unionByName(x)
    return current


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest_classes(classes: DataFrame, sample: np.ndarray, n: int, k: int, dim: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(class_id, other, cos) with, for each class (class_id, vec), the k + 1 nearest classes that each of its cells found; cos rounded to 12 decimals."""

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("class_id")
        keys, exact = t.column("class_id").to_numpy(), matrix(t.column("vec"), dim)
        norms = np.sqrt((exact * exact).sum(1))
        ids, _ = search_cell(unit(exact), k + 6)
        cos = np.full(ids.shape, -np.inf)
        for lo in range(0, len(keys), BATCH):
            at = slice(lo, lo + BATCH)
            cos[at] = np.round((exact[at, None, :] * exact[ids[at]]).sum(2) / (norms[at, None] * norms[ids[at]]), 12)
        cos[ids < 0] = -np.inf
        order = np.lexsort((keys[ids], -cos), axis=1)[:, : k + 1]
        ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
        found = cos > -np.inf
        return pa.table({"class_id": np.repeat(keys, ids.shape[1])[found.ravel()], "other": keys[ids][found], "cos": cos[found]})

    cells = in_cells(classes, sample, n, dim, cell_rows, MOST * cell_rows)
    return cells.select("cell", "slice", "class_id", "vec").groupBy("cell", "slice").applyInArrow(search, "class_id long, other long, cos double")


def of_one_direction(classes: DataFrame, vectors: DataFrame, k: int) -> DataFrame | None:
    """None if no two classes are of one direction, else (class_id, other, cos): for each class (class_id, d0, d1) the k + 1 first other classes of its direction, whose cosines tie; cos exact, rounded to 12 decimals. vectors: class_id, vec."""
    pairs = []
    for d in ("d0", "d1"):
        heads = classes.select("class_id", d).withColumn("place", F.row_number().over(Window.partitionBy(d).orderBy("class_id"))).filter(F.col("place") <= k + 2)
        several = heads.groupBy(d).agg(F.sort_array(F.collect_list("class_id")).alias("heads")).filter(F.size("heads") > 1)  # k + 2 of them at most
        pairs.append(classes.select("class_id", d).join(several, d).select("class_id", F.explode("heads").alias("other")))
    both = written(pairs[0].unionByName(pairs[1]).filter("class_id <> other").distinct())
    if not both.head(1):
        return None
    wide = both.join(vectors, "class_id").join(vectors.select(F.col("class_id").alias("other"), F.col("vec").alias("to")), "other")

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    cos = dot("vec", "to") / F.sqrt(dot("vec", "vec")) / F.sqrt(dot("to", "to"))
    return wide.select("class_id", "other", F.round(cos, 12).alias("cos"))


def nearest_vectors(vectors: DataFrame, k: int = NEAREST, cell_rows: int = CELL_ROWS, dim: int | None = None) -> DataFrame:
    """(vec_id, rank, other, cos): for each usable vector its k nearest others, equal cosines by smaller id; fewer if there are fewer.

    vectors: vec_id, vec (array of any number type; see ``prepared`` for what takes part). Vectors of different lengths have no cosine: each length is
    a collection of its own (only ``dim``, if that is given). Equal vectors are searched once; a class's list holds its own
    members too, of which only the k + 1 smallest ids can be among the k nearest of anything, so no more of them are looked at. Scaled copies
    of a vector tie as well: each gets the first of its direction, and of a direction's classes the first ALIKE are indexed for the other vectors.
    The result is approximate as far as a neighbour lies in no cell of a vector or a beam misses it.
    """
    found = [r[0] for r in vectors.filter(F.size("vec") > 0).select(F.size("vec").alias("d")).distinct().orderBy("d").toLocalIterator()] if dim is None else [dim]
    out = None
    for d in found or [1]:
        near = _of_length(vectors, k, cell_rows, d)
        out = near if out is None else out.unionByName(near)
    return out


def _of_length(vectors: DataFrame, k: int, cell_rows: int, dim: int) -> DataFrame:
    spark = vectors.sparkSession
    narrow = written(prepared(vectors, dim))
    ids = narrow.groupBy("h1", "h2").agg(F.min("vec_id").alias("class_id"))
    members = written(narrow.join(ids, ["h1", "h2"]).select("class_id", "vec_id", "d0", "d1"))
    classes = members.filter("class_id = vec_id").select("class_id", "d0", "d1")
    place = F.row_number().over(Window.partitionBy("d0").orderBy("class_id"))
    leading = written(classes.withColumn("place", place).filter(F.col("place") <= ALIKE).select("class_id"))
    n = leading.count()
    if n == 0:
        return spark.createDataFrame([], "vec_id long, rank int, other long, cos double")
    kind = "float" if isinstance(vectors.schema["vec"].dataType.elementType, T.FloatType) else "double"  # 32-bit elements stay so
    full = vectors.select(F.col("vec_id").alias("class_id"), F.col("vec").cast(f"array<{kind}>").alias("vec"))
    some = full.join(F.broadcast(leading.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE)), "class_id", "left_semi").orderBy("class_id").toArrow()
    sample = unit(matrix(some["vec"], dim))
    near = nearest_classes(full.join(leading, "class_id", "left_semi"), sample, n, k, dim, cell_rows)
    if (ties := of_one_direction(classes, full, k)) is not None:
        near = near.unionByName(ties)
    by_class = Window.partitionBy("class_id").orderBy(F.desc("cos"), "other")
    best = near.repartition("class_id").groupBy("class_id", "other").agg(F.max("cos").alias("cos")).withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= k + 1)
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    several = written(first.groupBy("class_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).filter(F.size("ids") > 1))  # k + 1 of them at most
    own_ids = several.select("class_id", F.explode("ids").alias("other"), F.lit(1.0).alias("cos"))
    lists = best.join(several.withColumnRenamed("class_id", "other"), "other", "left").select("class_id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cos").unionByName(own_ids)
    top = lists.withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= k + 1)
    packed = top.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("place", "other", "cos"))).alias("near"))  # at most k + 1 of them
    own = members.join(packed, "class_id").select("vec_id", F.slice(F.filter("near", lambda s: s["other"] != F.col("vec_id")), 1, k).alias("near"))
    return own.select("vec_id", F.posexplode("near").alias("place", "s")).select("vec_id", (F.col("place") + 1).alias("rank"), F.col("s.other").alias("other"), F.col("s.cos").alias("cos"))


def nearest_pairs(near: DataFrame) -> DataFrame:
    """(vec_lo, vec_hi) of which at least one is among the other's nearest; each pair once."""
    return near.select(F.least("vec_id", "other").alias("vec_lo"), F.greatest("vec_id", "other").alias("vec_hi")).distinct()
