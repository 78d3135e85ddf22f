import numpy as np

from codectx.llm import vector_graph as vg

SCHEMA = "vec_id long, vec array<float>, class_id long, cell int, h1 long, other long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 7, 7, 7, 7) for i, v in vectors], SCHEMA)


def brute(vectors, k=5):
    ids = [i for i, v in vectors if v is not None and i != 205 and None not in v and any(v) and not any(np.isnan(v))]
    x = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i in set(ids)}
    out = {}
    for i in ids:
        c = [(-round(float(x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))), 12), j) for j in ids if j != i]
        out[i] = [j for _, j in sorted(c)[:k]]
    return out


def test_small_tables_are_exact_with_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    v = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    v += [(100 + i, v[3][1]) for i in range(9)] + [(200, None), (201, [0.0] * 8), (202, [None] * 8), (203, [float("nan")] * 8), (204, (2 * np.array(v[5][1], np.float32)).tolist()), (205, [1.0, 2.0])]
    got = {}
    for r in vg.nearest_vectors(frame(spark, v)).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.other))
    assert {k: [o for _, o in sorted(x)] for k, x in got.items()} == brute(v)


def test_empty_and_single(spark):
    assert vg.nearest_vectors(frame(spark, [])).collect() == []
    assert vg.nearest_vectors(frame(spark, [(1, [1.0, 0.0])])).collect() == []
    assert [tuple(r) for r in vg.nearest_pairs(vg.nearest_vectors(frame(spark, [(2, [1.0, 0.0]), (1, [1.0, 0.0])]))).collect()] == [(1, 2)]


def test_recall_in_several_cells_of_uneven_density(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    size = [900, 500, 300, *[60] * 9]
    x = np.concatenate([c + 0.15 * rng.normal(size=(n, 24)) for c, n in zip(centres, size)]).astype(np.float32)
    v = [(i, r.tolist()) for i, r in enumerate(x)]
    got = {tuple(r) for r in vg.nearest_vectors(frame(spark, v), cell_rows=500).select("vec_id", "other").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    assert len(got & want) / len(want) >= 0.97


def test_graph_keeps_its_degree_and_is_searchable():
    x = np.random.default_rng(2).normal(size=(700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vg.build_graph(x)
    assert g.shape == (700, vg.DEGREE) and (g < 700).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(g))


def test_scaled_copies_tie_and_go_by_id(spark):
    rng = np.random.default_rng(11)
    v = [(1000 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    one = np.array(v[7][1], np.float32)
    v += [(int(i), (np.float32(s) * one).tolist()) for i, s in zip(rng.permutation(150), np.linspace(0.3, 9, 150))]
    got = {}
    for r in vg.nearest_vectors(frame(spark, v)).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.other))
    want = brute([x for x in v if x[0] != 205])
    copies = [i for i, _ in v if i < 1000] + [1007]
    assert {i: [o for _, o in sorted(got[i])] for i in copies} == {i: want[i] for i in copies}
    assert all(len(x) == 5 for x in got.values()) and len(got) == 210


def test_cells_that_get_too_large_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(vg, "FANOUT", 8)
    monkeypatch.setattr(vg, "MOST", 2)
    monkeypatch.setattr(vg, "SLICE", 700)
    monkeypatch.setattr(vg, "CELL_SAMPLE", 300)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + 0.3 * rng.normal(size=(n, 8)) for c, n in zip(centres, [2500, 300, 200, 100, 50, 50])]).astype(np.float32)
    classes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "class_id long, vec array<float>")
    cells = vg.in_cells(classes, vg.unit(x[::4]), len(x), 8, 150, 300).groupBy("cell", "slice").count().collect()
    assert max(r["count"] for r in cells) <= 300 and sum(r["count"] for r in cells) >= len(x)
    got = {tuple(r) for r in vg.nearest_vectors(classes.withColumnRenamed("class_id", "vec_id"), cell_rows=150).select("vec_id", "other").collect()}
    u = vg.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    assert len(got & want) / len(want) >= 0.9 and len({i for i, _ in got}) == len(x)


def test_vectors_that_cannot_be_told_apart_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(vg, "LEVELS", 1)
    v = [(i, [1.0, 1.0 + 1e-7 * i]) for i in range(400)]
    classes = spark.createDataFrame(v, "class_id long, vec array<double>")
    cells = vg.in_cells(classes, vg.unit(np.array([x for _, x in v])), 400, 2, 20, 40).groupBy("cell", "slice").agg({"class_id": "count"}).collect()
    assert max(r[2] for r in cells) <= 60


def test_lengths_are_collections_of_their_own(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0])]
    assert {(r.vec_id, r.other) for r in vg.nearest_vectors(frame(spark, v)).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
