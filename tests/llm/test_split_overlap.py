from itertools import product

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from codectx.llm import split_overlap as so
from codectx.llm import tokens

SCHEMA = "sample_id long, split_name string, source string, left_context string, target string, file_path string, text string, class_id long"


def words(k, n=60, salt=0):
    return " ".join(f"w{(i * 7 + salt) % 997}_{k}" for i in range(n))


def brute(rows):
    def runs(r):
        t = so.TOKEN.findall(f"{r[3] or ''}\n{r[4] or ''}".lower())
        return {tuple(t[i : i + 4]) for i in range(len(t) - 3)}

    out = set()
    for a, b in product(rows, rows):
        if a[1] == "train" and b[1] in so.HELD_OUT:
            x, y = runs(a), runs(b)
            if x and y and 5 * len(x & y) >= 3 * len(x | y):
                out.add((a[0], b[0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "clash", 5) for r in rows], SCHEMA)


def found(spark, rows):
    pairs, members = so.split_overlaps(frame(spark, rows))
    got = [(r.train_id, r.held_id) for r in so.record_overlaps(pairs, members).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_finds_what_brute_force_finds(spark):
    base = words("a", 80).split()
    rows = [(1, "train", "s", " ".join(base), "x y z")]
    for k in range(12):  # more and more substitutions
        t = list(base)
        for i in range(k):
            t[(i * 13 + 5) % 80] = f"new{k}_{i}"
        rows.append((10 + k, "test", "s", " ".join(t), "x y z"))
    rows += [(40, "valid", None, " ".join(base[:50]), ""), (41, "repoeval", "q", " ".join(base[40:] + base[:40]), None), (42, "train", "q", words("b", 40), "t")]
    rows += [(43, "test", "q", words("b", 40).upper(), "t"), (44, None, "q", words("b", 40), "t"), (45, "other", "q", words("b", 40), "t")]
    rows += [(46, "train", "q", "a b c d e f", "g"), (47, "test", "q", "a b c d e f", "h"), (48, "test", "q", "a b", ""), (49, "train", "q", "a b", None)]
    assert found(spark, rows) == brute(rows)


def test_nulls_blanks_and_empty_tables(spark):
    rows = [(1, "train", None, None, None), (2, "test", None, None, None), (3, "train", None, "", " "), (4, "test", None, "\n", None), (5, "train", None, "one two three", ""), (6, "test", None, "one two three", "")]
    assert found(spark, rows) == set()
    assert found(spark, []) == set()
    assert so.overlap_report(frame(spark, [])).collect() == []


def test_copies_of_a_text_on_both_sides(spark):
    text = words("hot", 50)
    rows = [(i, "train" if i % 2 else "test", "s", text, "t") for i in range(40)] + [(100, "test", "s", words("near", 3) + " " + text, "t")]
    assert found(spark, rows) == brute(rows)
    report = so.overlap_report(frame(spark, rows)).first()
    assert (report.rows, report.overlapping_rows, report.pairs) == (21, 21, 21 * 20)


def test_a_very_long_text(spark):
    long = words("l", 30_000)
    rows = [(1, "train", "s", long, "t"), (2, "valid", "s", "start " + long, "t")]
    assert found(spark, rows) == {(1, 2)}


def test_windows_that_two_texts_share_give_a_common_fingerprint():
    rank = np.random.default_rng(1).integers(0, 9, 1 << so.SKETCH_BITS)
    shared = [f"s{i}" for i in range(so.RUN + so.WINDOW - 1)]
    for seed in range(40):
        rng = np.random.default_rng(seed)
        noise = lambda n: [f"n{rng.integers(1 << 40)}" for _ in range(n)]  # noqa: B023,E731
        texts = [" ".join(x) for x in (noise(40) + shared + noise(30), noise(35) + shared + noise(50))]
        runs, ends = so.run_hashes(*so.token_hashes(texts), so.RUN)
        chosen = so.selected(runs, ends, rank)
        assert set(runs[: ends[0]][chosen[: ends[0]]].tolist()) & set(runs[ends[0] :][chosen[ends[0] :]].tolist())


@given(st.lists(st.sampled_from(["", " ", None, "a B c_1 d e", "a b c_1 d e f g", "\u212a x y z", "na\u00efve " * 3, "x" * 70, "p q r s " * 9]), max_size=6))
def test_hashes_over_many_texts_are_those_of_each(texts):
    h, ends = so.token_hashes(texts)
    words = [so.TOKEN.findall((x or "").lower()) for x in texts]
    assert np.diff(ends, prepend=0).tolist() == [len(w) for w in words]
    name = dict(zip(h.tolist(), [w for x in words for w in x]))
    assert [name[x] for x in h.tolist()] == [w for x in words for w in x]
    runs, run_ends = so.run_hashes(h, ends, so.RUN)
    grams = [tuple(w[k : k + so.RUN]) for w in words for k in range(len(w) - so.RUN + 1)]
    assert len(grams) == len(runs) == (run_ends[-1] if len(texts) else 0) and len(set(grams)) == len(set(runs.tolist()))


def test_pieces_of_a_long_text_are_cut_between_tokens(monkeypatch):
    text = " ".join(f"w{i}" * (1 + i % 9) for i in range(3000))
    whole = so.token_hashes([text, "end"])
    monkeypatch.setattr(tokens, "PIECE", 64)
    cut = so.token_hashes([text, "end"])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@given(st.sets(st.integers(0, 300), min_size=1), st.sets(st.integers(0, 300), min_size=1))
def test_signatures_bound_what_is_shared(x, y):
    runs = [np.array(sorted(s), np.uint64) * tokens.MIX for s in (x, y)]
    marks = so.signatures(np.concatenate(runs), np.repeat([0, 1], [len(x), len(y)]), 2)
    apart = sum(int(a ^ b).bit_count() if a ^ b >= 0 else int((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() for a, b in zip(*marks.tolist()))
    assert 2 * len(x & y) <= len(x) + len(y) - apart


def test_a_hot_fingerprint_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(so, "PART", 2)
    common = words("hot", 40)
    rows = [(k, "train" if k % 3 else "test", "s", f"{common} tail{k} more{k}", "t") for k in range(60)]
    sketch = np.zeros(1 << so.SKETCH_BITS, np.int64)
    sketch[5] = 60
    assert so.ranks_and_parts(sketch)[1][5] == 30
    assert found(spark, rows) == brute(rows)


def test_coverage_of_each_record(spark):
    base = words("a", 80)
    rows = [(1, "train", "s", base, "t"), (2, "train", "s", base, "t"), (3, "test", "s", base, "t"), (4, "valid", "q", base + " one two three", "t"), (5, "test", "s", words("z", 50), "t")]
    got = {r.sample_id: (r.links, r.best_class, r.coverage) for r in so.overlap_coverage(frame(spark, rows)).collect()}
    assert got[3] == (2, 1, 1.0) and got[4][:2] == (2, 1) and 0.9 < got[4][2] < 1 and set(got) == {3, 4}
    assert so.overlap_coverage(frame(spark, [])).collect() == []


def test_chain_is_collinear_and_extension_crosses_substitutions():
    assert so.chain([(0, 5), (1, 1), (2, 2), (3, 0), (4, 6)]) == [(1, 1), (2, 2), (4, 6)]
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint64)
    b = np.array([1, 2, 9, 4, 5, 6, 7, 8], np.uint64)
    assert so.extend(a, b, [(4, 4)]) == (7, 7)
