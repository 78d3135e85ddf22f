import random

from codectx.llm import leakage as lk

DOCS = "doc_id long, text string, item_id long, run int"
ITEMS = "item_id long, left_context string, right_context string, groundtruth string, text string"


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def brute(docs, items, least=15):
    out = set()
    for i, left, right, target in items:
        t = lk.tokens(f"{left or ''}{target or ''}\n{right or ''}")
        grams = {tuple(t[k : k + least]) for k in range(len(t) - least + 1)}
        for d, text in docs:
            x = lk.tokens(text or "")
            if any(tuple(x[k : k + least]) in grams for k in range(len(x) - least + 1)):
                out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    rows = lk.find_leaks(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS), **kw).collect()
    got = [(r.doc_id, r.item_id) for r in rows]
    assert len(got) == len(set(got))
    return set(got), rows


def test_runs_of_every_length_blocks_and_edges(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 40)), " ".join(words(rng, 30)), " ".join(words(rng, 10))) for i in range(12)] + [(50, None, None, None), (51, "a b c", "", None), (52, None, " ".join(words(rng, 15)), "")]
    docs = []
    for k in range(80):
        i = items[k % 12]
        t = lk.tokens(f"{i[1]}{i[3]}\n{i[2]}")
        n, at = rng.randrange(10, 25), rng.randrange(0, 50)
        docs.append((k, " ".join([*words(rng, rng.randrange(0, 30)), *t[at : at + n], *words(rng, rng.randrange(0, 30))]).upper().replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [(100, None), (101, ""), (102, items[12 + 2][2]), (103, " ".join(words(rng, 40_000)) + " " + items[0][1]), (104, docs[0][1]), (105, docs[0][1])]
    want = brute(docs, items)
    assert len(want) > 20
    assert found(spark, docs, items)[0] == want
    assert found(spark, docs, items, block_tokens=150)[0] == want


def test_substitutions_are_aligned_across(spark):
    t = [f"t{i}" for i in range(60)]
    leaked = list(t)
    leaked[30] = "changed"
    got, rows = found(spark, [(1, " ".join(leaked))], [(1, " ".join(t), None, None)])
    assert got == {(1, 1)} and rows[0].run == 30 and rows[0].aligned == 59


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a", "b", "c")])[0] == set()
    assert found(spark, [(1, "x " * 50)], [])[0] == set()


def test_each_mask_fits_into_the_shortest_run():
    assert all(len(m) <= lk.MIN_RUN and m[0] == m[-1] == "1" for m in lk.MASKS)
