import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from codectx.llm import mixing as m

DOCS = "doc_id long, source string, text string, tokens long, repeats int"
TARGETS = "source string, target_share double, max_repeats int, tokens long"


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1000), st.integers(0, 4)), max_size=8), st.floats(0, 5000))
def test_filling_keeps_caps_proportions_and_the_total(sources, total):
    named = [(str(k), w, n, r) for k, (w, n, r) in enumerate(sources)]
    got = m.fill(named, total)
    caps = {s: n * r for s, w, n, r in named}
    room = sum(n * r for _, w, n, r in named if w > 0)
    assert all(-1e-9 <= s.wanted <= caps[s.source] + 1e-6 for s in got)
    assert sum(s.wanted for s in got) == pytest.approx(min(total, room), abs=1e-6)
    free = [s.wanted / s.target for s in got if s.target > 1e-9 and 0 < s.wanted < caps[s.source] - 1e-6]
    assert all(x == pytest.approx(free[0], rel=1e-6) for x in free)


def test_mix(spark):
    docs = [(i, ["big", " Big ", "BIG", "small-one"][i % 4], "word " * (5 + i % 7), 1, 1) for i in range(400)] + [(900, None, "x y", 1, 1), (901, "small_one", None, 1, 1), (902, "small_one", "", 1, 1), (903, "other", "a b c", 1, 1)]
    targets = [("big", 0.5, 1, 1), ("small_one", 0.5, 2, 1), ("missing", 0.1, 3, 1), (None, 0.2, 3, 1), ("none", None, None, 1)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    drawn, report = m.mix(d, t)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"big", "small_one", "missing", "none"}
    assert rows["missing"].tokens_drawn == 0 and rows["small_one"].most_repeats <= 2 and rows["big"].most_repeats <= 1
    taken = {r.doc_id: r.repeats for r in drawn.collect()}
    assert len(taken) == drawn.count() and not {900, 901, 902, 903} & set(taken)
    assert rows["small_one"].mean_repeats == pytest.approx(2.0)
    again = {r.doc_id: r.repeats for r in m.mix(d.repartition(7), t)[0].collect()}
    assert again == taken
    _, some = m.mix(d, t, total=1000)
    r = {x.source: x for x in some.collect()}
    assert r["big"].reached_share == pytest.approx(0.5, abs=0.02) and r["small_one"].tokens_drawn == pytest.approx(500, abs=15)


def test_empty(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2, 0)], TARGETS)
    drawn, report = m.mix(d, t)
    assert drawn.collect() == [] and report.first().reached_share == 0.0
    assert m.mix(d, t.limit(0))[1].collect() == []


def test_whole_texts_are_counted(spark):
    d = spark.createDataFrame([(1, "a", "x" * 200_000 + " <|endoftext|>", 0, 0)], DOCS)
    assert m.token_counts(d).first().tokens == len(m.encoding(m.VOCABULARY).encode_ordinary("x" * 200_000 + " <|endoftext|>"))


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 40), st.integers(0, 4)), min_size=1, max_size=6), st.floats(1, 500))
def test_the_plan_is_where_filling_ends(spark, sources, total):
    counts = spark.createDataFrame([(k, str(k), n) for k, (_, n, _) in enumerate(sources)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(str(k), w, r) for k, (w, _, r) in enumerate(sources)], "source string, target_share double, max_repeats int")
    want = {s.source: s.wanted for s in m.fill([(str(k), w, n, r) for k, (w, n, r) in enumerate(sources)], total)}
    got = {r.source: r.wanted for r in m.plan(counts, targets, total).collect()}
    assert got == {k: pytest.approx(v, abs=0.002) for k, v in want.items()}


def test_copies_are_the_uses(spark):
    docs = [(i, "a" if i % 3 else "b", "word " * (3 + i % 5), 0, 0) for i in range(90)]
    targets = [("a", 0.3, 1, 0), ("b", 0.7, 3, 0)]
    drawn, report = m.mix_counts(m.word_counts(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(targets, TARGETS))
    uses = m.copies(drawn, report).collect()
    assert sorted((r.doc_id, r.copy_no) for r in uses) == sorted((r.doc_id, k) for r in drawn.collect() for k in range(1, r.repeats + 1))
    reached = {r.source: r.reached_share for r in uses}
    assert reached["b"] == pytest.approx(sum(r.tokens for r in uses if r.source == "b") / sum(r.tokens for r in uses), abs=1e-6)


@pytest.mark.parametrize(
    "sources, total, want",
    [  # weights so small that a cap divided by them is infinite, or that a product with them loses its digits
        ([(0.25, 34, 1), (5e-324, 25, 3), (0.5, 15, 4)], 106.75, [34.0, 12.75, 60.0]),
        ([(5e-324, 50, 1), (1e-320, 40, 1), (0.5, 10, 1)], 70.0, [20.0, 40.0, 10.0]),
    ],
)
def test_the_smallest_weights_get_no_more_than_is_left(spark, sources, total, want):
    counts = spark.createDataFrame([(k, str(k), n) for k, (_, n, _) in enumerate(sources)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(str(k), w, r) for k, (w, _, r) in enumerate(sources)], "source string, target_share double, max_repeats int")
    assert [s.wanted for s in m.fill([(str(k), w, n, r) for k, (w, n, r) in enumerate(sources)], total)] == pytest.approx(want, abs=0.002)
    assert [r.wanted for r in m.plan(counts, targets, total).orderBy("source").collect()] == pytest.approx(want, abs=0.002)
