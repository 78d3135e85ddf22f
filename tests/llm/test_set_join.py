from fractions import Fraction
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codectx.llm import set_join as sj

SCHEMA = "chunk_key long, a array<string>, b array<string>, n int, tokens string, class_id long, id long"


def frame(spark, rows):
    return spark.createDataFrame([(k, a, b, 1, "x", 2, 3) for k, a, b in rows], SCHEMA)


def brute(rows, t, least):
    sets = {k: {x for col in (a, b) for x in (col or []) if x is not None} for k, a, b in rows}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}


def found(spark, rows, t=Fraction(7, 10), least=5):
    pairs, members = sj.similar_sets(frame(spark, rows), "chunk_key", ["a", "b"], t, least)
    got = [(r.lo, r.hi) for r in sj.record_pairs(pairs, members).collect()]
    assert len(got) == len(set(got))
    return set(got), sj.record_links(pairs, members)


def test_nulls_copies_sizes_and_threshold(spark):
    s = [f"v{i}" for i in range(10)]
    rows = [(1, s, None), (2, s[:7], s[7:]), (3, s[:7], [None, "v0"]), (4, s[:6], []), (5, None, None), (6, s[:4], s[:4]), (7, [*s[:9], "x"], ["v0"]), (8, ["V0", *s[1:]], None), (9, s[:7], None)]
    got, links = found(spark, rows)
    assert got == brute(rows, 0.7, 5)
    by_key = {r.id: (r.copies, r.links) for r in links.collect()}
    for k, (copies, other) in by_key.items():
        assert copies - 1 + other == sum(k in p for p in got)


def test_hot_value_in_a_third_of_the_rows_and_a_group_of_copies(spark):
    rows = [(i, ["hot", f"a{i}", f"b{i}", f"c{i}", f"d{i}"], None) for i in range(60)] + [(100 + i, ["hot", "k1", "k2", "k3", "k4"], None) for i in range(30)]
    got, _ = found(spark, rows)
    assert got == brute(rows, 0.7, 5)


def test_empty_table(spark):
    assert found(spark, [])[0] == set()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=9), max_size=25), st.sampled_from([Fraction(1, 2), Fraction(7, 10), Fraction(4, 5)]))
def test_any_sets(spark, sets, t):
    rows = [(k, s, None) for k, s in enumerate(sets)]
    assert found(spark, rows, t, 2)[0] == brute(rows, t, 2)


def test_needs_a_column(spark):
    with pytest.raises(Exception):
        sj.similar_sets(frame(spark, []), "chunk_key", ["missing"])[0].collect()


def test_a_hot_value_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(sj, "PART", 4)
    rows = [(i, ["hot", "warm", "k1", "k2", f"k{i % 5}", f"d{i % 7}"], None) for i in range(60)]
    assert found(spark, rows, Fraction(3, 5))[0] == brute(rows, 0.6, 5)
