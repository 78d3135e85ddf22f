from hypothesis import given, settings
from hypothesis import strategies as st

from codectx.llm import splitter as s

LINES = st.lists(st.sampled_from(["def f(x):\n", "    y = 1\n", "\n", "class A:\r\n", "    return y\n", "x" * 40 + "\n", "z" * 130 + "\n", "é = 2\n", "\t# note\n"]), max_size=60)


@settings(max_examples=300)
@given(LINES, st.sampled_from(["", "tail", "q" * 350]), st.integers(1, 9), st.integers(20, 200), st.integers(0, 3))
def test_pieces_cover_the_text_within_the_limits(lines, end, most_lines, most_chars, overlap):
    text = "".join(lines) + end
    own = s.lines_of(text)
    pieces = s.pieces(text, most_lines, most_chars, overlap)
    if len(own) <= most_lines and len(text) <= most_chars:
        assert [p[2:] for p in pieces] == [("whole", text)]
        return
    assert all(len(p[3]) <= most_chars and p[1] - p[0] + 1 <= most_lines for p in pieces)
    covered, last, hard = [""] * len(own), 0, {}
    for first, stop, how, body in pieces:
        if how == "hard":
            hard[first] = hard.get(first, "") + body
            covered[first - 1] = hard[first]
        else:
            assert body == "".join(own[first - 1 : stop])
            covered[first - 1 : stop] = own[first - 1 : stop]
        assert first <= last + 1 and stop >= last
        last = stop
    assert covered == own
    for a, b in zip(pieces, pieces[1:]):
        if "hard" not in (a[2], b[2]):
            assert 0 <= a[1] - b[0] + 1 <= overlap


def test_cuts_stand_at_definitions_and_share_two_lines():
    text = "".join(f"def f{i}(a):\n" + "    a += 1\n" * 20 + "    return a\n\n" for i in range(20))
    pieces = s.pieces(text)
    assert all(p[2] == "boundary" for p in pieces[:-1]) and len(pieces) > 3
    own = s.lines_of(text)
    assert all(own[p[1]].startswith("def ") for p in pieces[:-1])
    assert all(a[1] - b[0] + 1 == 2 for a, b in zip(pieces, pieces[1:]))


def test_frame_nulls_shift_and_kinds(spark):
    long = "x = 1\n" * 121
    rows = [(1, "method", 50, long, "q", 1), (2, None, None, long, "q", 1), (3, "global", 1, "x = 1\n" * 120, "q", 1), (4, "global", 1, None, "q", 1), (5, "global", 1, "", "q", 1), (6, "fallback", 7, "y" * 6001, "q", 1), (1, "method", 50, long, "q", 1)]
    df = spark.createDataFrame(rows, "chunk_key long, chunk_type string, start_line int, text string, cut string, piece_no int")
    out = s.split_oversized(df).collect()
    assert {r.chunk_key for r in out} == {1, 2, 6}
    assert {(r.chunk_type, min(x.start_line for x in out if x.chunk_key == 1)) for r in out if r.chunk_key == 1} == {("method", 50)}
    assert max(r.end_line for r in out if r.chunk_key == 2) == 121
    assert [r.text for r in sorted((r for r in out if r.chunk_key == 6), key=lambda r: r.piece_no)] == ["y" * 6000, "y"]
    assert s.split_oversized(df.limit(0)).collect() == []


def test_pieces_can_be_put_together_again(spark):
    texts = ["a\n" * 300, "x" * 20_000, "\r\n".join(f"line {i}" for i in range(500)), "def f():\n    pass\n\n" * 90 + "y" * 7000 + "\nend", "\n" * 200]
    df = spark.createDataFrame([(i, "k", 1, x) for i, x in enumerate(texts)], "chunk_key long, chunk_type string, start_line int, text string")
    got = {r.chunk_key: r.text for r in s.put_together(s.split_oversized(df)).collect()}
    assert got == dict(enumerate(texts))
    assert s.put_together(s.split_oversized(df.limit(0))).collect() == []
