import numpy as np
import pytest
from pyspark.sql import functions as F

from codectx.operators import chunking, entities, structural

SERVICE = '''import db

class UserService(Base, a.Mixin[int]):
    """Users."""
    limit = 3

    def get(self, user_id):
        return self.db.fetch_user(user_id)

def helper(x):
    return x
'''
GLOBALS = '''import os

LIMIT = 3

class A:
    """Doc."""
    def f(self):
        return os

run(LIMIT)
'''


def chunks(spark, source, **kw):
    df = spark.createDataFrame([(1, "a.py", source, "clash")], "k int, path string, content string, text string")
    return entities.entity_chunks(df, ["k"], "path", "content", **kw).orderBy("chunk_pos").collect()


def test_entities(spark):
    out = chunks(spark, SERVICE)
    assert [(c.chunk_type, c.start_line, c.end_line) for c in out] == [("global", 1, 1), ("class_header", 3, 4), ("method", 7, 8), ("function", 10, 11)]
    head, method = out[1], out[2]
    assert head.class_bases == ["Base", "a.Mixin"] and head.method_names == ["get"] and head.defined_symbols == ["UserService"]
    assert method.parent_class == "UserService" and method.defined_symbols == ["get"] and "fetch_user" in method.call_names and method.text.startswith("    def get")


def test_globals_span_what_lies_between_and_leftovers_follow(spark):
    out = chunks(spark, GLOBALS)
    assert [(c.start_line, c.end_line) for c in out if c.chunk_type == "global"] == [(1, 3), (10, 10)]
    assert [(c.start_line, c.end_line) for c in out if c.chunk_type == "method"] == [(7, 8)]
    assert out[0].defined_symbols == ["os", "LIMIT"] and out[-1].defined_symbols == ["run", "LIMIT"]


@pytest.mark.parametrize("source,want", [
    ("def f(:\n  pass", [("fallback", 1, 1, "def f(:"), ("fallback", 2, 2, "  pass")]), ("", [("fallback", 1, 1, "")]), (None, [("fallback", 1, 1, "")]), ("\n\n", [("fallback", 1, 1, ""), ("fallback", 2, 2, "")]),
    ("class A:\n    x = 1\n", [("class_header", 1, 1, "class A:"), ("class_body", 1, 2, "class A:\n    x = 1")]), ("@d\ndef f(): pass\n", [("function", 2, 2, "def f(): pass"), ("global", 1, 1, "@d")]),
])
def test_odd_files(spark, source, want):
    assert [(c.chunk_type, c.start_line, c.end_line, c.text) for c in chunks(spark, source, fallback=1)] == want


def test_long_functions_are_split_and_only_the_first_piece_defines(spark):
    out = chunks(spark, "def f():\n" + "    x = 1\n" * 300)
    assert [(c.start_line, c.end_line, c.defined_symbols) for c in out] == [(1, 120, ["f"]), (121, 240, []), (241, 301, [])]


def test_windows_runs_and_ids(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc\nd\ne"), (2, ""), (3, None), (4, "\n \n"), (5, "x\n")], "k int, t string")
    w = {(r.k, r.start_line, r.end_line, r.text) for r in chunking.line_windows(df, "t", 4, ["k"]).collect()}
    assert w == {(1, 1, 4, "a\nb\n\nc"), (1, 5, 6, "d\ne"), (2, 1, 1, ""), (3, 1, 1, ""), (4, 1, 2, "\n "), (5, 1, 1, "x")}
    assert {(r.k, r.end_line) for r in chunking.line_windows(df, "t", 9, ["k"], newline_only=True).collect()} == {(1, 6), (2, 1), (3, 1), (4, 3), (5, 2)}
    runs = {(r.k, r.run_no, r.start_line, r.end_line, r.text) for r in chunking.line_runs(df, "t", 2, "k").collect()}
    assert runs == {(1, 1, 1, 2, "a\nb"), (1, 2, 4, 5, "c\nd"), (1, 3, 6, 6, "e"), (5, 1, 1, 1, "x")}
    taken = spark.createDataFrame([(1, 4, 5)], "k int, start_line int, end_line int")
    assert {(r.start_line, r.end_line) for r in chunking.line_runs(df, "t", 2, "k", taken).filter("k = 1").collect()} == {(1, 2), (6, 6)}
    with pytest.raises(ValueError):
        chunking.line_windows(df, "t", 0, ["k"])


def test_pool_fingerprint_ranges_and_retrieval_text(spark):
    df = spark.createDataFrame([(1, "g", "b", 1, 9), (2, "g", "a", 2, 4), (3, "g", "a", 4, 12), (4, "h", "a", None, 3), (5, None, "c", 1, 2), (6, "g", "z", 9, 5)], "k int, g string, id string, start_line int, end_line int")
    assert {(r.g, r.id): r.k for r in chunking.first_by_id(df, ["g", "id"], ["k"]).collect()} == {("g", "b"): 1, ("g", "a"): 2, ("h", "a"): 4, ("g", "z"): 6}
    from codectx.sources.sinks import ids_fingerprint

    assert {r.g: r.fingerprint for r in chunking.fingerprint(df, ["g"], "id", ["k"]).collect()}["g"] == ids_fingerprint(["b", "a", "a", "z"])
    assert {(r.a, r.b, r.contains) for r in chunking.range_relations(df, "k", ["g"]).collect()} == {(1, 2, True), (2, 1, False), (1, 3, False), (3, 1, False), (2, 3, False), (3, 2, False)}
    one = spark.range(1).select(chunking.retrieval_text(F.lit("a.py"), F.lit(1), F.lit(3), F.lit("method"), F.lit("K"), F.lit("x\n"))).first()[0]
    assert one == "### File: a.py L1-3 [method] class=K\nx"


def test_sums_without_white_space():
    data = "def f():\n\treturn 'é'\n".encode()
    sums = structural.nws_sums(data)
    for a, b in ((0, len(data)), (0, 11), (3, 3)):
        assert sums[b] - sums[a] == sum(c not in b" \t\n\r\x0b\x0c" for c in data[a:b])


def size(sums, window):
    return sum(int(sums[n.stop] - sums[n.start]) for n, _ in window)


@pytest.mark.parametrize("most", [10, 25, 60, 200, 10_000])
def test_windows_stay_within_the_limit_and_in_order(most):
    root = structural.python_tree(SERVICE + GLOBALS)
    sums = structural.nws_sums((SERVICE + GLOBALS).encode())
    windows = structural.pack(root, sums, most)
    assert all(size(sums, w) <= most for w in windows)
    flat = [n.start for w in windows for n, _ in w]
    assert flat == sorted(flat)
    if most == 10_000:
        assert [n.kind for n, _ in windows[0]] == ["module"] and structural.rebuilt(windows[0], (SERVICE + GLOBALS).encode()) == SERVICE + GLOBALS


def test_packing_of_a_made_up_tree():
    n = lambda a, b, *c: structural.Node("x", a, b, 0, a, 0, b, list(c))
    sums = np.arange(100)
    root = n(0, 60, n(0, 4), n(4, 8), n(8, 40, n(8, 14), n(14, 18), n(18, 40), n(30, 33)), n(40, 43), n(43, 50))
    got = [[(x.start, x.stop) for x, _ in w] for w in structural.pack(root, sums, 10)]
    assert got == [[(0, 4), (4, 8)], [(8, 14), (14, 18)], [(30, 33)], [(40, 43), (43, 50)]]  # the oversize leaf is lost
    o = structural.overlapped(structural.pack(root, sums, 10), 1)
    assert [(x.start) for x, _ in o[1]] == [4, 8, 14, 30]
    with pytest.raises(ValueError):
        structural.overlapped([], -1)


def test_structural_frames(spark):
    df = spark.createDataFrame([("d", "p.py", SERVICE), ("e", "q.py", "x = ("), ("f", None, None)], "doc string, path string, content string")
    out = structural.structural_chunks(df, "doc", "path", "content", 60, expand=True, template="default").orderBy("window_no").collect()
    inner = next(r for r in out if r.ancestors == ["class UserService(Base, a.Mixin[int]):"])
    assert inner.content.startswith("'''\np.py\nclass UserService(Base, a.Mixin[int]):\n'''\n") and {r.doc for r in out} == {"d"}
    with pytest.raises(ValueError):
        structural.structural_chunks(df, "doc", "path", "content", template="other")


def test_cut_candidates():
    root = structural.python_tree("x = 1\n" * 100 + "def f():\n    return 1\n")
    rows = structural.cut_candidates(root, "line", frozenset({"Assign"}))
    assert rows[0] == (10, 10) and rows[-1] == (77, 77)
    assert structural.cut_candidates(root, "block", frozenset({"Assign", "function_definition"})) == []


def test_nodes_in_a_range():
    root = structural.python_tree("a = 1\nb = [2, 3]\n")
    assert [n.kind for n in structural.nodes_in_range(root, 6, 16)][:1] == ["Assign"]
    assert structural.largest_in_range(root, structural.nws_sums(b"a = 1\nb = [2, 3]\n"), 6, 16) == 7
    with pytest.raises(ValueError):
        structural.nodes_in_range(root, 3, 2)


def test_node_table_and_templates(spark):
    df = spark.createDataFrame([("d", "a = 1\nb = f(x)\n", "p/q.py"), ("e", "x = (", "r.py"), ("f", None, None)], "doc string, content string, path string")
    nodes = structural.node_table(df, "doc", "content").orderBy("node_id").collect()
    assert [n.type for n in nodes] == ["module", "Assign", "Name", "=", "Constant", "Assign", "Name", "=", "Call", "Name", "(", "Name", ")"] and nodes[0].parent_id is None and nodes[8].parent_id == 5 and nodes[8].nws == 4 and nodes[9].leaf and not nodes[8].leaf
    out = structural.structural_chunks(df, "doc", "path", "content", 100)
    row = structural.code_windows(out, "coderagbench-repoeval", "repo").first()
    assert row.metadata.fpath_tuple == ["p", "q.py"] and row.metadata.repo == "repo" and row.metadata.line_count == 3 and row.metadata.node_count == 1
    assert structural.code_windows(out).first().metadata.chunk_size == 9 and structural.code_windows(out, "none").first().metadata == {}
    lite = structural.structural_chunks(df, "doc", "path", "content", 100, template="coderagbench-swebench-lite")
    assert structural.code_windows(lite, "coderagbench-swebench-lite").first()._id == "d_0-2"


JAVA = "package a;\n// remark\nclass A<T> implements B {\n  int[] x = {1, 2};\n  String s = \"a } b\";\n  void f(int y) {\n    if (y > 0) { g(); } else { h(); }\n    for (int i = 0; i < 9; i++) k(i);\n  }\n}\n"
DECORATED = "# first\nimport os\n\n@deco(1)\n@other\nclass A:\n    \"\"\"doc\"\"\"\n    @property\n    def f(self, a: int = 1, *b, **c) -> str:  # note\n        if a:\n            return f'{a!r:>{b}} {{}}' 'x'\n        else:\n            x = {1: 2, **c}\n        return lambda: [i for i in b if i]\n"


@pytest.mark.parametrize("most", [20, 60, 120, 400, 10_000])
@pytest.mark.parametrize("path,text", [("a.py", SERVICE + GLOBALS), ("a.py", DECORATED), ("a.py", "x = 'é'\ny = \"ü\" 'ö'; z = (1,\n 2)\n"), ("a.java", JAVA), ("a.ts", "const f = (a: string): void => { g({ a, b: [1] }) };\ninterface I { a: number }\nlet x = `a${b}`;\n"), ("a.cs", "namespace N { class C { int P { get; set; } } }"), ("a.java", "class A { void f( { \n } ) ] } }")])
def test_windows_hold_every_token_once(path, text, most):
    root, data = structural.tree_of(path, text), text.encode()
    sums = structural.nws_sums(data)
    held = np.zeros(len(data), int)
    for w in structural.pack(root, sums, most):
        assert size(sums, w) <= most
        for n, _ in w:
            held[n.start : n.stop] += 1
    stack = [root]
    while stack:
        n = stack.pop()
        stack += n.children
        if not n.children and sums[n.stop] - sums[n.start] > most:  # a token too large for any window
            held[n.start : n.stop] += 1
    solid = np.diff(sums) > 0
    assert (held[solid] == 1).all()


def test_ancestors_of_decorated_definitions_and_other_languages(spark):
    df = spark.createDataFrame([("d", "p.py", DECORATED), ("e", "q.java", JAVA)], "doc string, path string, content string")
    out = structural.structural_chunks(df, "doc", "path", "content", 40).collect()
    heads = {tuple(r.ancestors) for r in out}
    assert ("class A:", "def f(self, a: int = 1, *b, **c) -> str:  # note") in heads and ("class A<T> implements B {", "void f(int y) {") in heads
