import pytest

from codectx.llm import handwritten as h

LOADER = "sample_id long, repo string, crossfile_context map<string,string>, record_id long, content string"
CHUNKS = "chunk_key long, repo string, file_path string, start_line int, text string, key long, path string, reason string, first boolean"
CODE = "def f(a):\n    return a + 1\n"


@pytest.mark.parametrize("path,why", [
    ("a/vendor/b.py", "third-party"), ("node_modules\\x\\y.js", "third-party"), ("src/vendors_api/x.py", ""), ("third_party_billing/x.go", ""), ("generated/x.ts", "generated"), ("lib/generators/x.ts", ""), ("x/y.min.js", "minified"), ("a_pb2.py", "generated"),
    ("poetry.lock", "generated"), ("build/gen/x.java", "generated"), ("src/builders/x.go", ""), ("", ""),
])
def test_paths(path, why):
    assert h.judge_path(path) == why


@pytest.mark.parametrize("text,kind", [
    ("# Code generated by x-gen v1. DO NOT EDIT.\n" + CODE, "g"), ('"""AUTO-GENERATED FILE - regenerate with `make x`"""\n' + CODE, "g"), ("/*! x.js v1 | (c) the x contributors | permissive licence */\nf()", "t"), ("#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n\n# Fichier produit par x, ne pas modifier.\n" + CODE, "g"),
    ("# output starts with 'generated by x' so that linters skip the file we write\n" + CODE, ""), ("import a\n# Code generated by x. DO NOT EDIT.\n" + CODE, ""), ("# auto-generated ids are greedy here\n" + CODE, ""), ("", ""), ("// Vendored from the x project, release 1.\nx()", "t"), ('HEAD = "# Code generated by x. DO NOT EDIT."\n', ""),
    ("/*\n * Some words.\n *\n * Automatically generated by x\n */\nclass A {}", "g"),
])
def test_notices(text, kind):
    assert h.notice(text) == kind


def test_shapes():
    mini = "".join(f"var a{i}=b=>b.c&&b.c({i});" for i in range(40))
    assert h.judge("x.js", mini) == "minified"
    assert h.judge("x.py", "HELP = \"" + "many words in a row " * 40 + "\"\n" + CODE) == ""
    assert h.judge("x.py", "\n".join(f"_t_{i} = ({i}, {i * 3}, 7, 9,)" for i in range(20))) == "data"
    assert h.judge("x.go", "package x\n\nvar b = []byte{\n" + "    0x3e, 0x67, 0xfa, 0x11,\n" * 30 + "}\n") == "data"
    assert h.judge("x.py", CODE * 30) == ""
    assert h.judge("x.json", "\n".join(f'"{i}": [1, 2, 3],' for i in range(50))) == ""
    assert h.judge("x.py", "x = 1\n" * 50_000) == ""


def test_one_chunk_or_spelling_shows_it_for_the_whole_file(spark):
    note = "# Code generated by x-gen v1. DO NOT EDIT.\nimport a\n"
    rows = [(1, "r", "a/b.py", 1, note), (2, "r", "./a//b.py", 9, CODE), (3, "r", "a\\b.py", None, CODE), (4, "q", "a/b.py", 1, CODE), (5, "r", "vendor/z.py", 3, None), (6, None, None, None, None), (7, None, None, 1, note), (8, "r", "c.py", 7, note), (9, "r", "a/b.py", 9, CODE)]
    chunks = spark.createDataFrame([(*r, 1, "x", "y", True) for r in rows], CHUNKS)
    loader = spark.createDataFrame([(1, "r", {"x.py": note, "y.py": CODE, "vendor/q.py": None}, 5, "c"), (2, "r", None, 5, "c"), (3, "r", {}, 5, "c")], LOADER)
    got = sorted((r.origin, r.record_id, r.file_path or "") for r in h.not_handwritten(loader, chunks).collect())
    assert got == [("chunk", 1, "a/b.py"), ("chunk", 2, "./a//b.py"), ("chunk", 3, "a\\b.py"), ("chunk", 5, "vendor/z.py"), ("chunk", 7, ""), ("chunk", 9, "a/b.py"), ("crossfile", 1, "vendor/q.py"), ("crossfile", 1, "x.py")]
    assert h.not_handwritten(loader.limit(0), chunks.limit(0)).collect() == []


@pytest.mark.parametrize("mark", ["# ", "// "])
def test_a_notice_after_a_long_licence_counts(mark):
    licence = "".join(f"{mark}{i}. You may reproduce and distribute copies of the work in any medium, with or without modifications.\n" for i in range(200))
    licence += f"{mark}The contents of the notice are for informational purposes only and do not modify the License.\n"
    assert h.notice(licence + CODE) == ""
    assert h.notice(licence + mark + "Code generated by x-gen v1. DO NOT EDIT.\n" + CODE) == "g"
    assert h.notice(licence + CODE + mark + "Code generated by x-gen v1. DO NOT EDIT.\n") == ""
    assert h.notice(licence.replace(mark, "# ") + "#\n" * 100 + "# Vendored from the x project\n" + CODE) == "t"
    assert h.notice("/*\n" + licence.replace(mark, " * ") + " * Automatically generated by x\n */\nclass A {}") == "g"


def test_the_header_of_a_long_text_is_read_no_further_than_its_code():
    lines = h.header("# a\n" + CODE * 200_000)
    assert list(lines) == ["a"]


@pytest.mark.parametrize("line,kind", [
    ("# Helper for code generated by the protobuf compiler", ""), ("# do not edit without asking Bob", ""), ("# checks whether a file is auto-generated from a schema", ""), ("# Code generated by protoc. DO NOT EDIT.", "g"), ("# This code was automatically generated from api.yaml", "g"), ("# skips code generated by tools", ""),
])
def test_notices_are_said_not_spoken_about(line, kind):
    assert h.notice(line + "\nx = 1\n") == kind
