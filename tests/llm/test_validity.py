import ast
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codectx.llm import validity as v
from codectx.llm.syntax import PARSERS
from codectx.llm.syntax.python import parse

GOOD = {
    "py": ["", "x = 1\n", "@d\nasync def f[T](a, /, b: int = 1, *c, d, **e) -> None:\n    async with a as b, c:\n        await x\n    return\n", "match x:\n    case [1, *r] | {'a': A(b=1), **k} if r: pass\n    case _: pass\n", "print(f'{a!r:>{w}} {{}} {b[\"k\"]}' rf'\\d{x}')\n", "x: list[int] = [*a, *(y for y in z if (n := y))]\ntry:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse: pass\nfinally: del x[0], y.z\n", "match = case = type = 1\nlambda *a, b=1: (yield)\n"],
    "js": ["", "const {a, b: [c = 1, ...d], ...e} = f, g = async ({h} = {}, ...i) => { await h?.[1]?.(2) ?? 3 };\nlabel: for (const [k, v] of m) continue label\n", "class A extends B { #p = 1; static { x() } get y() { return /[/]\\/(?<n>x)/g.test(`a${b + `c${d}`}`) } async *z() { yield* this.#p } }\n", "!function(a){a.b=1}(c);var d=e=>e.f&&e.f(1)\nif (x) y\nelse z++\n", "import a, {b as c} from 'd'; export * as e from 'f'; export default class {}\n"],
    "ts": ["interface A<T extends object = {}> extends B { readonly [k: string]: T[] | null; m?(x: number): x is string }\nabstract class C<T> implements A<T> { constructor(private a: string, public b?: number) { super() } abstract d(): Promise<Map<string, T[]>>; }\n", "enum E { A = 1 }\ntype F<T> = T extends (infer U)[] ? `x${string}` : { -readonly [K in keyof T]?: T[K] };\nlet x = <T,>(y: T): T => y!, z = a as const satisfies B;\nif (a < b && c > d) { f<string>(x) }\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@X(y = {1, 2}) public sealed interface S<T extends Comparable<? super T>> permits R {}\nrecord R<T>(int a, String... b) implements S { R { if (a < 0) throw new E(); } }\nenum Q { A, B(1) { void f() {} }; Q(int... x) {} }\nclass C { int[][] m = {{1}, {2}}; <T> T f(final List<Map<String, int[]>> x) throws E { for (var y : x) { int z = switch (y) { case P(int q, var r) when q > 0 -> { yield 1; } default -> 2; }; } Runnable r = () -> {}; return (T) x.<T>g(A::new, int[]::new)[0]; } String t = \"\"\"\n a \"b\"\n \"\"\"; }\n"],
    "go": ["package x\n\nimport (\n\t\"fmt\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) M(a, b int, c ...string) (r int, err error) {\n\tif x, ok := m[k]; ok && (P{1} == y) {\n\t\treturn 1, nil\n\t} else if z := <-ch; z > 0 {\n\t}\n\tfor i, v := range []struct{ a int }{{1}} {\n\t\tgo func() { defer f(i, v...) }()\n\t}\n\tswitch y := x.(type) {\n\tcase int, *string:\n\tdefault:\n\t}\n\treturn Map[int, string](s, func(a int) int { return a &^ 1 }), nil\n}\n"],
}
BAD = {
    "py": ["def f(:\n    pass\n", "x = (1\n", "if x:\npass\n", "<<<<<<< HEAD\nx = 1\n", "x = 'abc\n", "f() = 1\n", "class A\n    pass\n", "try:\n    x\n", "print(1 2)\n", "  x = 1\ny = 2\n", "f'{a'\n", "a = 012\n", "\tif a:\n        b\n\tc\n", "x = $a\n", "f(a=1, 2)\n", "package x;\n"],
    "js": ["let x = ;", "function f( { }", "if (a {}", "x = [1", "a b", "var s = 'x", "x = `a", "f() = 1", "class A { f() { }", "def f(x):\n  return x", "const x = {a: 1 b: 2}", "<<<<<<< ours\nx()", "<!DOCTYPE html>", "}"],
    "ts": ["let x: = 1", "interface A { a: }", "function f(a: string { }", "type X = ;", "enum { A }", "class A { private }}"],
    "java": ["class A { void f() { x } }", "class A { int f( { } }", "import a.b", "class A { void f() { 1 + 2; } }", "class A { } }", "x = 1;", "class A { String s = \"a; }", "class A { void f() { int x = ; } }", "<<<<<<< HEAD\nclass A {}"],
    "go": ["", "func f() {}", "package x\nfunc f() { x := }\n", "package x\nfunc f( { }\n", "package x\nx := 1\n", "package x\nfunc f() {\n for i := 0; i < 3; i++\n {}\n}\n", "package x\nfunc f() { return }}\n", "package x\nimport \"a\n"],
}


@pytest.mark.parametrize("ext,text", [(e, x) for e, xs in GOOD.items() for x in xs])
def test_valid(ext, text):
    assert [(w.at, w.why) for w in PARSERS[ext][1](text)] == []


@pytest.mark.parametrize("ext,text", [(e, x) for e, xs in BAD.items() for x in xs])
def test_invalid(ext, text):
    assert PARSERS[ext][1](text)


def nested(n):
    o, c = "(" * n, ")" * n
    return {
        "js": [f"x = {o}1{c};", "{" * n + "}" * n, "x = " + "[" * n + "]" * n, "(a => " * n + "1" + c],
        "ts": ["let x: " + "A<" * n + "B" + " >" * n + " = 1;", "type X = " + "{a: " * n + "B" + "}" * n],
        "java": [f"class A {{ int x = {o}1{c}; }}", "class A { void f() " + "{" * n + "}" * n + " }", "class A {" * n + "}" * n],
        "go": [f"package x\nvar y = {o}1{c}\n", "package x\nfunc f() " + "{" * n + "}" * n + "\n"],
    }


@pytest.mark.parametrize("ext", ["js", "ts", "java", "go"])
def test_deep_nesting_is_valid_and_a_truncated_text_is_not(ext):
    for text in nested(5000)[ext]:
        assert PARSERS[ext][1](text) == [] and PARSERS[ext][1](text[: len(text) * 2 // 3])


@pytest.mark.parametrize("n", [98, 99, 100, 101, 199, 200, 201, 300])
def test_python_has_limits_of_its_own(n):
    for text in ("x = " + "(" * n + "1" + ")" * n + "\n", "".join(" " * k + "if x:\n" for k in range(n)) + " " * n + "y\n"):
        assert bool(PARSERS["py"][1](text)) != compiles(text)


def test_modules_and_files_that_are_a_class():
    java = PARSERS["java"][1]
    assert java("/** x */\n@Deprecated open module a.b { requires transitive java.base; requires static c; exports d.e to f, g; opens h; uses i.J; provides k.L with m.N, o.P; }") == []
    assert java("module a { requires; }") and java("module a { exports b to; }") and java("module a {")
    assert java("import a.B;\nvoid main() { f(1); }\nint f(int x) { return x; }\nrecord R(int a) {}\n") == []
    assert java("int f(int x) { return x; }\n") and java("void main() { } }")


def compiles(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


PIECES = ["x", "1", "'s'", "(", ")", "[", "]", "{", "}", ":", ",", "=", "+", "not", "in", "if", "else", "for", "lambda", "def", "class", "return", "\n", "\n    ", "\n        ", "*", "**", ".", "await", "yield", "import", "from", "as", "with", "try", "except", ":=", "@", "f'{x}'", "match", "case", "->", "==", "is"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_python_agrees_with_the_compiler_on_short_texts(tokens):
    text = " ".join(tokens) + "\n"
    if compiles(text):
        assert parse(text) == []


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([x for e in ("py", "js", "ts", "java", "go") for x in GOOD[e]]), st.sampled_from(list(PARSERS)), st.integers(0, 500), st.sampled_from(["", "(", "}", "'", '"', "`", "/*", "\\", "\0", "é", "{{", "<<<<<<<"]))
def test_no_text_breaks_a_parser(text, ext, at, junk):
    PARSERS[ext][1](text[:at] + junk + text[at + 3 :])


def test_the_first_cause_and_later_errors_are_kept():
    name, errors = v.check("a.js", "let a = ;\nlet b = 1;\nlet c = = 2;\nlet d;\n")
    assert name == "javascript" and [n for n, _ in errors] == [1, 3]
    assert v.check("README.md", "(") is None


def test_deeply_nested_and_long_texts():
    assert v.check("a.py", "x = " + "(" * 3000 + ")" * 3000)[1]
    assert v.check("a.js", "(" * 5000)[1]
    assert v.check("a.py", "x = 1\n" * 20_000)[1] == []


def test_frames(spark):
    loader = spark.createDataFrame([(1, "r", {"a.py": "x = (", "b.PY": "x = 1", "c.md": "(", "d.go": None}, True), (2, None, None, True)], "sample_id long, repo string, crossfile_context map<string,string>, valid boolean")
    chunks = spark.createDataFrame([(5, "r", "x.js", "fallback", "a b", "z"), (6, "r", "x.js", "function", "a b", "z"), (7, None, "y.ts", "fallback", None, "z"), (8, "r", None, "fallback", "(", "z")], "chunk_key long, repo string, file_path string, chunk_type string, text string, language string")
    out = v.check_files(v.files(loader, chunks))
    assert sorted((r.origin, r.record_id, r.file_path, r.valid) for r in out.collect()) == [("chunk", 5, "x.js", False), ("chunk", 7, "y.ts", True), ("crossfile", 1, "a.py", False), ("crossfile", 1, "b.PY", True), ("crossfile", 1, "d.go", False)]
    assert {(r.repo, r.language): (r.files, r.invalid) for r in v.rates(out).collect()}[("r", "python")] == (2, 1)
    assert v.rates(v.check_files(v.files(loader.limit(0), chunks.limit(0)))).collect() == []
