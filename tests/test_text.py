import difflib
import keyword
import re

import pytest
from pyspark.sql import functions as F

from codectx.functions import quality
from codectx.functions import text as t

TEXTS = [
    "", " ", "a.b_", "import os\nfrom a.b import C as D\n\nx = Foo(1)\nservice.fetch_", "def fetch_user(a):\n    return g (b)\nclass K(L): pass\nif (x): for (y)", "tab\tx\x0by\x0cz\x1cw\x85q\u2028r\n", "é_1 = Ünï(2)\r\nnext\r", "# only\n  # comments\n",
    "// a\n/* b\n * c */", "import a\n\nfrom b import c\n", "x" * 5000, "a = B(\n  c)\nself.d . e", None, "\u00a0pad\u3000", "self.x\n\n", "trailing_\n",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, x, "clash", "clash") for k, x in enumerate(TEXTS)], "k int, x string, text string, token string")


def rows(frame, *columns):
    return [tuple(r)[1:] for r in frame.select("k", *columns).orderBy("k").collect()]


def test_strings_as_python_has_them(frame):
    x = F.col("x")
    got = rows(frame, t.strip(x), t.rstrip(x), t.lines(x), t.identifiers(x), t.identifier_set(x), t.call_names(x), t.trailing_identifier(x), t.last_line(x))
    for text, (strip, rstrip, lines, ids, id_set, calls, trailing, last) in zip(TEXTS, got):
        s = text or ""
        pattern = re.compile(t.IDENTIFIER)
        assert strip == s.strip() and rstrip == s.rstrip() and lines == s.splitlines() and ids == pattern.findall(s) and id_set == list(dict.fromkeys(ids))
        assert calls == [w for w in dict.fromkeys(re.findall(t.CALL, s)) if w not in t.NO_CALLS]
        m = re.search(t.IDENTIFIER + r"\Z", s.rstrip())
        assert trailing == (m.group() if m else "") and last == (s.splitlines() or [""])[-1]


def test_hints_members_and_predicates(frame):
    x = F.col("x")
    owner, member = t.member_access(x)
    got = rows(frame, owner, member, t.class_hints(x), t.import_hints(x), t.query_identifiers(x), t.is_comment_only(x), t.is_import_only(x, F.lit("python")), t.is_import_only(x, F.lit("go")), t.nws_chars(x), t.nws_bytes(x))
    assert got[2][:2] == ("a", "b_") and got[3][:2] == ("service", "fetch_") and got[11][:2] == ("d", "e")
    assert got[3][2] == ["x", "Foo", "C", "D"] and got[3][3] == ["os", "a", "b", "C", "D"]
    assert [r[5] for r in got] == [k in (7, 8) for k in range(len(TEXTS))] and [r[6] for r in got] == [k == 9 for k in range(len(TEXTS))] and not any(r[7] for r in got)
    assert all(not keyword.iskeyword(w) for r in got for w in r[4])
    for text, r in zip(TEXTS, got):
        bare = re.sub("[ \t\n\r\x0b\x0c]", "", text or "")
        assert r[8:] == (len(bare), len(bare.encode()))


def test_languages(spark):
    df = spark.createDataFrame([(1, "a/b.TS"), (2, "x.rb"), (3, "Makefile"), (4, "a.b/c"), (5, None), (6, "q.java")], "k int, p string")
    assert [r.l for r in df.select("k", t.language(F.col("p")).alias("l")).orderBy("k").collect()] == ["typescript", "ruby", "python", "python", "python", "java"]


def test_quality(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("ab" * 150, "ba" * 150), ("", ""), ("x", ""), (None, None), (" foo(bar) ", "foo(bar)"), ("a b c", "a c d"), ("", "a")]
    df = spark.createDataFrame([(k, *p, "z") for k, p in enumerate(pairs)], "k int, p string, g string, target string")
    a, b = F.col("p"), F.col("g")
    prec, rec, f1 = quality.identifier_scores(a, b)
    got = [tuple(r)[1:] for r in df.select("k", quality.exact_match(a, b), quality.edit_similarity(a, b), prec, rec, f1, quality.composite(a, b), quality.composite_with_context(a, b, F.array(F.lit("foo")))).orderBy("k").collect()]
    for (p, g), (em, edit, pr, re_, f, comp, ctx) in zip(pairs, got):
        p, g = p or "", g or ""
        assert em == float(p.strip() == g.strip())
        want = 1.0 if p == g else 0.0 if not g else difflib.SequenceMatcher(None, p, g).ratio()
        assert edit == pytest.approx(want)
        x, y = set(re.findall(t.IDENTIFIER, p)), set(re.findall(t.IDENTIFIER, g))
        n = len(x & y)
        wp, wr = (n / len(x), n / len(y)) if x and y else (0.0, 0.0)
        assert (pr, re_) == (wp, wr) and f == pytest.approx(2 * wp * wr / (wp + wr) if wp + wr else 0.0)
        assert comp == pytest.approx(0.3 * em + 0.35 * edit + 0.35 * f) and ctx == pytest.approx(min(1.0, comp + 0.1 * ("foo" in y)))
    assert got[0][1] == 0.25 and got[1][1] == 0.5 and got[2][1] == 0.0
