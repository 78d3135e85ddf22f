"""Queries from incomplete left contexts: the static intent sketch, cursor scopes, gate features."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codectx.functions import text as t
from codectx.operators import structural

TAIL_LINES, MOST_HINTS, MOST_IDENTIFIERS, MOST_LOCALS = 80, 12, 40, 24
#: Initial weights of the rule-like gate: member access, trailing underscore, length; its bias. Fixed values.
GATE_WEIGHTS, GATE_BIAS, LONG = (0.4, 0.3, 0.0), 0.0, 2000


def with_sketch(df: DataFrame, text_col: str, name: str = "sketch") -> DataFrame:
    """``df`` with the intent sketch of a left context as a struct; its query has no line for what is empty. The labels are fixed values.

    Lines, tail and name lists are columns of their own on the way, so that each is computed once.
    """
    own = df.withColumn("_lines", t.lines(F.col(text_col)))
    cut = own.withColumn("_tail", F.array_join(F.slice("_lines", -F.least(F.lit(TAIL_LINES), F.greatest(F.size("_lines"), F.lit(1))), TAIL_LINES), "\n")).withColumn("_end", t.rstrip(F.col(text_col)))
    owner, member = t.member_access(F.col("_end"))
    rows = cut.withColumn("_s", F.struct(
        t.trailing_identifier(F.col("_end")).alias("prefix"), owner.alias("member_owner"), member.alias("member_prefix"),
        t.query_identifiers(F.col("_tail")).alias("identifiers"), t.class_hints(F.col("_tail")).alias("class_hints"), t.import_hints(F.col("_tail")).alias("import_hints"),
    ))
    s = {c: F.col(f"_s.{c}") for c in ("prefix", "member_owner", "member_prefix", "identifiers", "class_hints", "import_hints")}

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    def listed(label: str, value: Column, most: int) -> Column:
        return F.when(F.size(value) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(value, 1, most), " ")))

    query = F.concat_ws(
        "\n", F.lit("### Intent sketch"), line("incomplete_prefix", s["prefix"]), line("member_owner", s["member_owner"]), line("member_prefix", s["member_prefix"]),
        listed("class_hints", s["class_hints"], MOST_HINTS), listed("imports", s["import_hints"], MOST_HINTS), listed("local_identifiers", s["identifiers"], MOST_IDENTIFIERS), F.lit("### Left context tail"), F.col("_tail"),
    )
    return rows.withColumn(name, F.struct(*(c.alias(k) for k, c in s.items()), t.strip(query).alias("query"))).drop("_lines", "_tail", "_end", "_s")


def retrieval_query(df: DataFrame, text_col: str, mode: str = "static", name: str = "query") -> DataFrame:
    """``df`` with what is searched for: the left context as it stands ('raw') or its sketch's query ('static')."""
    if mode == "raw":
        return df.withColumn(name, t.text(F.col(text_col)))
    if mode != "static":
        raise ValueError(f"unknown intent mode {mode!r}")
    return with_sketch(df, text_col, "_q").withColumn(name, F.col("_q.query")).drop("_q")


def cursor_index(cursor: Column, n: Column) -> Column:
    """A line from 1 as an index from 0 within n lines: the first for 0 and less, the last at the end and beyond."""
    return F.when((n <= 0) | (cursor <= 0), 0).when(cursor >= n, n - 1).otherwise(cursor - 1)


def _last(own: Column, word: str) -> Column:
    """The last of some lines that begins with a word and ends with ':'; null if there is none."""
    found = F.filter(own, lambda x: t.lstrip(x).startswith(f"{word} ") & t.rstrip(x).endswith(":"))
    return F.rtrim(F.try_element_at(found, F.lit(-1)), F.lit(t.SPACE))


def indented_scope(rows: list[str], at: int) -> tuple[int | None, int | None]:
    """(row of the class header, row of the def header) that a row of Python lies in by its indentation, for texts that don't parse; a header lies in itself.

    >>> indented_scope(["class A:", "    def f(self):", "        x = 1", "def g(): pass", "y"], 2), indented_scope(["def g():", "  pass", "y"], 2)
    ((0, 1), (None, None))
    """
    found: dict[str, int] = {}
    level = None
    for k in range(min(at, len(rows) - 1), -1, -1):
        bare = rows[k].lstrip(t.SPACE)
        if not bare or bare[0] == "#" and k != at:
            continue
        depth = len(rows[k]) - len(bare)
        if level is None or depth < level:
            kind = "class" if bare.startswith("class ") else "def" if bare.startswith(("def ", "async def ")) else ""
            if kind:
                found.setdefault(kind, k)
            level = depth
            if not depth:
                break
    return found.get("class"), found.get("def")


#: Statements that import, in languages without a tree of their own here. Fixed values.
GO_IMPORT = re.compile(r"(?m)^import[ \t]+(?:\([^)]*\)|[^\n]*)")


def tree_scope(path: str, text: str, at: int) -> dict:
    """What a file's tree says of row ``at``: imports that end there or above, headers of the innermost class and function around it, first and last row of the smaller of the two.

    Headers and rows are given for Python; a Python text that doesn't parse is judged by its indentation and has no imports.
    """
    out: dict = {"imports": [], "parent_class": None, "parent_function": None, "first": None, "last": None}
    kind = os.path.splitext(path or "")[1].lower() or ".py"
    if kind == ".go":
        found = [(m.group(), text.count("\n", 0, m.end())) for m in GO_IMPORT.finditer(text)]
        out["imports"] = list(dict.fromkeys(x for x, row in found if row <= at))
        return out
    python = kind == ".py"
    root = structural.python_tree(text) if python else structural.brace_tree(text)
    rows = text.split("\n")
    if root is None:
        spans = [(k, at) for k in indented_scope(rows, at) if k is not None] if python else []
        heads = indented_scope(rows, at) if python else (None, None)
    else:
        data = text.encode("utf-8", "replace")
        inner: dict[str, structural.Node] = {}
        stack = [root]
        while stack:
            n = stack.pop()
            if n.kind in ("Import", "ImportFrom") and n.end_row <= at or n.kind == "statement" and n.end_row <= at and data[n.head : n.head + 7].split()[:1] == [b"import"]:
                out["imports"].append((n.start, data[max(n.start, n.head) : n.stop].decode("utf-8", "replace")))
            if n.start_row <= at <= n.end_row and n.kind in ("class_definition", "function_definition"):
                inner[n.kind] = n
            stack += [c for c in reversed(n.children) if c.start_row <= at]
        out["imports"] = list(dict.fromkeys(x for _, x in sorted(out["imports"])))
        row_of = lambda n: data.count(b"\n", 0, n.head)
        heads = tuple(row_of(inner[k]) if python and k in inner else None for k in ("class_definition", "function_definition"))
        spans = [(row_of(n), n.end_row) for n in inner.values()] if python else []
    out["parent_class"], out["parent_function"] = (rows[k].rstrip(t.SPACE) if k is not None else None for k in heads)
    if spans:
        out["first"], out["last"] = min(spans, key=lambda s: s[1] - s[0])
    return out


SCOPE = "struct<imports:array<string>,parent_class:string,parent_function:string,first:int,last:int>"


def with_scope(df: DataFrame, text_col: str, cursor_col: str, name: str = "scope", context_lines: int = 15, path_col: str | None = None, tree: bool = True) -> DataFrame:
    """``df`` with the scope at a cursor: imports, class and function around it, code before it, local variables.

    What the tree of the file (by the suffix of ``path_col``, Python without one) doesn't say is taken from a scan of lines: import lines up to the cursor, and for Python the nearest class and
    def header above, whether or not they enclose it. The code is that of the function or class around the cursor up to it, max(30, 4 * context_lines) lines at most, else the
    ``context_lines`` before. Without ``tree`` only lines are scanned, and nothing leaves the JVM.
    """
    path = F.col(path_col) if path_col else F.lit(".py")
    if tree:
        @F.pandas_udf(SCOPE)
        def found(texts: pd.Series, paths: pd.Series, at: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([tree_scope(p, x, int(k)) for x, p, k in zip(texts, paths, at)], columns=["imports", "parent_class", "parent_function", "first", "last"]).astype({"first": "Int32", "last": "Int32"})

        plain = df.withColumn("_text", t.newline_normalised(F.col(text_col)))
        at = cursor_index(F.col(cursor_col), F.size(t.lines(F.col("_text"))))
        base = plain.withColumn("_tree", found("_text", F.coalesce(path, F.lit(".py")), F.coalesce(at, F.lit(0)).cast("int"))).drop("_text")
    else:
        base = df.withColumn("_tree", F.lit(None).cast(SCOPE))
    return _scanned(base, text_col, cursor_col, name, context_lines, t.language(path))


def _scanned(df: DataFrame, text_col: str, cursor_col: str, name: str, context_lines: int, language: Column) -> DataFrame:
    own = df.withColumn("_lines", t.lines(t.newline_normalised(F.col(text_col)))).withColumn("_at", cursor_index(F.col(cursor_col), F.size("_lines")))
    rows = own.withColumn("_above", F.slice("_lines", 1, F.col("_at") + 1))
    first = F.greatest(F.lit(1), F.col("_at") + 1 - max(1, context_lines))
    python = language == "python"
    block = F.greatest(F.least(F.col("_tree.first"), F.col("_at")), F.col("_at") + 1 - max(30, 4 * context_lines)) + 1
    first = F.coalesce(block, first)
    rows = rows.withColumn("_code", F.slice("_lines", first, F.col("_at") + 2 - first))
    rows = rows.withColumn("_class", F.coalesce("_tree.parent_class", F.when(python, _last(F.col("_above"), "class")))).withColumn("_def", F.coalesce("_tree.parent_function", F.when(python, _last(F.col("_above"), "def"))))
    lines = F.filter("_above", lambda x: t.lstrip(x).startswith("import ") & language.isin("python", "java", "javascript", "typescript") | python & t.lstrip(x).startswith("from ") & t.strip(x).contains(" import "))
    imports = F.when(F.size("_tree.imports") > 0, F.col("_tree.imports")).otherwise(F.array_distinct(F.transform(lines, t.rstrip)))
    rows = rows.withColumn("_imports", imports).withColumn("_locals", local_variables(F.col("_code"), F.col("_def")))
    return rows.withColumn(name, F.struct(
        F.col("_imports").alias("imports"), F.col("_class").alias("parent_class"), F.col("_def").alias("parent_function"), F.array_join("_code", "\n").alias("local_code"), F.col("_locals").alias("local_variables"), (F.col("_at") + 1).alias("cursor_line")
    )).drop("_lines", "_at", "_above", "_code", "_class", "_def", "_imports", "_locals", "_tree")


def local_variables(code: Column, function: Column) -> Column:
    """Parameters of a def header, then by line of the code the targets of assignments and loops; distinct, without self and cls, 24 at most."""
    inner = F.regexp_extract(F.coalesce(function, F.lit("")), r"def\s+\w+\(([^)]*)\)", 1)
    parameters = F.transform(F.split(inner, ",", -1), lambda p: t.strip(F.regexp_extract(p, r"^[^:=]*", 0)))
    own = F.filter(F.transform(code, t.strip), lambda x: ~x.startswith("#"))
    found = F.flatten(F.transform(own, lambda x: F.array(F.regexp_extract(x, rf"^({t.IDENTIFIER})\s*=", 1), F.regexp_extract(x, rf"^for\s+({t.IDENTIFIER})\s+in\s+", 1))))
    return F.slice(F.array_except(F.array_distinct(F.concat(parameters, found)), F.array(F.lit("self"), F.lit("cls"), F.lit(""))), 1, MOST_LOCALS)


def scope_prompt(s: Column, path: Column) -> Column:
    """A scope as text: the function's header, else the class's, is its current scope. The labels are fixed values."""
    def part(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"[{label}]\n"), value))

    return t.strip(F.concat_ws(
        "\n\n", part("Path", path), part("Imports", F.array_join(s["imports"], "\n")), part("Current scope", F.coalesce(s["parent_function"], s["parent_class"])),
        part("Local variables", F.array_join(s["local_variables"], ", ")), F.concat(F.lit("[Immediate left context]\n"), s["local_code"]),
    ))


def gate_features(c: Column) -> list[Column]:
    """Member access in the last line, an identifier broken off at an underscore, length over 2,000 characters capped at 1."""
    end = t.last_line(F.substring_index(t.rstrip(c), "\n", -1))
    return [
        end.contains(".").cast("double"), end.rlike(t.IDENTIFIER + r"_\z").cast("double"), F.least(F.lit(1.0), F.length(t.text(c)) / float(LONG)),
    ]


def gate_probability(c: Column, weights: tuple[float, float, float] = GATE_WEIGHTS, bias: float = GATE_BIAS) -> Column:
    a, b, d = gate_features(c)
    return t.sigmoid(weights[0] * a + weights[1] * b + weights[2] * d + bias)


def gate_decision(c: Column, mode: str, threshold: float = 0.5) -> Column:
    """Whether to retrieve: always, never, by rule (a '.' in the last line of a text that isn't blank), or learned."""
    if mode == "always_retrieve":
        return F.lit(True)
    if mode == "always_skip":
        return F.lit(False)
    if mode == "rule":
        return (t.strip(c) != "") & t.last_line(t.rstrip(c)).contains(".")
    if mode == "learned":
        return gate_probability(c) >= threshold
    raise ValueError(f"unknown gate mode {mode!r}")
