"""Entity chunks of Python files: spans come from the compiler's tree, everything else from expressions.

A vectorised function gives each file the spans of its entities (kind, lines, names); texts, splits, identifiers and calls of the
chunks are then cut and computed in the JVM. Spans: one over all imports and assignments of the module, from the first to the last of
them; headers of classes up to their docstring; methods; whole classes without methods; functions; what is left over of the module's lines.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.functions.text import call_names, identifier_set, lines, strip
from codectx.storage import spread

MOST_LINES, FALLBACK_LINES = 120, 40
SPAN = "kind string, start int, end int, defined array<string>, parent string, bases array<string>, methods array<string>, split boolean"
BOUND = (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.AugAssign)
CALLABLE = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.expr) -> str:
    """The name of a base class; '' for anything but names, attributes and what is subscripted."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Subscript):
            node = node.value
        elif isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        else:
            if isinstance(node, ast.Name):
                parts.append(node.id)
            return ".".join(reversed(parts))


def bound_names(nodes: list[ast.stmt]) -> list[str]:
    """What imports and assignments bind, each once, in order. Attributes, items and augmented assignments bind nothing new."""
    found: dict[str, None] = {}
    for n in nodes:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            found.update(dict.fromkeys(a.asname or a.name.partition(".")[0] for a in n.names))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            todo = [*reversed(n.targets)] if isinstance(n, ast.Assign) else [n.target]
            while todo:
                x = todo.pop()
                if isinstance(x, ast.Name):
                    found[x.id] = None
                elif isinstance(x, (ast.Tuple, ast.List)):
                    todo += reversed(x.elts)
    found.pop("", None)
    return list(found)


def class_spans(node: ast.ClassDef) -> list[dict]:
    bases = [b for b in map(dotted, node.bases) if b]
    methods = [x for x in node.body if isinstance(x, CALLABLE)]
    names = [m.name for m in methods]
    doc = node.body[0]
    described = isinstance(doc, ast.Expr) and isinstance(doc.value, ast.Constant) and isinstance(doc.value.value, str)
    own = {"defined": [node.name], "parent": node.name, "bases": bases, "split": False}
    out = [{**own, "kind": "class_header", "start": node.lineno, "end": doc.end_lineno if described else node.lineno, "methods": names}]
    if not methods:
        out.append({**own, "kind": "class_body", "start": node.lineno, "end": node.end_lineno, "methods": []})
    return out + [{**own, "kind": "method", "start": m.lineno, "end": m.end_lineno, "defined": [m.name], "methods": names, "split": True} for m in methods]


def spans(source: str) -> list[dict] | None:
    """The spans of a file in the order of its chunks; None if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    plain = {"parent": None, "bases": [], "methods": []}
    glob = [n for n in body if isinstance(n, BOUND)]
    out = []
    if glob:
        out.append({**plain, "kind": "global", "start": min(n.lineno for n in glob), "end": max(n.end_lineno for n in glob), "defined": bound_names(glob), "split": False})
    taken: set[int] = set()
    for n in body:
        if isinstance(n, ast.ClassDef):
            out += class_spans(n)
        elif isinstance(n, CALLABLE):
            out.append({**plain, "kind": "function", "start": n.lineno, "end": n.end_lineno, "defined": [n.name], "split": True})
        elif not isinstance(n, BOUND):
            continue
        taken.update(range(n.lineno, n.end_lineno + 1))
    run: list[int] = []
    rows = source.splitlines()
    for k, line in enumerate([*rows, ""], 1):
        if k <= len(rows) and k not in taken and line.strip():
            run.append(k)
        elif run:
            out.append({**plain, "kind": "rest", "start": run[0], "end": run[-1], "defined": None, "split": True})
            run = []
    return out


def entity_chunks(files: DataFrame, keys: list[str], path: str, content: str, most: int = MOST_LINES, fallback: int = FALLBACK_LINES, python_only: bool = False) -> DataFrame:
    """``keys``, chunk_pos and the columns of a code chunk, for every file parsed as Python whatever its suffix, or with ``python_only`` those ending in .py; the others are cut into windows.

    A file that doesn't parse, or of which nothing but white space is left, is cut into 'fallback' windows; an empty one has one
    window '' of line 1. Null contents are empty. Pieces after the first of a long function or method define nothing.
    """

    @F.pandas_udf(f"array<struct<{SPAN.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' array', ':array')}>>")
    def found(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([spans(x) if not python_only or (p or "").lower().endswith(".py") else None for x, p in zip(texts, paths)])

    base = spread(files.select(*keys, F.col(path).alias("file_path"), F.coalesce(F.col(content), F.lit("")).alias("_text")))
    n = F.greatest(F.size("_lines"), F.lit(1))
    empty = F.array().cast("array<string>")
    whole = F.array(F.struct(F.lit("fallback").alias("kind"), F.lit(1).alias("start"), n.cast("int").alias("end"), empty.alias("defined"), F.lit(None).cast("string").alias("parent"), empty.alias("bases"), empty.alias("methods"), F.lit(True).alias("split")))
    rows = base.withColumn("_lines", lines(F.col("_text"))).withColumn("_spans", found("_text", "file_path"))
    rows = rows.withColumn("_spans", F.when(F.coalesce(F.size("_spans"), F.lit(0)) > 0, F.col("_spans")).otherwise(whole))
    one = rows.select(*keys, "file_path", "_lines", F.posexplode("_spans").alias("_at", "s"))
    step = F.when(F.col("s.kind").isin("rest", "fallback"), fallback).otherwise(most)
    stop = F.greatest(F.col("s.start"), F.col("s.end"))
    cut = one.withColumn("_step", F.when(F.col("s.split"), step).otherwise(stop - F.col("s.start") + 1)).select("*", F.posexplode(F.sequence(F.col("s.start"), stop, F.col("_step"))).alias("_piece", "start_line"))
    text = F.array_join(F.slice("_lines", F.col("start_line"), F.least(F.col("_step"), stop - F.col("start_line") + 1)), "\n")
    chunk = cut.withColumn("text", text).withColumn("end_line", F.least(F.col("start_line") + F.col("_step") - 1, stop))
    first = identifier_set(F.regexp_extract("text", "^[^\n]*", 0))
    return chunk.filter((F.col("s.kind") != "rest") | (strip(F.col("text")) != "")).select(
        *keys, (F.row_number().over(Window.partitionBy(*keys, "file_path").orderBy("_at", "_piece")) - 1).alias("chunk_pos"), "file_path", "start_line", "end_line", F.when(F.col("s.kind") == "rest", "global").otherwise(F.col("s.kind")).alias("chunk_type"), "text",
        F.when(F.col("s.kind") == "rest", first).when((F.col("_piece") > 0) | (F.col("s.kind") == "fallback"), empty).otherwise(F.col("s.defined")).alias("defined_symbols"),
        identifier_set(F.col("text")).alias("used_symbols"), call_names(F.col("text")).alias("call_names"), F.col("s.parent").alias("parent_class"), F.col("s.bases").alias("class_bases"), F.col("s.methods").alias("method_names"),
    )

