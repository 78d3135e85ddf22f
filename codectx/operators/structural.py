"""Structural chunks: nodes of a syntax tree packed into windows by their size without white space.

The node source is pluggable; those here are Python's own tree with its tokens for leaves, and a tree of brackets and statements for Java, C# and TypeScript. A file's nodes stay in one row, so packing, overlap,
rebuilding and expansion of a file happen where its text is, and files are spread over tasks like any rows.
"""

from __future__ import annotations

import ast
import io
import keyword
import os
import re
import tokenize
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codectx.schemas import AST_NODE
from codectx.storage import spread

TEMPLATES = ("none", "default", "coderagbench-repoeval", "coderagbench-swebench-lite")
#: The bytes that count as white space. Fixed values.
BLANK = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)


@dataclass
class Node:
    kind: str
    start: int
    stop: int
    start_row: int
    start_col: int
    end_row: int
    end_col: int
    children: list[Node] = field(default_factory=list)
    head: int = -1  # where a definition's own header begins, if decorators stand before it


def nws_sums(data: bytes) -> np.ndarray:
    """Running counts of the bytes that aren't white space, from 0."""
    solid = ~np.isin(np.frombuffer(data, np.uint8), BLANK)
    return np.concatenate(([0], np.cumsum(solid)))


def with_leaves(node: Node, leaves: list[Node]) -> None:
    """Puts the leaves (tokens, in order) that lie in a node but in none of its children among these, down to the leaves of the tree; a node that is one token stays a leaf.

    So the leaves of a tree cover its text but for white space.
    """
    stack = [(node, 0, len(leaves))]
    starts = [x.start for x in leaves]
    while stack:
        n, lo, hi = stack.pop()
        if hi - lo == 1 and not n.children and leaves[lo].start == n.start and leaves[lo].stop == n.stop:
            continue
        out: list[Node] = []
        for c in n.children:
            if c.start < (out[-1].stop if out else n.start) or c.stop > n.stop:
                continue  # out of order or outside: its tokens are the node's own
            first, behind = bisect_left(starts, c.start, lo, hi), bisect_left(starts, c.stop, lo, hi)
            if any(x.stop > c.start for x in leaves[max(lo, first - 1) : first]) or leaves[behind - 1 : behind] and leaves[behind - 1].stop > c.stop:
                continue  # begins or ends inside a token
            out += leaves[lo:first]
            out.append(c)
            stack.append((c, first, behind))
            lo = behind
        n.children = out + leaves[lo:hi]


def python_leaves(source: str, starts: list[int]) -> list[Node]:
    """The tokens of a Python text, comments among them; an f-string is one."""
    rows = source.split("\n")
    out: list[Node] = []
    depth = 0

    def place(row: int, col: int) -> tuple[int, int]:
        line = rows[row - 1] if row <= len(rows) else ""
        b = col if line.isascii() else len(line[:col].encode())
        return (starts[row - 1] if row <= len(starts) else starts[-1]) + b, b

    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            continue
        kind = {tokenize.COMMENT: "comment", tokenize.STRING: "string", tokenize.NUMBER: "number", tokenize.FSTRING_START: "string"}.get(t.type) or ("identifier" if t.type == tokenize.NAME and not keyword.iskeyword(t.string) else t.string)
        (stop, end_col) = place(*t.end)
        if depth:
            depth += (t.type == tokenize.FSTRING_START) - (t.type == tokenize.FSTRING_END)
            out[-1].stop, out[-1].end_row, out[-1].end_col = stop, t.end[0] - 1, end_col
            continue
        (start, col) = place(*t.start)
        out.append(Node(kind, start, stop, t.start[0] - 1, col, t.end[0] - 1, end_col))
        depth = int(t.type == tokenize.FSTRING_START)
    return [x for x in out if x.stop > x.start]


def python_tree(source: str) -> Node | None:
    """The tree of a Python file with its tokens as leaves, None if it doesn't parse. Rows count from 0, columns are bytes; a decorated definition begins at its first decorator."""
    data = source.encode("utf-8", "replace")
    starts = [0, *(k + 1 for k, b in enumerate(data) if b == 10)]

    def make(n: ast.AST) -> Node:
        first = min((d for d in getattr(n, "decorator_list", [])), key=lambda d: d.lineno, default=n)
        row, col = first.lineno - 1, first.col_offset - (1 if first is not n else 0)
        kind = {"ClassDef": "class_definition", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition"}.get(type(n).__name__, type(n).__name__)
        node = Node(kind, starts[row] + col, starts[n.end_lineno - 1] + n.end_col_offset, row, col, n.end_lineno - 1, n.end_col_offset, head=starts[n.lineno - 1] + n.col_offset)
        if not isinstance(n, (ast.JoinedStr, ast.Constant)):
            node.children = sorted(map(make, placed(n)), key=lambda c: c.start)
        return node

    def placed(n: ast.AST) -> list[ast.AST]:
        """The nearest nodes below that have a place and are statements, expressions, handlers or cases."""
        out: list[ast.AST] = []
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.stmt, ast.expr, ast.excepthandler)):
                out.append(c)
            else:
                out += placed(c)
        return out

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        leaves = python_leaves(source, starts)
        children = [make(c) for c in tree.body]
    except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError, tokenize.TokenError):
        return None
    rows = source.split("\n")
    root = Node("module", 0, len(data), 0, 0, len(rows) - 1, len(rows[-1].encode("utf-8", "replace")), children)
    with_leaves(root, leaves)
    return root


#: Tokens of languages with braces: remarks, literals, names, numbers, operators.
BRACE_TOKEN = re.compile(r'''(?s://[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?(?:"""|\Z)|@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[^\W\d][\w$]*|\d[\w.]*|[^\s\w])''')
CLOSED = {"{": "}", "(": ")", "[": "]"}
#: Words that make a statement with a body a type's; those before a parenthesis that make it none of a method's. Fixed values.
TYPE_WORDS, FLOW_WORDS = frozenset("class interface enum record struct namespace module".split()), frozenset("if for foreach while switch catch using lock synchronized do try else finally return new".split())


def brace_tree(source: str) -> Node | None:
    """A tree of a text in a language with braces (Java, C#, TypeScript), None for an empty one: bracketed parts are nodes, and within braces so are statements.

    A statement ends with ';' or with a body in braces behind which no part of it can follow. Kinds are those that other nodes of the structure have: class_definition for a
    type with its body, function_definition for a method or function with its body, block, and otherwise the bracket. Texts are never refused: what isn't closed ends with the text.
    """
    data = source.encode("utf-8", "replace")
    text = data.decode("utf-8")
    plain = text.isascii()
    breaks = [-1, *(k for k, b in enumerate(data) if b == 10)]

    def node(kind: str, start: int, stop: int) -> Node:
        a, b = bisect_left(breaks, start) - 1, bisect_left(breaks, stop) - 1
        return Node(kind, start, stop, a, start - breaks[a] - 1, b, stop - breaks[b] - 1)

    at = 0
    last = 0
    tokens: list[tuple[str, int, int]] = []
    for m in BRACE_TOKEN.finditer(text):
        at += m.start() - last if plain else len(text[last : m.start()].encode())
        size = len(m.group()) if plain else len(m.group().encode())
        tokens.append((m.group(), at, at + size))
        at, last = at + size, m.end()
    if not tokens:
        return None
    root = Node("module", 0, len(data), 0, 0, len(breaks) - 1, len(data) - breaks[-1] - 1)
    frames: list[tuple[str, int, list[Node], list[Node], list[str]]] = [("", 0, [], [], [])]  # closing mark, start, statements, parts of the open one, its words

    def close_statement(frame: tuple[str, int, list[Node], list[Node], list[str]]) -> None:
        _, _, done, parts, words = frame
        if not parts:
            return
        body = parts[-1].kind == "block"
        named = any(w in TYPE_WORDS for w in words)
        call = body and any(p.kind == "(" for p in parts) and not (words and words[0] in FLOW_WORDS) and "=" not in words
        kind = "class_definition" if body and named else "function_definition" if call else "statement"
        if len(parts) == 1:
            done.append(parts[0])
        else:
            n = node(kind, parts[0].start, parts[-1].stop)
            n.children, n.head = list(parts), next((p.start for p in parts if p.kind != "comment"), parts[0].start)
            done.append(n)
        parts.clear(), words.clear()

    def close_bracket(stop: int) -> None:
        mark, start, done, parts, words = frame = frames.pop()
        if mark == "}":
            close_statement(frame)
        n = node({"}": "block", ")": "(", "]": "["}[mark], start, stop)
        n.children = done + parts
        frames[-1][3].append(n)

    for k, (word, start, stop) in enumerate(tokens):
        if word in CLOSED:
            frames.append((CLOSED[word], start, [node(word, start, stop)], [], []))
            continue
        if word in ")]}" and any(f[0] == word for f in frames[1:]):
            while frames[-1][0] != word:
                close_bracket(start)
            if word == "}":
                close_statement(frames[-1])
            frames[-1][3].append(node(word, start, stop))
            if word == "}":
                frames[-1][2].extend(frames[-1][3]), frames[-1][3].clear()
            close_bracket(stop)
        else:
            remark = word.startswith(("//", "/*"))
            frames[-1][3].append(node("comment" if remark else "string" if word[0] in "\"'`" else "identifier" if word[0].isalpha() or word[0] == "_" else "number" if word[0].isdigit() else word, start, stop))
            if not remark:
                frames[-1][4].append(word)
        frame = frames[-1]
        follows = tokens[k + 1][0] if k + 1 < len(tokens) else ""
        if frame[0] in ("", "}") and (word == ";" or word == "}" and frame[3] and frame[3][-1].kind == "block" and follows not in (";", ",", ")", ".", "else", "catch", "finally", "while", "as", "=", "?", "[", "(")):
            close_statement(frame)
    while len(frames) > 1:
        close_bracket(len(data))
    close_statement(frames[0])
    root.children = frames[0][2]
    return root


#: Extension -> node source. Fixed values.
SOURCES = {".py": python_tree, ".java": brace_tree, ".cs": brace_tree, ".ts": brace_tree, ".tsx": brace_tree}


def tree_of(path: str, source: str) -> Node | None:
    """The tree of a file by its extension; other files are taken for Python."""
    return SOURCES.get(os.path.splitext(path or "")[1].lower(), python_tree)(source)


Window = list[tuple[Node, tuple[Node, ...]]]


def pack(root: Node, sums: np.ndarray, most: int) -> list[Window]:
    """Windows of (node, its ancestors). The whole tree if it fits, else siblings from left to right while they fit together.

    A sibling that alone is too large is replaced by its children's windows, neighbouring ones of which are put together while they fit; it shares a
    window with nothing before or after it. One without children has no window, as in the reference.
    """
    size = lambda n: int(sums[n.stop] - sums[n.start])
    if size(root) <= most:
        return [[(root, ())]]

    def siblings(nodes: list[Node], above: tuple[Node, ...]) -> list[Window]:
        out: list[Window] = []
        room = 0  # what the last window still takes; 0 begins a new one
        for n in nodes:
            s = size(n)
            if s > most:
                out += together(siblings(n.children, (*above, n)))
                room = 0
            elif s <= room:
                out[-1].append((n, above))
                room -= s
            else:
                out.append([(n, above)])
                room = most - s
        return out

    def together(windows: list[Window]) -> list[Window]:
        out: list[Window] = []
        total = 0
        for w in windows:
            s = sum(size(n) for n, _ in w)
            if out and total + s <= most:
                out[-1] += w
                total += s
            else:
                out.append(list(w))
                total = s
        return out

    return siblings(root.children, (root,))


def overlapped(windows: list[Window], k: int) -> list[Window]:
    """Each window with the last k nodes of the one before and the first k of the one after."""
    if k < 0:
        raise ValueError("an overlap can't be negative")
    if not k:
        return windows
    return [(windows[i - 1][-k:] if i else []) + w + (windows[i + 1][:k] if i + 1 < len(windows) else []) for i, w in enumerate(windows)]


def rebuilt(window: Window, data: bytes) -> str:
    """The nodes' texts at their rows and columns; what stood between them becomes line breaks and spaces."""
    if not window:
        return ""
    row, col = window[0][0].start_row, 0
    out = []
    for n, _ in window:
        if n.start_row > row:
            out.append("\n" * (n.start_row - row))
            col = 0
        out.append(" " * max(0, n.start_col - col))
        out.append(data[n.start : n.stop].decode("utf-8", "replace"))
        row, col = n.end_row, n.end_col
    return "".join(out)


def nodes_in_range(root: Node, start: int, stop: int) -> list[Node]:
    """The nodes that lie wholly in a byte range, the module aside; nothing below a node of kind ERROR. The last child comes first."""
    if stop < start:
        raise ValueError("a range can't end before it starts")
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.kind == "ERROR":
            continue
        if start <= n.start and n.stop <= stop and n.kind != "module":
            out.append(n)
        stack += n.children
    return out


def largest_in_range(root: Node, sums: np.ndarray, start: int, stop: int, by: str = "non-ws") -> int:
    """The largest node's size in a range, by 'non-ws' or 'byte'; 0 if there is none."""
    if by not in ("non-ws", "byte"):
        raise ValueError(f"unknown size {by!r}")
    return max((int(sums[n.stop] - sums[n.start]) if by == "non-ws" else n.stop - n.start for n in nodes_in_range(root, start, stop)), default=0)


OUT = "doc string, window_no int, filepath string, start_row int, end_row int, n_nodes int, chunk_size int, ancestors array<string>, title string, content string"


def structural_chunks(
    files: DataFrame, doc: str, path: str, content: str, most: int = 1000, overlap: int = 0, expand: bool = False, template: str = "default", source: Callable[[str], Node | None] | None = None
) -> DataFrame:
    """One row for each window of each file: rows from 0, size without white space of the text before expansion, the headers of the classes and functions around its first node.

    A file's tree is chosen by its path unless a ``source`` is given. A Python file that doesn't parse, and null contents, have no windows; ``template`` decides what path and title an expansion shows.
    """
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, name, text in b.itertuples(index=False):
                root = (source(text) if source else tree_of(name, text)) if text else None
                if root is None:
                    continue
                data = text.encode("utf-8", "replace")
                for k, w in enumerate(overlapped(pack(root, nws_sums(data), most), overlap)):
                    body = rebuilt(w, data)
                    around = [data[max(a.start, a.head) : a.stop].decode("utf-8", "replace").split("\n")[0] for a in w[0][1] if a.kind in ("class_definition", "function_definition")]
                    first, last = w[0][0].start_row, w[-1][0].end_row
                    title = f"{key}_{first}-{last}" if template == "coderagbench-swebench-lite" else None
                    size = sum(not c.isspace() or c not in " \t\n\r\x0b\x0c" for c in body)
                    shown = {"default": name, "coderagbench-repoeval": name, "coderagbench-swebench-lite": name, "none": ""}[template] or ""
                    if expand:
                        steps = "\n".join("\t" * i + a for i, a in enumerate(around))
                        body = "\n".join(x for x in ("'''", shown, steps, "'''") if x) + "\n" + body
                    rows.append((key, k, name, first, last, len(w), size, around, title, body))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return spread(files.select(F.col(doc).cast("string"), path, content)).mapInPandas(run, OUT)


def node_table(files: DataFrame, doc: str, content: str, source: Callable[[str], Node | None] | None = None, path: str | None = None) -> DataFrame:
    """One row for each node of each file's tree, numbered in preorder, with parent, place among its siblings, bytes, rows, columns, size without white space and whether it is a leaf; none for a file that doesn't parse.

    The tree is chosen by ``path``, a column, unless a ``source`` is given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text, name in b.itertuples(index=False):
                root = (source(text) if source else tree_of(name, text)) if text else None
                sums = nws_sums(text.encode("utf-8", "replace")) if root else None
                stack = [(root, None, 0)] if root else []
                k = 0
                while stack:
                    n, parent, place = stack.pop()
                    rows.append((key, k, parent, place, n.kind, n.start, n.stop, n.start_row, n.start_col, n.end_row, n.end_col, int(sums[n.stop] - sums[n.start]), not n.children))
                    stack += [(c, k, i) for i, c in reversed(list(enumerate(n.children)))]
                    k += 1
            yield pd.DataFrame(rows, columns=AST_NODE.names).astype({"parent_id": "Int32"})

    return spread(files.select(F.col(doc).cast("string"), content, (F.col(path) if path else F.lit("")).alias("_path"))).mapInPandas(run, AST_NODE)


def code_windows(chunks: DataFrame, template: str = "default", repo: str | None = None) -> DataFrame:
    """Windows of structural_chunks() in the shape of a metadata template: (content, metadata), or (_id, title, text) for the one that has titles. The field names are fixed values."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}")
    if template == "coderagbench-swebench-lite":
        return chunks.select(F.col("title").alias("_id"), F.col("filepath").alias("title"), F.col("content").alias("text"))
    numbers = [
        F.col("chunk_size").alias("chunk_size"), (F.col("end_row") - F.col("start_row") + 1).alias("line_count"), F.col("start_row").alias("start_line_no"), F.col("end_row").alias("end_line_no"), F.col("n_nodes").alias("node_count"),
    ]
    if template == "none":
        return chunks.select("content", F.create_map().cast("map<string,string>").alias("metadata"))
    if template == "default":
        return chunks.select("content", F.struct(F.col("filepath").alias("filepath"), *numbers).alias("metadata"))
    return chunks.select("content", F.struct(F.split("filepath", "/").alias("fpath_tuple"), F.lit(repo).alias("repo"), *numbers).alias("metadata"))


def cut_candidates(root: Node, level: str, kinds: frozenset[str]) -> list[tuple[int, int]]:
    """(first row, last row) of nodes at which a file may be cut: in its 10th to 75th part, not above row 5, by level of one row, of more, or of any."""
    total = root.end_row + 1
    low, high = max(5, int(0.10 * total)), int(0.75 * total)
    if low >= high:
        low, high = 5, max(6, total - 1)
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        one = n.start_row == n.end_row
        if low <= n.start_row <= high and n.kind in kinds and (level == "mixed" or one == (level == "line")):
            out.append((n.start_row, n.end_row))
        stack += n.children
    return sorted(out)
