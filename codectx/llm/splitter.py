"""Splitting oversized items at natural boundaries.

Sizes of lines are summed once; a piece's last admissible line and its last
boundary are found by binary search in sorted arrays; the next piece starts
``overlap`` lines before the end of the last one. A line that is longer than the
limit by itself is cut hard.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codectx.llm.common import text_or_empty

MAX_LINES, MAX_CHARS, OVERLAP = 120, 6000, 2
#: A line that begins a definition, in the languages that code chunks are in.
STARTS = re.compile(r"\s*(?:@\w|(?:export |public |private |protected |static |async |default |abstract |final )*(?:def|class|func|function|interface|enum|type|namespace)\b)")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
PIECES = "chunk_key long, chunk_type string, piece_no int, start_line int, end_line int, first_line int, last_line int, cut string, text string"


def lines_of(text: str) -> list[str]:
    """Lines with their ends; an end at the very end of the text opens no further line.

    >>> lines_of("a\\r\\nb\\n")
    ['a\\r\\n', 'b\\n']
    """
    return LINE.findall(text)


def boundaries(lines: list[str]) -> tuple[list[int], list[int]]:
    """(strong, weak): sorted indices k such that the text may be cut before line k.

    Strong: before a definition that stands no deeper than any line since the text's start but its own head,
    or after a blank line before a line of least indentation. Weak: at any blank line or before a line
    that is indented less than the one before it.
    """
    strong, weak = [], []
    indents = [len(x) - len(x.lstrip(" \t")) if x.strip() else -1 for x in lines]
    body = [i for i in indents[1:] if i >= 0]
    least = min(body, default=0)
    before = 0
    for k, line in enumerate(lines):
        if k and indents[k] >= 0:
            blank = indents[k - 1] < 0
            if STARTS.match(line) and not lines[k - 1].lstrip().startswith("@") or blank and indents[k] <= least:
                strong.append(k)
            elif blank or indents[k] <= least or indents[k] < before:
                weak.append(k)
        if indents[k] >= 0:
            before = indents[k]
    return strong, weak


def pieces(text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """[(first line, last line, how it was cut, text)] with lines counted from 1.

    A text within both limits is one piece ('whole'). Neighbours share ``overlap`` lines (fewer where that
    many would leave no room for a new line, none around a line that is cut hard). 'cut' says where the piece ends:
    'boundary', 'line' (no boundary was in reach), 'hard' (inside a line) or 'end'.

    >>> [p[:3] for p in pieces("a\\nb\\nc\\nd", max_lines=3, overlap=1)]
    [(1, 3, 'boundary'), (3, 4, 'end')]
    """
    lines = lines_of(text)
    if len(lines) <= max_lines and len(text) <= max_chars:
        return [(1, max(1, len(lines)), "whole", text)]
    sums = [0, *accumulate(map(len, lines))]
    strong, weak = boundaries(lines)
    out: list[tuple[int, int, str, str]] = []
    start, fresh, n = 0, 0, len(lines)  # a piece is lines[start:end]; lines from fresh on aren't in any piece yet
    while fresh < n:
        end = min(n, start + max_lines, bisect_right(sums, sums[start] + max_chars) - 1)
        if end <= fresh:  # the shared lines leave no room for the next one
            if start < fresh:
                start += 1
                continue
            line = lines[fresh]
            for at in range(0, len(line), max_chars):
                out.append((fresh + 1, fresh + 1, "hard", line[at : at + max_chars]))
            fresh = start = fresh + 1
            continue
        how = "end" if end == n else "line"
        if end < n:
            for marks, share in ((strong, 3), (weak, 2)):
                k = bisect_right(marks, end) - 1
                least = fresh + max(1, (end - fresh) // share)
                if k >= 0 and marks[k] >= least and k >= bisect_left(marks, least):
                    end, how = marks[k], "boundary"
                    break
        out.append((start + 1, end, how, "".join(lines[start:end])))
        fresh, start = end, max(end - overlap, start + 1) if end < n else end
    return out


def put_together(pieces: DataFrame) -> DataFrame:
    """(chunk_key, pieces, text): the texts of split_oversized() again, from their pieces without the lines that neighbours share. A chunk's pieces are no more than its own text."""
    before = Window.partitionBy("chunk_key").orderBy("piece_no")
    last, cut = F.lag("last_line").over(before), F.lag("cut").over(before)
    shared = F.when((F.col("cut") == "hard") | (cut == "hard"), 0).otherwise(F.greatest(F.lit(0), F.coalesce(last - F.col("first_line") + 1, F.lit(0))))
    rows = pieces.withColumn("shared", shared.cast("int")).withColumn("own", F.array_join(F.slice(F.split("text", "\n", -1), F.col("shared") + 1, F.size(F.split("text", "\n", -1))), "\n"))
    whole = rows.groupBy("chunk_key").agg(F.count("*").alias("pieces"), F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("l"))
    return whole.select("chunk_key", "pieces", F.array_join(F.transform("l", lambda x: x["own"]), "").alias("text"))


def split_oversized(df: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the code chunks whose text has more than ``max_lines`` lines or ``max_chars`` code points.

    ``df``: chunk_key, chunk_type, start_line, text; other columns aren't looked at. first_line and last_line count
    within the text, start_line and end_line are those shifted by the chunk's own start_line (1 where that is null).
    Null and empty texts are within the limits. Only oversized texts reach Python; rows never move.
    """
    text = text_or_empty("text")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    over = df.filter((F.length(text) > max_chars) | (n_lines > max_lines)).select(
        "chunk_key", "chunk_type", F.coalesce("start_line", F.lit(1)).alias("start_line"), text.alias("text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, kind, k, shift + first - 1, shift + last - 1, first, last, cut, piece)
                for key, kind, shift, text in batch.itertuples(index=False)
                for k, (first, last, cut, piece) in enumerate(pieces(text, max_lines, max_chars, overlap))
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return over.mapInPandas(run, PIECES)
