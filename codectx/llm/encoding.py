"""Garbled text from wrong character encoding: find it and restore the original.

Two passes over the texts. The first counts adjacent character pairs of which at least one is outside ASCII,
and single characters, into tables of fixed size. From them a pair (a, b) gets its pointwise mutual information
log2(n * c(ab) / (c(a) * c(b))), shrunk towards -4 where the pair is rare. The second pass scores each text's pairs,
isolates the maximum-scoring segments of improbable ones, and tests inverse mappings inside these only.

Garbling that is itself common in the corpus would support its own pairs ('Ã' is mostly followed by '©' or '¼'). The counts
behind the mutual information are therefore those outside of runs that read like UTF-8 taken for another encoding: however often
garbling is repeated, it doesn't feed the statistics that judge it. Such a run isn't thereby garbled; whether its pairs are improbable is for the counts
to say, and whether anything is restored for the comparison with the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import spread

#: Sizes of the tables of counts; what a broadcast of them takes doesn't depend on the corpus.
PAIR_BITS, CHAR_BITS = 18, 16
#: Encodings whose misuse on UTF-8 bytes is undone, and (read as, really) for bytes of another one-byte encoding. Fixed values.
OVER_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "koi8-r", "cp866", "cp1253", "mac_cyrillic")
ONE_BYTE = (
    ("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("cp1252", "iso8859-2"), ("latin-1", "cp1250"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"),
    ("latin-1", "iso8859-5"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1252", "cp1253"), ("latin-1", "iso8859-7"), ("cp1252", "cp1254"),
)
REPLACED = "�"
NON_ASCII = re.compile(r"[^\x00-\x7f]")
RUN = re.compile(r"[^\x00-\x7f]+")
INSIDE = re.compile(r"(?<=[a-z])[^\x00-\x7f](?=[a-z])")
RUNS = re.compile(r"[^\x00-\x7f]{2,}")
RUSSIAN = re.compile("[\u0410-\u044f\u0401\u0451]+")
#: A pair below this mutual information is improbable; what a pair of ASCII characters inside a segment costs.
LEAST_PMI, BRIDGE = -1.0, -0.45
#: Bits per non-ASCII pair that a one-byte mapping must gain over the text as it stands.
GAIN = 2.0
#: Bits by which text restored from UTF-8 may be less likely than it was.
SLACK = 3.0
#: Bits by counts outside of UTF-8-like runs: a gain that decides by itself, as a loss of as much refuses; what a letter of another alphabet beside an ASCII letter costs there, and the weight of the fixed shares in these counts.
CLEAN_GAIN, MIXED, FIXED = 4.0, 12.0, 4096.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _slots(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return ((((a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _char_slots(a: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * MIX) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)


def count_pairs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, slot, n) over all texts: kind 'c' single characters, 'p' pairs with one outside ASCII, 'u' and 'v' those of them that are in parts like UTF-8 read as another encoding. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, like, pairs, like_pairs = (np.zeros(1 << bits, np.int64) for bits in (CHAR_BITS, CHAR_BITS, PAIR_BITS, PAIR_BITS))
        ascii_counts = np.zeros(128, np.int64)
        for batch in batches:
            for text in batch[text_col]:
                if text.isascii():
                    ascii_counts += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
                    continue
                x = codes(text)
                np.add.at(chars, _char_slots(x), 1)
                a, b = x[:-1], x[1:]
                far = (a > 127) | (b > 127)
                np.add.at(pairs, _slots(a[far], b[far], PAIR_BITS), 1)
                for s, e in doubtful(text):
                    np.add.at(like, _char_slots(x[s:e]), 1)
                    np.add.at(like_pairs, _slots(x[s : e - 1], x[s + 1 : e], PAIR_BITS), 1)
        np.add.at(chars, _char_slots(np.arange(128)), ascii_counts)
        for kind, counts in (("c", chars), ("u", like), ("p", pairs), ("v", like_pairs)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": kind, "slot": at, "n": counts[at]})

    return (
        spread(df.filter(F.length(text_col) > 0).select(text_col))
        .mapInPandas(run, "kind string, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
    )


class PairModel:
    """Mutual information of adjacent characters, from tables of fixed size."""

    def __init__(self, chars: np.ndarray, pairs: np.ndarray, like: np.ndarray | None = None, like_pairs: np.ndarray | None = None):
        self.clean = chars.astype(np.float64) - (0 if like is None else like)
        self.clean_pairs = pairs.astype(np.float64) - (0 if like_pairs is None else like_pairs)
        self.clean_total = float(self.clean.sum())
        self.chars, self.pairs, self.total = chars.astype(np.float64), pairs.astype(np.float64), max(1.0, float(chars.sum()))
        self.logs: dict[str, float] = {}

    @classmethod
    def of(cls, df: DataFrame, text_col: str = "text") -> PairModel:
        """Reads at most 2**19 + 2**17 counts into the driver, whatever the corpus' size."""
        rows = count_pairs(df, text_col).toArrow().to_pandas()
        out = []
        for kind, bits in (("c", CHAR_BITS), ("p", PAIR_BITS), ("u", CHAR_BITS), ("v", PAIR_BITS)):
            table, part = np.zeros(1 << bits, np.int64), rows[rows.kind == kind]
            table[part.slot.to_numpy(np.int64)] = part.n.to_numpy(np.int64)
            out.append(table)
        return cls(*out)

    def scores(self, text: str) -> np.ndarray:
        """Shrunk pointwise mutual information of each adjacent pair, by the counts that garbling doesn't feed; pairs within ASCII get 0."""
        x = codes(text)
        a, b = x[:-1], x[1:]
        far = (a > 127) | (b > 127)
        out = np.zeros(len(a))
        if far.any():
            a, b = a[far], b[far]
            c = self.clean_pairs[_slots(a, b, PAIR_BITS)]
            pmi = np.log2((c + 1e-3) * max(1.0, self.clean_total) / (np.maximum(1, self.clean[_char_slots(a)]) * np.maximum(1, self.clean[_char_slots(b)])))
            trust = c / (c + 5)
            out[far] = trust * pmi - 4 * (1 - trust)
        return out

    def pair_log(self, a: str, b: str) -> float:
        known = self.logs.get(a + b)
        if known is None:
            if len(self.logs) > 1 << 18:
                self.logs.clear()
            n = float(self.pairs[_slots(np.array([ord(a)]), np.array([ord(b)]), PAIR_BITS)[0]])
            known = self.logs[a + b] = float(np.log2((n + 1) / self.total))
        return known

    def likelihood(self, text: str, left: str = " ", right: str = " ") -> float:
        """Mean log2 of the share of each non-ASCII pair among all characters; 0 if there is none."""
        text = f"{left}{text}{right}"
        n, total = 0, 0.0
        for a, b in zip(text, text[1:]):
            if a > "\x7f" or b > "\x7f":
                n += 1
                total += self.pair_log(a, b)
        return total / n if n else 0.0

    def clean_bits(self, text: str, left: str = " ", right: str = " ") -> float:
        """Sum of log2 of the shares of the non-ASCII characters outside of UTF-8-like runs, with fixed shares for what is rare there."""
        far = [c for c in text if c > "\x7f"]
        n = self.clean[_char_slots(codes("".join(far)))] if far else np.zeros(0)
        bits = float(np.log2((n + FIXED * np.array([2.0 ** -usual(c) for c in far])) / (self.clean_total + FIXED)).sum())
        for a, b in ((left, text[0]), (right, text[-1])):
            if a.isascii() and a.isalpha() and b > "\u024f" and not "\u2000" <= b <= "\u22ff":
                bits -= MIXED
        return bits


@lru_cache(1 << 16)
def usual(c: str) -> float:
    """Bits of a character's fixed share: small letters and marks of European text are the usual ones, controls the least so."""
    if "\u00df" <= c <= "\u00ff" and c != "\u00f7" or c in "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00ab\u00bb\u00b0\u20ac\u00a0":
        return 10.0
    if "\u0430" <= c <= "\u044f":
        return 11.0
    if "\u0402" <= c <= "\u040f" and c not in "\u0404\u0406\u0407\u040e" or "\u0452" <= c <= "\u045f" and c not in "\u0454\u0456\u0457\u045e":
        return 20.0
    if "\u00c0" <= c <= "\u017f" or "\u0386" <= c <= "\u03ce" or "\u0400" <= c <= "\u045f":
        return 13.0
    if "\u00a1" <= c <= "\u00bf" or "\u2000" <= c <= "\u22ff" or "\u0590" <= c <= "\u06ff" or "\u0e00" <= c <= "\u0e5b" or "\u3000" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or c >= "\U0001f300":
        return 16.0
    return 24.0 if c < "\u00a0" else 20.0


@lru_cache(1 << 16)
def as_bytes(text: str, encoding: str) -> bytes | None:
    """What was read as ``text``; C1 controls, which lenient decoders pass through, stand for themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(encoding)
            except UnicodeEncodeError:
                if not 0x80 <= ord(ch) <= 0x9F:
                    return None
                out.append(ord(ch))
        return bytes(out)


@lru_cache(1 << 16)
def utf8_pair(a: str, b: str) -> bool:
    """Whether under some mapping the two characters begin a UTF-8 sequence. Two letters of Russian never count: runs of them do so by chance."""
    if "\u0410" <= a <= "\u044f" and "\u0410" <= b <= "\u044f":
        return False
    for e in OVER_UTF8:
        raw = as_bytes(a + b, e)
        if raw and len(raw) == 2 and 0xC2 <= raw[0] <= 0xF4 and 0x80 <= raw[1] <= 0xBF:
            return True
    return False


def maximal_segments(worth: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of all maximal scoring segments (Ruzzo and Tompa): none can be made longer or shorter for a larger sum.

    >>> maximal_segments(np.array([1.0, -0.5, 1.0, -3.0, 2.0]))
    [(0, 3), (4, 5)]
    """
    sums = np.concatenate(([0.0], np.cumsum(worth)))
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    for k in np.flatnonzero(worth > 0).tolist():
        start, end, left, right = k, k + 1, float(sums[k]), float(sums[k + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e) for s, e, _, _ in stack]


def segments(text: str, model: PairModel) -> list[tuple[int, int]]:
    """Maximum-scoring segments of improbable pairs, widened to whole words; a replacement character opens one by itself."""
    hits = [m.span() for m in RUN.finditer(text)]
    if not hits:
        return []
    score = model.scores(text)
    worth = np.where(score < LEAST_PMI, 1.0, -0.5)
    x = codes(text)
    near = (x[:-1] < 128) & (x[1:] < 128)
    worth[near] = BRIDGE
    found = [(s, e + 1) for s, e in maximal_segments(worth)]
    out: list[list[int]] = []
    for s, e in [*found, *([m.start(), m.end()] for m in re.finditer(REPLACED, text))]:
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        out.append([s, e])
    out.sort()
    merged: list[list[int]] = []
    for s, e in out:
        if merged and s <= merged[-1][1] + 1:  # neighbouring words are judged together
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def _whole_utf8(run: str, encodings: tuple[str, ...] = OVER_UTF8) -> tuple[str, str] | None:
    """(original, encoding) if the whole run of non-ASCII characters is UTF-8 read as another encoding."""
    if len(run) < 2:
        return None
    for e in encodings:
        raw = as_bytes(run, e)
        if raw:
            try:
                back = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(back) < len(raw) and (not any(0x80 <= ord(c) < 0xA0 for c in back) or _whole_utf8(back)):
                return back, e
    return None


@lru_cache(1 << 16)
def utf8_parts(run: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """[(part of the run, [(original, encodings), ...])]: the longest parts that are UTF-8 read as another encoding.

    The alternatives of a part begin with the one for which the wrong decoding was undone most often.
    """
    out: list[tuple[str, list[tuple[str, str]]]] = []
    k = 0
    while k < len(run):
        for end in (len(run), *range(min(len(run) - 1, k + 24), k + 1, -1)):
            if end > k + 1 and (back := _whole_utf8(run[k:end])):
                steps = [back]
                same = ("cp1252", "latin-1") if back[1] in ("cp1252", "latin-1") else (back[1],)
                while more := _whole_utf8(steps[0][0], same):  # what went wrong twice went wrong the same way
                    steps.insert(0, (more[0], f"{more[1]}, {steps[0][1]}"))
                out.append((run[k:end], steps))
                k = end
                break
        else:
            out.append((run[k], []))
            k += 1
    return out


@lru_cache(1 << 16)
def utf8_like(run: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that are like UTF-8 read as another encoding; none of a run of Russian letters."""
    if not any(utf8_pair(a, b) for a, b in zip(run, run[1:])):
        return []
    out, at = [], 0
    for old, steps in utf8_parts(run):
        if steps and not RUSSIAN.fullmatch(old):
            out.append((at, at + len(old)))
        at += len(old)
    return out


def doubtful(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that are left out of the counts which judge it."""
    return [(m.start() + s, m.start() + e) for m in RUNS.finditer(text) for s, e in utf8_like(m.group())]


def short_damage(part: str, here: float, ranked: list[tuple[float, str, str]], model: PairModel) -> bool:
    """Whether a segment too short to be restored is damaged: its pairs are improbable, those of a one-byte mapping are all probable."""
    inside = any(not c.isalpha() for c in INSIDE.findall(part))
    least = here + GAIN * (2 if inside else 4)  # a letter in place of another may belong there
    if max(ranked)[0] <= least:
        return False
    far = np.array([a > "\x7f" or b > "\x7f" for a, b in zip(part, part[1:])])
    if not far.any() or (model.scores(part)[far] >= LEAST_PMI).any():
        return False
    return any(found > least and (model.scores(back)[[a > "\x7f" or b > "\x7f" for a, b in zip(back, back[1:])]] > 0).all() for found, back, _ in ranked)


def restore(text: str, model: PairModel) -> tuple[str, list[str], int, int]:
    """(restored text, mappings undone, garbled segments, segments that stay damaged).

    >>> m = PairModel(np.zeros(1 << 16), np.zeros(1 << 18))
    >>> restore("na\\u00c3\\u00afve", m)[0]
    'na\\u00efve'
    """
    out, at, used, bad, lost = [], 0, [], 0, 0
    for s, e in segments(text, model):
        part = text[s:e]
        damaged = REPLACED in part
        seen: list[str] = []
        pieces, done = [], 0
        for m in RUN.finditer(part):
            pieces.append(part[done : m.start()])
            done = m.end()
            parts = utf8_parts(m.group())
            for k, (old, steps) in enumerate(parts):
                left = (pieces[-1] or " ")[-1] if pieces else " "
                right = parts[k + 1][0][0] if k + 1 < len(parts) else part[done : done + 1] or " "
                here = model.likelihood(old, left, right)
                # a part of a run, or a run of Russian letters, may be UTF-8 by chance
                russian = RUSSIAN.fullmatch(old)
                slack = SLACK if len(parts) == 1 and not russian else 0.0
                gains = []
                if len(parts) == 1 and steps and not russian:
                    clean = model.clean_bits(old)
                    gains = [model.clean_bits(back, left, right) - clean for back, _ in steps]
                for j, (back, encodings) in enumerate(steps):
                    if gains and gains[j] <= max(0.0, *gains) - CLEAN_GAIN:
                        continue
                    if gains and gains[j] >= CLEAN_GAIN or model.likelihood(back, left, right) >= here - slack:
                        seen.append(encodings)
                        old = back
                        break
                pieces.append(old)
        pieces.append(part[done:])
        new = "".join(pieces)
        if not seen and not damaged:
            here = model.likelihood(part)
            n = len(NON_ASCII.findall(part))
            ranked = []
            for wrong, right in ONE_BYTE:
                raw = as_bytes(part, wrong)
                if raw:
                    try:
                        back = raw.decode(right)
                    except UnicodeDecodeError:
                        continue
                    if back != part and sum(c.isalpha() for c in back if c > "\x7f") * 2 > n and not re.search(r"[a-z][A-ZА-Я]", back):
                        ranked.append((model.likelihood(back), back, f"{right} as {wrong}"))
            if ranked:
                most = max(ranked)
                if n >= 2 and most[0] > here + GAIN * (1 + 2 / n):
                    new, seen = most[1], [most[2]]
                else:
                    damaged = short_damage(part, here, ranked, model)
        if seen or damaged:
            bad += 1
            lost += damaged
            used += seen
            out += [text[at:s], new]
            at = e
    out.append(text[at:])
    return "".join(out), sorted(set(used)), bad, lost


def find_garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: PairModel | None = None) -> DataFrame:
    """(id, text, encodings, segments, lost) of the records that show garbled characters.

    text: the text restored where that can be had; encodings: the mappings undone; lost: segments that hold
    replacement characters, or are too short to tell how they read, and stay as they are. Null, empty and ASCII texts are never garbled and don't reach
    Python's part. The counts behind the decision are those of all texts of ``df`` unless a ``model`` is given.
    """
    model = model or PairModel.of(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.chars, model.pairs, model.chars - model.clean, model.pairs - model.clean_pairs))
    out = f"{id_col} long, text string, encodings array<string>, segments int, lost int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = PairModel(*shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[text_col]):
                new, used, bad, lost = restore(text, m)
                if bad:
                    rows.append((key, new, used, bad, lost))
            yield pd.DataFrame(rows, columns=[id_col, "text", "encodings", "segments", "lost"])

    return spread(df.filter(F.col(text_col).rlike(r"[^\x00-\x7f]")).select(id_col, text_col)).mapInPandas(run, out)
