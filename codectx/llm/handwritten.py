"""Generated, minified or vendored source files: mark them so that only hand-written source remains.

Three kinds of evidence, each enough by itself: the path (vendored folders, lockfiles, suffixes of generated and minified
files), a notice in the file's header, and the shape of the text (minified lines, data written as code). Notices are found by one
pass of a multi-pattern automaton over the header, that is, the comments and docstring before the first line of code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import crossfile_entries, spread

#: Notices in lower case. 'g' generated, 't' third-party. A phrase that begins with '^' must stand at the start of a header line. Fixed values.
NOTICES = {
    "g": (
        "code generated by", "code generated from", "@generated", "<auto-generated", "auto-generated file", "autogenerated file", "automatically generated", "auto-generated by", "autogenerated by", "auto-generated from", "auto-generated code", "^auto-generated.", "^autogenerated.",
        "^generated by", "^generated from", "^generated with", "^generated code", "file is generated", "file was generated", "file has been generated", "file is auto", "^this is generated", "generated by the protocol buffer", "^generated file",
        "do not edit", "do not modify", "don't edit this file", "please do not edit", "not edit manually", "do not change this file", "machine-written", "machine generated", "machine-generated", "automatically created by", "automatically produced by", "was created by the", "manual changes will be", "changes will be lost", "changes will be overwritten", "will be overwritten", "any changes made here", "manual edits",
        "regenerate with", "re-run the generator", "edit the template instead", "template instead", "edit the source", "erzeugt von", "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "nicht von hand", "nicht bearbeiten", "nicht manuell",
        "ne pas modifier", "ne pas éditer", "ne pas editer", "fichier produit par", "fichier généré", "fichier genere", "généré automatiquement", "genere automatiquement", "généré par", "no editar", "no modificar", "generado automáticamente", "generado automaticamente", "generado por", "archivo generado", "não editar", "nao editar", "não modificar", "nao modificar", "gerado automaticamente", "gerado por", "arquivo gerado",
        "wygenerowan", "nie edytować", "nie edytowac", "nie modyfikować", "сгенерирован", "не редактировать", "не изменять", "не правьте", "создан автоматически", "non modificare", "generato automaticamente", "自动生成", "請勿修改", "请勿修改", "自動生成",
    ),
    "t": (
        "bundled copy of", "bundled from", "vendored from", "vendored copy", "^vendored", "third-party source", "third party source", "third-party code", "^third-party", "^third party", "taken unchanged from", "copied unchanged from", "copied verbatim", "imported from upstream", "unmodified copy", "local changes go upstream", "unchanged from upstream", "redistribution permitted",
        "contributors | permissive", "contributors | mit", "contributors | bsd", "contributors | apache", "@license", "@preserve", "not covered by our style", "minified by", "under the terms in license",
    ),
}
#: Folders whose files come from elsewhere or from a program. Fixed values.
VENDORED = frozenset("vendor vendors third_party third-party thirdparty 3rdparty 3rd_party extern external externals deps node_modules bower_components jspm_packages site-packages dist-packages pods carthage godeps _vendor vendored contrib_libs elm-stuff".split())
GENERATED = frozenset("generated gen-src gen_src __generated__ generated-src generated-sources generated_sources autogen auto_generated .generated gensrc codegen_out __pycache__ .next".split())
PAIRS = frozenset({("build", "gen"), ("build", "generated"), ("target", "generated"), ("dist", "js"), ("static", "vendor"), ("out", "gen"), ("src", "gen"), ("build", "lib")})
SUFFIX = re.compile(
    r"(?i)(?:[._-]min\.(?:js|mjs|cjs|css|ts)|\.bundle\.js|\.chunk\.js|\.pb\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb\.go|\.g\.\w+|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|\.auto\.\w+|\.designer\.\w+|_gen\.go|zz_generated\.\w+|\.freezed\.dart|\.d\.ts\.map|\.js\.map|\.css\.map)$"
)
LOCKFILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock uv.lock cargo.lock composer.lock gemfile.lock go.sum gopkg.lock packages.lock.json podfile.lock mix.lock flake.lock bun.lockb".split())
JUDGED = re.compile(r"(?i)\.(?:py|pyi|js|mjs|cjs|jsx|ts|tsx|java|go|c|h|cc|cpp|cs|rb|php|css|scala|kt|rs|swift)$")
#: What stands before a notice that is spoken about: code that deals with generated files.
SPOKEN_OF = re.compile(r"\b(?:for|of|about|with|from|on|into|reads?|parses?|checks?|detects?|skips?|finds?|handles?|ignores?|wraps?|tests?|helpers?|whether|if|that|which|says?) +(?:(?:the|all|any|every|our|a|an) +)?(?:source +|files? +)?\Z|\b(?:whether|if|that|where) [\w ]{1,30}(?:is|are|was|were) +\Z")
COMMENT = re.compile(r"(?:#|//|/\*|\*/|\*|--|;|<!--|\"\"\"|'''|[rbu]?\"{3}|%)")
#: A line that is nothing but literals, after a name they may be assigned to.
DATA_LINE = re.compile(r"""\s*(?:(?:var|let|const|static|final|public|private|val|byte|int)\s+)*(?:[\w.$\[\]<>]+\s*(?::\s*[\w\[\]<>.]+\s*)?:?=\s*)?(?:(?:new\s+)?[\w\[\].]*\s*[\[({]\s*)*(?:(?:"(?:[^"\\\s]|\\.)*"|'(?:[^'\\\s]|\\.)*'|-?(?:0x[0-9a-fA-F]+|\d[\d_.eE+-]*)|true|false|null|None|True|False)\s*[,:;\])}\[({\s]*)*;?\s*""")
LITERAL = re.compile(r"""\"(?:[^"\\\s]|\\.)*\"|'(?:[^'\\\s]|\\.)*'|0x[0-9a-fA-F]+|\b\d[\d.]*\b""")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in NOTICES.items():
        for p in phrases:
            a.add_word(p.lstrip("^"), (kind, p.lstrip("^"), p[0] == "^"))
    a.make_automaton()
    return a


def lines_of(text: str) -> Iterator[str]:
    """The lines one by one, so that a reader that stops early has split no more of the text."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def header(text: str) -> Iterator[str]:
    """The comment and docstring lines before the first line of code, however many, without their marks; '#!' and coding lines are skipped.

    >>> list(header('# a\\n\\nx = 1\\n# b'))
    ['a']
    """
    closing = ""
    for k, line in enumerate(lines_of(text)):
        body = line.strip()
        if not body or k < 2 and (body.startswith("#!") or "coding" in body[:24] and body[0] == "#"):
            continue
        if closing:
            done = closing in body
            yield body.replace(closing, " ").lstrip("* ").strip()
            closing = "" if done else closing
            continue
        m = COMMENT.match(body)
        if not m:
            break
        mark = m.group()
        rest = body[m.end() :]
        close = "*/" if mark == "/*" else "-->" if mark == "<!--" else mark[-3:] if mark[-3:] in ('"""', "'''") else ""
        if close:
            at = rest.find(close)
            if at < 0:
                closing = close
            elif rest[at + len(close) :].strip():
                yield rest[:at].lstrip("!* ").strip()
                break  # code follows on the same line
            rest = rest[:at] if at >= 0 else rest
        yield rest.lstrip("!*/#-; ").strip()


def notice(text: str) -> str:
    """'g' or 't' if the header says the text is generated or third-party, else ''. A phrase in quotes is spoken about, not said."""
    for line in header(text):
        low = line.lower()
        for end, (kind, phrase, at_start) in automaton().iter(low):
            start = end + 1 - len(phrase)
            if phrase == "do not modify" and low.startswith(" the licen", end + 1):  # Apache's text says so of its notices
                continue
            if SPOKEN_OF.search(low, max(0, start - 60), start) or low.startswith((" without", " unless"), end + 1):
                continue
            if at_start and start > 0 or low[:start].count("'") % 2 or low[:start].count('"') % 2 or low[:start].count("`") % 2:
                continue
            return kind
    return ""


def minified(text: str) -> bool:
    """Whether the code stands on few long lines without the white space that people write. Literals with spaces (help texts) don't count."""
    lines = [x for x in text.split("\n") if x.strip()]
    long = [x for x in lines if len(x) > 250]
    if not long or sum(map(len, long)) < 0.6 * sum(map(len, lines)):
        return False
    code = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`[^`]*`', '""', "\n".join(long))
    return len(code) > 150 and len(re.findall(r"\s", code)) < 0.12 * len(code) and len(re.findall(r"[;{}()=,]", code)) > 0.12 * len(code)


def data_as_code(text: str) -> bool:
    """Whether nearly all of the text are literals without white space: tables, byte arrays, encoded blobs."""
    if len(text) < 200:
        return False
    lines = [x for x in text.split("\n") if x.strip() and not COMMENT.match(x.strip())]
    if not lines:
        return False
    total = sum(map(len, lines))
    data = n = 0
    for x in lines:
        found = len(LITERAL.findall(x))
        if (found >= 3 or found and len(x) >= 60) and (DATA_LINE.fullmatch(x) if len(x) < 2000 else 1.6 * sum(map(len, LITERAL.findall(x))) > len(x)):
            data += len(x)
            n += found
    return data >= 0.75 * total and (n >= 12 or data >= 400)


def judge(path: str, text: str, first: bool = True) -> str:
    """Why a text isn't hand-written ('generated', 'third-party', 'minified', 'data'), or ''. first: it begins its file."""
    if not text:
        return ""
    if first and (kind := notice(text)):
        return "generated" if kind == "g" else "third-party"
    if not JUDGED.search(path):
        return ""
    return "minified" if minified(text) else "data" if data_as_code(text) else ""


def judge_path(path: str) -> str:
    """Why a path alone tells that its file isn't hand-written, or ''.

    >>> [judge_path(x) for x in ("a/vendor/x.py", "vendors_api/x.py", "a/b.min.js", "go.sum")]
    ['third-party', '', 'minified', 'generated']
    """
    parts = [p for p in re.split(r"[\\/]+", path.lower()) if p not in ("", ".")]
    if not parts:
        return ""
    folders = parts[:-1]
    if any(p in VENDORED for p in folders):
        return "third-party"
    if any(p in GENERATED for p in folders) or any(pair in PAIRS for pair in zip(folders, folders[1:])) or parts[-1] in LOCKFILES:
        return "generated"
    m = SUFFIX.search(parts[-1])
    return "" if not m else "minified" if "min." in m.group() or "bundle" in m.group() or "chunk" in m.group() else "generated"


def plain_path(path: Column) -> Column:
    """One spelling of a path: forward slashes, no empty or '.' parts, none before the first name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\+", "/"), r"(?:^|/)(?:\./)+|/{2,}", "/"), r"^/+", "")


def judged(texts: DataFrame) -> DataFrame:
    """(key, path, reason) of the texts (key, path, content, first) that aren't hand-written by path or content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, path, why) for key, path, text, first in b.itertuples(index=False) if (why := judge_path(path or "") or judge(path or "", text or "", first))]
            yield pd.DataFrame(rows, columns=["key", "path", "reason"])

    return spread(texts.select("key", "path", "content", "first")).mapInPandas(run, "key long, path string, reason string")


def not_handwritten(loader_samples: DataFrame, code_chunks: DataFrame) -> DataFrame:
    """(origin, record_id, file_path, reason) of entries of crossfile_context and of code chunks that nobody wrote by hand.

    A chunk is marked if any chunk of its file (same repo, path in whatever spelling) gives evidence; only these
    verdicts, one small row for each file, are joined with the chunks' keys and paths. Null contents are judged by their path,
    null paths by their content (chunks of null repo or path only for themselves). Repeated rows are marked each.
    """
    entries = judged(crossfile_entries(loader_samples).select(F.col("record_id").alias("key"), F.col("file_path").alias("path"), "content", F.lit(True).alias("first")))
    cross = entries.select(F.lit("crossfile").alias("origin"), F.col("key").alias("record_id"), F.col("path").alias("file_path"), "reason")
    own = judged(code_chunks.select(
        F.col("chunk_key").alias("key"), F.col("file_path").alias("path"), F.col("text").alias("content"),
        (F.coalesce("start_line", F.lit(1)) <= 1).alias("first"),
    ))
    spelled = code_chunks.select("chunk_key", "file_path", F.coalesce("repo", F.lit("")).alias("r"), plain_path(F.col("file_path")).alias("p")).select(
        "chunk_key", "file_path", F.when(F.col("p").isNull(), F.concat(F.lit("#"), F.col("chunk_key").cast("string"))).otherwise(F.concat_ws("|", "r", "p")).alias("file")
    ).select("chunk_key", "file_path", F.xxhash64("file").alias("h1"), F.xxhash64(F.lit(3), "file").alias("h2"))
    # the verdicts meet the chunks twice: by key, to learn their files, and by file, to reach the files' other chunks
    files = own.join(spelled, own["key"] == spelled["chunk_key"]).groupBy("h1", "h2").agg(F.min("reason").alias("reason"))
    chunks = spelled.join(files, ["h1", "h2"]).select(F.lit("chunk").alias("origin"), F.col("chunk_key").alias("record_id"), "file_path", "reason")
    return cross.unionByName(chunks)
