"""Column functions over source text. All of them stay in the JVM.

Null texts count as empty unless a function says otherwise. White space is Unicode's, lines end where Python's
``splitlines`` ends them, and a line end at the very end of a text opens no further line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose matches must equal the reference's. Fixed values.
IDENTIFIER = r"[_a-zA-Z][_a-zA-Z0-9]*"
CALL = r"(?<!def\s)(?<!class\s)([_a-zA-Z][_a-zA-Z0-9]*)\s*\("
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: The characters that Python strips. Fixed values.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Words that are never call names, and Python's keywords, which are no identifiers of a query. Fixed values.
NO_CALLS = ["if", "for", "while", "with", "return", "class", "def"]
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
#: Extension -> language; anything else is taken for Python. Fixed values.
LANGUAGES = {".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".cpp": "cpp", ".c": "c", ".go": "go", ".rb": "ruby"}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(text(c), F.lit(SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(text(c), F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(text(c), F.lit(SPACE))


def lines(c: Column) -> Column:
    """The lines of a text; none of an empty one."""
    parts = F.split(text(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newline_normalised(c: Column) -> Column:
    return F.regexp_replace(text(c), "\\r\\n?", "\n")


def nonblank_lines(c: Column) -> Column:
    return F.filter(F.split(text(c), "\n", -1), lambda x: strip(x) != "")


def last_line(c: Column) -> Column:
    """The last line, '' if there is none."""
    return F.coalesce(F.get(lines(c), F.size(lines(c)) - 1), F.lit(""))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(IDENTIFIER), F.lit(0))


def identifier_set(c: Column) -> Column:
    """Distinct identifiers in the order of their first place."""
    return F.array_distinct(identifiers(c))


def words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def query_identifiers(c: Column) -> Column:
    return F.array_except(identifier_set(c), words(KEYWORDS))


def call_names(c: Column) -> Column:
    """Distinct names before '(' in the order of their first place. A name after 'def ' or 'class ' loses its first character, as the reference's pattern has it."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text(c), F.lit(CALL), F.lit(1))), words(NO_CALLS))


def trailing_identifier(c: Column) -> Column:
    """The identifier that ends the right-stripped text, else ''."""
    return F.regexp_extract(F.substring_index(rstrip(c), "\n", -1), IDENTIFIER + r"\z", 0)


def member_access(c: Column) -> tuple[Column, Column]:
    """(owner, begun member) of a member access that ends the text's last line, else two ''."""
    pattern = rf"({IDENTIFIER})\s*\.\s*({IDENTIFIER})?\z"
    end = rstrip(last_line(F.substring_index(rstrip(c), "\n", -1)))
    return F.regexp_extract(end, pattern, 1), F.regexp_extract(end, pattern, 2)


def class_hints(c: Column) -> Column:
    """Names and classes of assignments 'name = Class(', then capitalised identifiers; distinct, in order."""
    pattern = rf"({IDENTIFIER})\s*=\s*([A-Z][_a-zA-Z0-9]*)\s*\("
    made = F.flatten(F.zip_with(F.regexp_extract_all(text(c), F.lit(pattern), F.lit(1)), F.regexp_extract_all(text(c), F.lit(pattern), F.lit(2)), lambda a, b: F.array(a, b)))
    return F.array_distinct(F.concat(made, F.filter(query_identifiers(c), lambda x: x.rlike("^[A-Z]"))))


def import_hints(c: Column) -> Column:
    """Distinct identifiers on lines that begin with import or from, without those words and 'as'."""
    own = F.filter(F.transform(lines(c), strip), lambda x: starts_any(x, ("import ", "from ")))
    return F.array_except(F.array_distinct(F.flatten(F.transform(own, identifiers))), words(["import", "from", "as"]))


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[ext], F.lit("python"))


def starts_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))


def is_comment_only(c: Column) -> Column:
    own = F.transform(nonblank_lines(c), strip)
    return (F.size(own) > 0) & (F.forall(own, lambda x: x.startswith("#")) | F.forall(own, lambda x: starts_any(x, ("//", "/*", "*", "*/"))))


def is_import_only(c: Column, lang: Column) -> Column:
    """Whether a text has only import lines, in Python, Java, JavaScript or TypeScript; elsewhere never."""
    own = F.transform(nonblank_lines(c), strip)
    python = F.forall(own, lambda x: starts_any(x, ("import ", "from ")))
    other = F.forall(own, lambda x: x.startswith("import "))
    return (F.size(own) > 0) & F.when(lang == "python", python).when(lang.isin("java", "javascript", "typescript"), other).otherwise(False)


def is_eligible(c: Column, least_lines: int = 200, least_chars: int = 2000) -> Column:
    """Whether a file is long enough to be cut; a null never is."""
    return F.coalesce((F.length(c) >= least_chars) & (F.size(F.split(c, "\n", -1)) >= least_lines), F.lit(False))


NWS = "[ \\t\\n\\r\\x0b\\x0c]"


def nws_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(text(c), NWS, ""))


def nws_bytes(c: Column) -> Column:
    return F.octet_length(F.regexp_replace(text(c), NWS, ""))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
