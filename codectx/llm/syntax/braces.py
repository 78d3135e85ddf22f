"""Lexers of the brace languages."""

from __future__ import annotations

import re

from codectx.llm.syntax.core import LOOK, Wrong

JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while null true false _".split()
)
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())

_SPACE = r"(?P<skip>[ \t\f\v ﻿  ]+)|(?P<nl>\r?\n|\r)|(?P<line>//[^\r\n]*)|(?P<block>/\*)"
JS_TOKEN = re.compile(
    _SPACE + r"|(?P<name>(?:[^\W\d]|[$]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$‌‍]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)|(?P<private>\#[^\W\d][\w$]*)"
    r"|(?P<num>0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO]?[0-7](?:_?[0-7])*n?(?![\d.])|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)"
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')|(?P<badstr>[\"'])|(?P<tpl>`)"
    r"|(?P<op>>>>=|>>>|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@])"
)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/(?P<flags>[\w$]*)")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
#: Kinds after which a slash divides.
VALUE = frozenset(["N", "0", "S", "T", "R", "T>", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "#"])


def lex_js(text: str, errors: list[Wrong], single: bool = False) -> tuple[list[str], list[int], list[bool], list[str]]:
    """Kinds, offsets, the words of names and keywords, and whether a line break stands before each token. Templates: 'T' whole, 'T<' 'T-' 'T>' around their expressions. single: '>>' comes as two of '>', which may close type arguments."""
    kinds: list[str] = []
    starts: list[int] = []
    breaks: list[bool] = []
    words: list[str] = []
    templates: list[int] = []
    #: For each open parenthesis, and for the one closed last, whether it holds the condition of a statement: a slash after it begins a regular expression.
    heads: list[bool] = []
    head = False
    depth, at, n, nl = 0, 0, len(text), False
    match = JS_TOKEN.match
    if text.startswith("#!"):
        at = re.compile(r"[^\r\n]*").match(text).end()

    def put(kind: str, start: int, word: str = "") -> None:
        nonlocal nl
        kinds.append(kind), starts.append(start), breaks.append(nl), words.append(word)
        nl = False

    def template(start: int, first: bool) -> int:
        end = TEMPLATE.match(text, start).end()
        if text.startswith("`", end):
            put("T" if first else "T>", start)
            return end + 1
        if text.startswith("${", end):
            put("T<" if first else "T-", start)
            templates.append(depth)
            return end + 2
        errors.append(Wrong(start, "unterminated template"))
        put("T" if first else "T>", start)
        return n

    while at < n:
        m = match(text, at)
        if not m:
            if text[at].isspace():
                at += 1
                continue
            errors.append(Wrong(at, f"invalid character {text[at]!r}"))
            at += 1
            continue
        kind, start = m.lastgroup, at
        at = m.end()
        if kind == "skip" or kind == "line":
            continue
        if kind == "nl":
            nl = True
        elif kind == "block":
            end = text.find("*/", at)
            if end < 0:
                errors.append(Wrong(start, "unterminated comment"))
                end = n
            nl = nl or "\n" in text[start:end]
            at = end + 2
        elif kind == "name":
            word = m.group()
            put(word if word in JS_WORDS and (not kinds or kinds[-1] not in (".", "?.")) else "N", start, word)
        elif kind == "private":
            put("#", start)
        elif kind == "num":
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                errors.append(Wrong(start, "invalid number"))
                at = re.compile(r"[\w$]+").match(text, at).end()
            put("0", start)
        elif kind == "str":
            put("S", start)
        elif kind == "badstr":
            errors.append(Wrong(start, "unterminated string"))
            at = re.compile(r"[^\r\n]*").match(text, at).end()
            put("S", start)
        elif kind == "tpl":
            at = template(at, True)
        else:
            c = m.group()
            if c == "(":
                heads.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with"))
            elif c == ")" and heads:
                head = heads.pop()
            if c[0] == "/" and (not kinds or kinds[-1] not in VALUE or kinds[-1] == ")" and head):
                r = REGEX.match(text, start)
                if r:
                    at = r.end()
                    if re.search(r"[^dgimsuvy]|(.).*\1", r.group("flags")):
                        errors.append(Wrong(start, "invalid flags of a regular expression"))
                    put("R", start)
                    continue
            if c == "{":
                depth += 1
            elif c == "}":
                if templates and templates[-1] == depth:
                    templates.pop()
                    at = template(at, False)
                    continue
                depth -= 1
            if single and c in (">>", ">>>"):
                for k in range(len(c)):
                    put(">", start + k)
            else:
                put(c, start)
    if templates:
        errors.append(Wrong(n, "unterminated template"))
    for _ in range(LOOK):
        put("", n)
    return kinds, starts, breaks, words


JAVA_TOKEN = re.compile(
    _SPACE + r"|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<num>0[xX](?:[\da-fA-F_]*\.?[\da-fA-F_]*)(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)"
    r"|(?P<text>\"{3}[ \t\f]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"{3})|(?P<str>\"(?:[^\"\\\r\n]|\\[^\r\n])*\")|(?P<char>'(?:[^'\\\r\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[^\r\n]))'|'[\ud800-\udbff\U00010000-\U0010ffff]')|(?P<badstr>[\"'])"
    r"|(?P<op>\.\.\.|>>>=|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@])"
)
GO_TOKEN = re.compile(
    _SPACE + r"|(?P<name>[^\W\d]\w*)|(?P<num>(?:0[xX](?:_?[\da-fA-F])*\.?(?:[\da-fA-F](?:_?[\da-fA-F])*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?)"
    r"|(?P<raw>`[^`]*`)|(?P<str>\"(?:[^\"\\\r\n]|\\[^\r\n])*\")|(?P<char>'(?:[^'\\\r\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[abfnrtv\\']))')|(?P<badstr>[\"'`])"
    r"|(?P<op>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!<>=:;,.(){}\[\]~])"
)
GO_ENDS = frozenset(["N", "0", "S", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def lex_simple(text: str, errors: list[Wrong], token: re.Pattern, words: frozenset[str], semicolons: bool) -> tuple[list[str], list[int]]:
    """Kinds and offsets of Java or Go. semicolons: a line break after a token that may end a statement gives ';' (Go)."""
    kinds: list[str] = []
    starts: list[int] = []
    at, n = 0, len(text)
    match = token.match

    def end_line(where: int) -> None:
        if semicolons and kinds and kinds[-1] in GO_ENDS:
            kinds.append(";"), starts.append(where)

    while at < n:
        m = match(text, at)
        if not m:
            if not text[at].isspace():
                errors.append(Wrong(at, f"invalid character {text[at]!r}"))
            at += 1
            continue
        kind, start = m.lastgroup, at
        at = m.end()
        if kind == "skip" or kind == "line":
            continue
        if kind == "nl":
            end_line(start)
        elif kind == "block":
            end = text.find("*/", at)
            if end < 0:
                errors.append(Wrong(start, "unterminated comment"))
                end = n
            if "\n" in text[start:end]:
                end_line(start)
            at = end + 2
        elif kind == "name":
            word = m.group()
            kinds.append(word if word in words else "N"), starts.append(start)
        elif kind == "num":
            word = m.group()
            if at < n and (text[at].isalnum() or text[at] == "_") or word.endswith("_") or re.fullmatch(r"0[xXbBoO]\.?", word):
                errors.append(Wrong(start, "invalid number"))
                at = re.compile(r"\w*").match(text, at).end()
            elif word.isdigit() and word[0] == "0" and ("8" in word or "9" in word):
                errors.append(Wrong(start, "invalid octal number"))
            kinds.append("0"), starts.append(start)
        elif kind == "badstr":
            errors.append(Wrong(start, "unterminated string"))
            at = re.compile(r"[^\r\n]*").match(text, at).end()
            kinds.append("S"), starts.append(start)
        elif kind == "op":
            kinds.append(m.group()), starts.append(start)
        else:
            kinds.append("S" if kind != "char" or not semicolons else "0"), starts.append(start)
    end_line(n)
    kinds += [""] * LOOK
    starts += [n] * LOOK
    return kinds, starts
