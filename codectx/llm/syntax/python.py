"""Python 3.13: an indentation-aware lexer and a recursive-descent parser with precedence climbing for expressions."""

from __future__ import annotations

import re
from keyword import kwlist

from codectx.llm.syntax.core import LOOK, Parser, Wrong

KEYWORDS = frozenset(kwlist)
#: Open brackets and indentations (with the one of no columns) that Python itself allows. Fixed values.
MOST_BRACKETS, MOST_INDENTS = 200, 100
NEWLINE, INDENT, DEDENT = "newline", "indent", "dedent"
#: Everything but strings that need their end looked for, and line starts.
TOKEN = re.compile(
    r"(?P<skip>[ \t\f]+|\\\r?\n)|(?P<name>[^\W\d]\w*)|(?P<num>0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:;.=])|(?P<nl>\r?\n|\r)|(?P<comment>#[^\r\n]*)|(?P<quote>\"{3}|'{3}|\"|')"
)
PREFIXES = frozenset("r u b f br rb fr rf".split())
TRIPLE = {q: re.compile(r"(?:[^\\" + q[0] + r"]|\\[\s\S]|" + q[0] + r"(?!" + q[0] * 2 + r"))*" + q) for q in ('"""', "'''")}
SINGLE = {q: re.compile(r"(?:[^\\\r\n" + q + r"]|\\(?:\r\n|[\s\S]))*" + q) for q in "\"'"}
PAIRS = {"(": ")", "[": "]", "{": "}"}
CLOSERS = frozenset(PAIRS.values())


def _field_end(text: str, at: int, quote: str, errors: list[Wrong]) -> tuple[int, int]:
    """(end of the expression, position of what follows it) of a replacement field whose '{' stands before ``at``."""
    stack: list[str] = []
    k = at
    while k < len(text):
        c = text[k]
        if c in "\"'":
            if c * 3 == text[k : k + 3]:
                q = c * 3
            elif not stack and len(quote) == 1 and c == quote:
                q = c
            else:
                q = c
            lead = re.search(r"(?i)(?<!\w)([rbuf]{1,2})$", text[max(at, k - 2) : k])
            if lead and "f" in lead.group().lower():
                k = _fstring(text, k + len(q), q, errors)
            else:
                m = (TRIPLE if len(q) == 3 else SINGLE)[q].match(text, k + len(q))
                if not m:
                    raise Wrong(k, "unterminated string in a replacement field")
                k = m.end()
            continue
        if c in "([{":
            stack.append(PAIRS[c])
        elif stack and c in ")]}":
            if stack.pop() != c:
                raise Wrong(k, f"unmatched {c!r}")
        elif not stack and (c == "}" or c == ":" or c == "!" and text[k + 1 : k + 2] != "=" or c == "=" and text[k + 1 : k + 2] != "=" and text[k - 1] not in "=!<>:" and re.match(r"=\s*[}!:]", text[k : k + 40])):
            return k, k
        elif c in "\r\n" and len(quote) == 1 and not stack and False:
            break
        elif c == "#":
            while k < len(text) and text[k] not in "\r\n":
                k += 1
            continue
        k += 1
    raise Wrong(at - 1, "'{' was never closed in an f-string")


def _fstring(text: str, at: int, quote: str, errors: list[Wrong], spec: bool = False, raw: bool = False) -> int:
    """The offset behind an f-string's end; the expressions in its fields are parsed on the way. spec: a format spec, which ends before '}'."""
    k = at
    while k < len(text):
        c = text[k]
        if c == "\\" and not (raw and text[k + 1 : k + 2] in "{}"):
            k += 2
        elif text.startswith(quote, k):
            if spec:
                raise Wrong(k, "'}' is missing in an f-string")
            return k + len(quote)
        elif c in "\r\n" and len(quote) == 1:
            raise Wrong(at, "unterminated f-string")
        elif c == "{":
            if text[k + 1 : k + 2] == "{" and not spec:
                k += 2
                continue
            end, k2 = _field_end(text, k + 1, quote, errors)
            inner = text[k + 1 : end]
            if not inner.strip():
                raise Wrong(k, "empty expression in an f-string")
            parse_expression(inner, k + 1, errors)
            k = k2
            if text[k] == "=":
                k = re.compile(r"=\s*").match(text, k).end()
            if text[k : k + 1] == "!":
                m = re.compile(r"!\s*[rsa]\s*").match(text, k)
                if not m:
                    raise Wrong(k, "bad conversion in an f-string")
                k = m.end()
            if text[k : k + 1] == ":":
                k = _fstring(text, k + 1, quote, errors, True, raw)
            if text[k : k + 1] != "}":
                raise Wrong(k, "'}' is missing in an f-string")
            k += 1
        elif c == "}":
            if spec:
                return k
            if text[k + 1 : k + 2] != "}":
                raise Wrong(k, "single '}' in an f-string")
            k += 2
        else:
            k += 1
    raise Wrong(at, "unterminated f-string")


def lex(text: str, errors: list[Wrong], shift: int = 0, inside: bool = False) -> tuple[list[str], list[int]]:
    """Token kinds and their offsets; what can't be lexed goes to ``errors``. inside: as if within brackets (no line structure)."""
    kinds: list[str] = []
    starts: list[int] = []
    stack: list[str] = ["("] if inside else []
    base = len(stack)
    indents, alt = [0], [0]
    match = TOKEN.match
    at, n, fresh = 0, len(text), not inside
    if text.startswith("﻿"):
        at = 1
    bytes_last = None
    while at < n:
        if fresh:
            m = re.compile(r"[ \t\f]*").match(text, at)
            lead, at = m.group(), m.end()
            if at >= n:
                break
            if text[at] in "#\r\n" or text.startswith(("\\\n", "\\\r\n"), at):
                fresh = text[at] != "\\"
                if text[at] == "#":
                    e = re.compile(r"[^\r\n]*").match(text, at).end()
                    at = e
                if at < n and text[at] in "\r\n":
                    at += 2 if text.startswith("\r\n", at) else 1
                continue
            fresh = False
            lead = lead.rpartition("\f")[2]
            if "\t" in lead:
                col = a = 0
                for c in lead:
                    col, a = (col // 8 * 8 + 8, a + 1) if c == "\t" else (col + 1, a + 1)
            else:
                col = a = len(lead)
            if col > indents[-1]:
                if a <= alt[-1]:
                    errors.append(Wrong(shift + at, "inconsistent tabs and spaces"))
                indents.append(col), alt.append(a)
                if len(indents) == MOST_INDENTS + 1:
                    errors.append(Wrong(shift + at, "too many levels of indentation"))
                kinds.append(INDENT), starts.append(shift + at)
            else:
                while col < indents[-1]:
                    indents.pop(), alt.pop()
                    kinds.append(DEDENT), starts.append(shift + at)
                if col != indents[-1]:
                    errors.append(Wrong(shift + at, "unindent matches no outer level"))
                elif a != alt[-1]:
                    errors.append(Wrong(shift + at, "inconsistent tabs and spaces"))
        m = match(text, at)
        if not m:
            c = text[at]
            errors.append(Wrong(shift + at, f"invalid character {c!r}"))
            at += 1
            continue
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "skip":
            if text[start] == "\\" and at >= n:
                errors.append(Wrong(shift + start, "unexpected end of text after a backslash"))
            continue
        if kind == "name":
            word = m.group()
            if at < n and text[at] in "\"'" and word.lower() in PREFIXES:
                kind, q = "quote", text[at]
                q = q * 3 if text.startswith(q * 3, at) else q
                at += len(q)
                low = word.lower()
                if "f" in low:
                    try:
                        at = _fstring(text, at, q, errors, raw="r" in low)
                    except Wrong as w:
                        errors.append(Wrong(shift + w.at, w.why))
                        at = n if len(q) == 3 else re.compile(r"[^\r\n]*").match(text, at).end()
                else:
                    m2 = (TRIPLE if len(q) == 3 else SINGLE)[q].match(text, at)
                    if m2:
                        if "b" in low and not m2.group().isascii():
                            errors.append(Wrong(shift + start, "bytes hold only ASCII"))
                        at = m2.end()
                    else:
                        errors.append(Wrong(shift + start, "unterminated string"))
                        at = n if len(q) == 3 else re.compile(r"[^\r\n]*").match(text, at).end()
                is_bytes = "b" in low
                if kinds and kinds[-1] == "S" and bytes_last is not None and bytes_last != is_bytes:
                    errors.append(Wrong(shift + start, "bytes and text side by side"))
                bytes_last = is_bytes
                kinds.append("S"), starts.append(shift + start)
                continue
            if not word.isascii() and not word.isidentifier():
                errors.append(Wrong(shift + start, "invalid name"))
            kinds.append(word if word in KEYWORDS else "N"), starts.append(shift + start)
            bytes_last = None
        elif kind == "op":
            c = m.group()
            if c in PAIRS:
                if len(stack) == MOST_BRACKETS:
                    errors.append(Wrong(shift + m.start(), "too many nested parentheses"))
                stack.append(c)
            elif c in CLOSERS:
                if len(stack) > base and PAIRS[stack[-1]] == c:
                    stack.pop()
                else:
                    errors.append(Wrong(shift + start, f"unmatched {c!r}"))
                    if len(stack) > base and c in (PAIRS[x] for x in stack):
                        while PAIRS[stack.pop()] != c:
                            pass
            kinds.append(c), starts.append(shift + start)
        elif kind == "nl":
            if not stack:
                kinds.append(NEWLINE), starts.append(shift + start)
                fresh = True
        elif kind == "num":
            word = m.group()
            if at < n and (text[at] == "_" or text[at].isalnum()):
                tail = re.compile(r"\w+").match(text, at).group()
                if not re.match(r"(?:and|or|in|is|if|else|for|not)\b", tail):
                    errors.append(Wrong(shift + start, "invalid number"))
                    at += len(tail)
            elif len(word) > 1 and word[0] == "0" and word.replace("_", "").isdigit() and word.strip("0_"):
                errors.append(Wrong(shift + start, "leading zeros"))
            kinds.append("0"), starts.append(shift + start)
        elif kind == "quote":
            q = m.group()
            m2 = (TRIPLE if len(q) == 3 else SINGLE)[q].match(text, at)
            if m2:
                at = m2.end()
            else:
                errors.append(Wrong(shift + start, "unterminated string"))
                at = n if len(q) == 3 else re.compile(r"[^\r\n]*").match(text, at).end()
            if kinds and kinds[-1] == "S" and bytes_last:
                errors.append(Wrong(shift + start, "bytes and text side by side"))
            bytes_last = False
            kinds.append("S"), starts.append(shift + start)
    if len(stack) > base:
        errors.append(Wrong(shift + n, f"{stack[-1]!r} was never closed"))
    if not inside:
        if kinds and kinds[-1] not in (NEWLINE, DEDENT):
            kinds.append(NEWLINE), starts.append(shift + n)
        for _ in indents[1:]:
            kinds.append(DEDENT), starts.append(shift + n)
    kinds += [""] * LOOK
    starts += [shift + n] * LOOK
    return kinds, starts


BINARY = {"or": 1, "and": 2, "in": 4, "is": 4, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
#: Kinds that may begin an expression.
BEGIN = frozenset("N 0 S ( [ { ... - + ~ not lambda await None True False *".split())
TARGETS = frozenset("nast")


class Python(Parser):
    """Expressions return what they are: 'n' name, 'a' attribute, 's' subscript, 't' a tuple or list of targets, '*' starred, 'g' parenthesised yield or the like, 'x' anything else."""

    def __init__(self, text: str, kinds: list[str], starts: list[int], errors: list[Wrong]):
        super().__init__(kinds, starts, errors)
        self.text = text

    # expressions

    def named(self) -> str:
        kind = self.expression()
        if self.k[self.i] == ":=":
            if kind != "n":
                self.fail("only a name can be bound by :=")
            self.i += 1
            self.expression()
            return "x"
        return kind

    def expression(self) -> str:
        k = self.k[self.i]
        if k == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "x"
        kind = self.binary(1)
        if self.k[self.i] == "if":
            self.i += 1
            self.binary(1)
            self.need("else")
            self.expression()
            return "x"
        return kind

    def binary(self, least: int) -> str:
        k = self.k
        if k[self.i] == "not" and least <= 3:
            self.i += 1
            self.binary(3)
            kind = "x"
        else:
            kind = self.unary()
        while True:
            op = k[self.i]
            if op == "not" and k[self.i + 1] == "in" and least <= 4:
                self.i += 2
                self.binary(5)
                kind = "x"
                continue
            level = BINARY.get(op, 0)
            if level < least or not level:
                return kind
            self.i += 1
            if op == "is" and k[self.i] == "not":
                self.i += 1
            if k[self.i] == "not" and level >= 4:
                self.fail()
            self.binary(level + 1)
            kind = "x"

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("-", "+", "~"):
            self.i += 1
            self.unary()
            return "x"
        if k == "await":
            self.i += 1
            self.primary()
            kind = "x"
        else:
            kind = self.primary()
        if self.k[self.i] == "**":
            self.i += 1
            self.unary()
            return "x"
        return kind

    def primary(self) -> str:
        k = self.k
        a = k[self.i]
        if a == "N":
            self.i += 1
            kind = "n"
        elif a in ("0", "...", "None", "True", "False"):
            self.i += 1
            kind = "x"
        elif a == "S":
            self.i += 1
            while k[self.i] == "S":
                self.i += 1
            kind = "x"
        elif a == "(":
            kind = self.group()
        elif a == "[":
            kind = self.display("]")
        elif a == "{":
            self.braces()
            kind = "x"
        else:
            self.fail()
        while True:
            a = k[self.i]
            if a == ".":
                self.i += 1
                self.need("N")
                kind = "a"
            elif a == "(":
                self.arguments()
                kind = "x"
            elif a == "[":
                self.i += 1
                self.slices()
                self.need("]")
                kind = "s"
            else:
                return kind

    def group(self) -> str:
        self.i += 1
        if self.take(")"):
            return "t"
        if self.k[self.i] == "yield":
            self.yielded()
            self.need(")")
            return "g"
        first = self.starred()
        if self.k[self.i] in ("for", "async"):
            if first == "*":
                self.fail("a starred expression can't be comprehended")
            self.comprehension()
            self.need(")")
            return "g"
        if self.take(")"):
            if first == "*":
                self.fail("a starred expression can't stand alone")
            return first if first in TARGETS else "x"
        ok = first in TARGETS or first == "*"
        while self.take(","):
            if self.k[self.i] == ")":
                break
            kind = self.starred()
            ok = ok and (kind in TARGETS or kind == "*")
        self.need(")")
        return "t" if ok else "x"

    def starred(self) -> str:
        if self.k[self.i] == "*":
            self.i += 1
            self.binary(5)
            return "*"
        return self.named()

    def display(self, close: str) -> str:
        self.i += 1
        ok = True
        if self.take(close):
            return "t"
        first = self.starred()
        if self.k[self.i] in ("for", "async"):
            if first == "*":
                self.fail("a starred expression can't be comprehended")
            self.comprehension()
            self.need(close)
            return "x"
        ok = first in TARGETS or first == "*"
        while self.take(","):
            if self.k[self.i] == close:
                break
            kind = self.starred()
            ok = ok and (kind in TARGETS or kind == "*")
        self.need(close)
        return "t" if ok else "x"

    def braces(self) -> None:
        self.i += 1
        if self.take("}"):
            return
        pairs = None
        while True:
            if self.k[self.i] == "**":
                if pairs is False:
                    self.fail()
                pairs = True
                self.i += 1
                self.binary(5)
            else:
                star = self.k[self.i] == "*"
                self.starred()
                if self.k[self.i] == ":" and not star and pairs is not False:
                    pairs = True
                    self.i += 1
                    self.expression()
                elif pairs:
                    self.fail("expected ':'")
                else:
                    pairs = False
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    break
            if not self.take(",") or self.k[self.i] == "}":
                break
        self.need("}")

    def comprehension(self) -> None:
        while self.k[self.i] in ("for", "async"):
            if self.take("async") and self.k[self.i] != "for":
                self.fail()
            self.i += 1
            self.targets("in")
            self.need("in")
            self.binary(1)
            if self.k[self.i] == "if":
                pass
            while self.take("if"):
                kind = self.k[self.i]
                if kind == "lambda":
                    self.expression()
                else:
                    self.binary(1)
                    if self.take(":="):
                        self.expression()

    def targets(self, stop: str) -> None:
        while True:
            star = self.take("*")
            kind = self.binary(5) if self.k[self.i] != stop else self.fail()
            if kind not in TARGETS and not star:
                self.fail("no target of an assignment")
            if not self.take(",") or self.k[self.i] == stop:
                return

    def arguments(self) -> None:
        k = self.k
        self.i += 1
        named = unpacked = False
        while k[self.i] != ")":
            a = k[self.i]
            if a == "**":
                self.i += 1
                self.expression()
                unpacked = True
            elif a == "*":
                if unpacked:
                    self.fail("* after **")
                self.i += 1
                self.expression()
            elif a == "N" and k[self.i + 1] == "=":
                self.i += 2
                self.expression()
                named = True
            else:
                at = self.i
                self.named()
                if k[self.i] in ("for", "async"):
                    self.comprehension()
                    if k[self.i] == "," and k[self.i + 1] != ")" or k[at - 1] != "(":
                        self.fail("a generator needs its own parentheses")
                elif k[self.i] == "=":
                    self.fail("no name of an argument")
                elif named or unpacked:
                    raise Wrong(self.at[at], "positional argument follows a named one")
            if k[self.i] == ",":
                self.i += 1
            elif k[self.i] != ")":
                self.fail("expected ',' or ')'")
        self.i += 1

    def slices(self) -> None:
        while True:
            if self.k[self.i] == "*":
                self.i += 1
                self.binary(5)
            else:
                if self.k[self.i] != ":":
                    self.named()
                if self.take(":"):
                    if self.k[self.i] not in (":", "]", ","):
                        self.expression()
                    if self.take(":") and self.k[self.i] not in ("]", ","):
                        self.expression()
            if not self.take(",") or self.k[self.i] == "]":
                return

    def yielded(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif self.k[self.i] in BEGIN:
            self.expressions()

    def expressions(self) -> str:
        """One or more starred expressions with commas between."""
        first = self.starred_only()
        if self.k[self.i] != ",":
            return first
        ok = first in TARGETS or first == "*"
        while self.take(","):
            if self.k[self.i] not in BEGIN:
                break
            kind = self.starred_only()
            ok = ok and (kind in TARGETS or kind == "*")
        return "t" if ok else "x"

    def starred_only(self) -> str:
        if self.k[self.i] == "*":
            self.i += 1
            self.binary(5)
            return "*"
        return self.expression()

    def parameters(self, stop: str, typed: bool) -> None:
        default = star = done = slash = False
        while self.k[self.i] != stop:
            if done:
                self.fail("nothing may follow **")
            if self.take("**"):
                self.need("N")
                done = True
                if typed and self.take(":"):
                    self.expression()
            elif self.k[self.i] == "*":
                if star:
                    self.fail("a second *")
                star = True
                self.i += 1
                if self.take("N"):
                    if typed and self.take(":"):
                        self.starred_only()
                elif self.k[self.i] != "," or self.k[self.i + 1] in (stop, "**"):
                    self.fail("a name must follow *")
            elif self.k[self.i] == "/":
                if slash or star or self.k[self.i - 1] != ",":
                    self.fail()
                slash = True
                self.i += 1
            else:
                self.need("N")
                if typed and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a parameter without default follows one with")
            if self.k[self.i] != stop:
                self.need(",")

    # statements

    def block(self) -> None:
        self.need(":")
        if self.k[self.i] != NEWLINE:
            self.simple_line()
            return
        self.i += 1
        if self.k[self.i] != INDENT:
            self.fail("expected an indented block")
        self.i += 1
        while self.k[self.i] not in (DEDENT, ""):
            self.guarded()
        self.take(DEDENT)

    def guarded(self) -> None:
        """A statement; after an error in it, panic mode goes on behind its last line."""
        start = self.i
        try:
            self.statement()
        except Wrong as w:
            self.errors.append(w)
            self.recover(start)
        except RecursionError:
            self.errors.append(Wrong(self.at[self.i], "nested too deeply"))
            self.recover(start)

    def recover(self, start: int) -> None:
        self.i = max(self.i, start)
        while self.k[self.i] not in (NEWLINE, ""):
            self.i += 1
        self.take(NEWLINE)
        if self.k[self.i] == INDENT:  # the block of the broken statement is parsed as statements of its own
            self.i += 1
            while self.k[self.i] not in (DEDENT, ""):
                self.guarded()
            self.take(DEDENT)

    def file(self) -> None:
        while self.k[self.i]:
            if self.k[self.i] in (INDENT, DEDENT):
                if self.k[self.i] == INDENT:
                    self.errors.append(Wrong(self.at[self.i], "unexpected indent"))
                self.i += 1
            elif self.k[self.i] == NEWLINE:
                self.i += 1
            else:
                self.guarded()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.k[self.i] == NEWLINE:
                break
        if self.k[self.i] != NEWLINE:
            self.fail()
        self.i += 1
        if self.k[self.i] == INDENT:
            self.fail("unexpected indent")

    def statement(self) -> None:
        k = self.k[self.i]
        method = COMPOUND.get(k)
        if method:
            method(self)
        elif k == "N" and self.k[self.i + 1] not in ("=", "(", ".") and self.soft():
            pass
        elif k == "N" and self.k[self.i + 1] == "(" and self.text.startswith("match", self.at[self.i]) and self.soft():
            pass
        elif k == INDENT:
            self.i += 1
            self.errors.append(Wrong(self.at[self.i], "unexpected indent"))
            while self.k[self.i] not in (DEDENT, ""):
                self.guarded()
            self.take(DEDENT)
        else:
            self.simple_line()

    def word(self, i: int, word: str) -> bool:
        at = self.at[i]
        return self.k[i] == "N" and self.text.startswith(word, at) and not self.text[at + len(word) : at + len(word) + 1].isidentifier() and not self.text[at + len(word) : at + len(word) + 1].isdigit()

    def soft(self) -> bool:
        """A match or type statement, if it is one; those words may also be names."""
        start, known = self.i, len(self.errors)
        if self.word(start, "match") and self.k[start + 1] in BEGIN:
            try:
                self.i += 1
                self.starred()
                while self.take(","):
                    if self.k[self.i] == ":":
                        break
                    self.starred()
                self.need(":")
                self.need(NEWLINE)
                self.need(INDENT)
                if not self.word(self.i, "case"):
                    self.fail()
            except Wrong:
                self.i = start
                return False
            while self.word(self.i, "case"):
                self.i += 1
                self.pattern()
                while self.take(","):
                    if self.k[self.i] in (":", "if"):
                        break
                    self.pattern()
                if self.take("if"):
                    self.named()
                self.block()
            self.need(DEDENT)
            return True
        if self.word(start, "type") and self.k[start + 1] == "N":
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
            self.need(NEWLINE)
            return True
        del self.errors[known:]
        return False

    def pattern(self) -> None:
        while True:
            if self.take("*"):
                self.need("N")
            elif self.k[self.i] in ("(", "["):
                close = ")" if self.k[self.i] == "(" else "]"
                self.i += 1
                while self.k[self.i] != close:
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(close)
            elif self.take("{"):
                while self.k[self.i] != "}":
                    if self.take("**"):
                        self.need("N")
                    else:
                        self.unary()
                        self.need(":")
                        self.pattern()
                    if not self.take(","):
                        break
                self.need("}")
            elif self.k[self.i] == "N":
                self.i += 1
                while self.take("."):
                    self.need("N")
                if self.take("("):
                    while self.k[self.i] != ")":
                        if self.k[self.i] == "N" and self.k[self.i + 1] == "=":
                            self.i += 2
                        self.pattern()
                        if not self.take(","):
                            break
                    self.need(")")
            else:
                self.binary(9)
            if self.take("as"):
                self.need("N")
            if not self.take("|"):
                return

    def type_parameters(self) -> None:
        if self.take("["):
            while self.k[self.i] != "]":
                if self.k[self.i] in ("*", "**"):
                    self.i += 1
                self.need("N")
                if self.take(":"):
                    self.expression()
                if self.take("="):
                    self.starred_only()
                if not self.take(","):
                    break
            self.need("]")

    def simple(self) -> None:
        k = self.k[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (NEWLINE, ";"):
                self.expressions()
        elif k == "raise":
            self.i += 1
            if self.k[self.i] not in (NEWLINE, ";"):
                self.expression()
                if self.take("from"):
                    self.expression()
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.need("N")
            while self.take(","):
                self.need("N")
        elif k == "del":
            self.i += 1
            while True:
                if self.binary(5) not in TARGETS:
                    self.fail("can't be deleted")
                if not self.take(",") or self.k[self.i] in (NEWLINE, ";"):
                    break
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.need("N")
                if not self.take(","):
                    break
        elif k == "from":
            self.i += 1
            dots = False
            while self.k[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if not dots or self.k[self.i] == "N":
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            bracket = self.take("(")
            while True:
                self.need("N")
                if self.take("as"):
                    self.need("N")
                if not self.take(",") or bracket and self.k[self.i] == ")":
                    break
            if bracket:
                self.need(")")
        elif k == "yield":
            self.yielded()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.need("N")
        while self.take("."):
            self.need("N")

    def assignment(self) -> None:
        start = self.i
        kind = self.expressions()
        k = self.k[self.i]
        if k == "=":
            while self.take("="):
                if kind not in TARGETS:
                    raise Wrong(self.at[start], "no target of an assignment")
                start = self.i
                if self.k[self.i] == "yield":
                    self.yielded()
                    kind = "x"
                else:
                    kind = self.expressions()
        elif k in AUGMENTED:
            if kind not in ("n", "a", "s"):
                raise Wrong(self.at[start], "no target of an augmented assignment")
            self.i += 1
            if self.k[self.i] == "yield":
                self.yielded()
            else:
                self.expressions()
        elif k == ":":
            if kind not in ("n", "a", "s"):
                raise Wrong(self.at[start], "no target of an annotation")
            self.i += 1
            self.expression()
            if self.take("="):
                if self.k[self.i] == "yield":
                    self.yielded()
                else:
                    self.expressions()

    def if_statement(self) -> None:
        self.i += 1
        self.named()
        self.block()
        while self.take("elif"):
            self.named()
            self.block()
        if self.take("else"):
            self.block()

    def while_statement(self) -> None:
        self.i += 1
        self.named()
        self.block()
        if self.take("else"):
            self.block()

    def for_statement(self) -> None:
        self.i += 1
        self.targets("in")
        self.need("in")
        self.expressions()
        self.block()
        if self.take("else"):
            self.block()

    def try_statement(self) -> None:
        self.i += 1
        self.block()
        handled = last = False
        while self.take("except"):
            if last:
                self.fail("a bare except must be last")
            handled = True
            self.take("*")
            if self.k[self.i] != ":":
                self.expression()
                if self.take("as"):
                    self.need("N")
            else:
                last = True
            self.block()
        if handled and self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()
        elif not handled:
            self.fail("expected 'except' or 'finally'")

    def with_statement(self) -> None:
        self.i += 1
        start = self.i
        if self.k[self.i] == "(":
            try:
                self.i += 1
                while self.k[self.i] != ")":
                    self.named()
                    if self.take("as"):
                        self.starred_only()
                    if not self.take(","):
                        break
                self.need(")")
                if self.k[self.i] != ":":
                    self.fail()
                self.block()
                return
            except Wrong:
                if self.k[self.i] == NEWLINE or self.i > start + 1 and INDENT in self.k[start : self.i]:
                    raise
                self.i = start
        while True:
            self.expression()
            if self.take("as"):
                if self.starred_only() not in TARGETS:
                    self.fail("no target of an assignment")
            if not self.take(","):
                break
        self.block()

    def def_statement(self) -> None:
        self.i += 1
        self.need("N")
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expressions()
        self.block()

    def class_statement(self) -> None:
        self.i += 1
        self.need("N")
        self.type_parameters()
        if self.k[self.i] == "(":
            self.arguments()
        self.block()

    def decorated(self) -> None:
        while self.take("@"):
            self.named()
            self.need(NEWLINE)
        if self.k[self.i] not in ("def", "class", "async"):
            self.fail("a definition must follow a decorator")
        self.statement()

    def async_statement(self) -> None:
        self.i += 1
        if self.k[self.i] not in ("def", "with", "for"):
            self.fail()
        self.statement()


COMPOUND = {
    "if": Python.if_statement, "while": Python.while_statement, "for": Python.for_statement, "try": Python.try_statement, "with": Python.with_statement,
    "def": Python.def_statement, "class": Python.class_statement, "@": Python.decorated, "async": Python.async_statement,
}


def parse_expression(text: str, shift: int, errors: list[Wrong]) -> None:
    """An expression of an f-string's field, whose first character is the ``shift``-th of its text."""
    kinds, starts = lex(text, errors, shift, True)
    p = Python(" " * shift + text if shift < 1 << 16 else text, kinds, starts, errors)
    try:
        if p.k[0] == "yield":
            p.yielded()
        else:
            p.starred()
            while p.take(","):
                if not p.k[p.i]:
                    break
                p.starred()
        if p.k[p.i]:
            p.fail()
    except Wrong as w:
        errors.append(w)


def parse(text: str) -> list[Wrong]:
    """All errors in the order of their place; [] if the text is valid.

    >>> parse("x = 1\\n"), len(parse("x = (1\\n"))
    ([], 1)
    """
    errors: list[Wrong] = []
    if "\0" in text:
        errors.append(Wrong(text.index("\0"), "null character"))
        text = text.replace("\0", " ")
    kinds, starts = lex(text, errors)
    if not errors or errors[-1].why != "nested too deeply":
        Python(text, kinds, starts, errors).file()
    return sorted(errors, key=lambda w: w.at)
