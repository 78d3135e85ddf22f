"""JavaScript and TypeScript: recursive-descent statements, precedence climbing for expressions, types where they may stand."""

from __future__ import annotations

from codectx.llm.syntax.braces import JS_WORDS, lex_js
from codectx.llm.syntax.core import Parser, Wrong

BINARY = {
    "??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7,
    "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset(["!", "~", "+", "-", "++", "--", "typeof", "void", "delete"])
OPEN = {"(": ")", "[": "]", "{": "}"}
STOP = frozenset([";", "}"])
NAMES = JS_WORDS | {"N"}
MODIFIERS = frozenset("public private protected readonly static override abstract declare accessor async export".split())


class Script(Parser):
    """Expressions return 'n' a name, 'a' a member, 'p' an array or object that may be a pattern, 'x' anything else."""

    def __init__(self, text: str, ts: bool):
        self.ts = ts
        errors: list[Wrong] = []
        kinds, starts, self.nl, self.words = lex_js(text, errors, ts)
        super().__init__(kinds, starts, errors)
        self.no_in = False
        self.in_type = 0
        self.match: dict[int, int] = {}
        stack: list[int] = []
        closing = {"}": "{", ")": "(", "]": "["}
        for i, k in enumerate(kinds):
            if k in OPEN:
                stack.append(i)
            elif k in closing:
                if stack and kinds[stack[-1]] == closing[k]:
                    self.match[stack.pop()] = i

    def is_word(self, word: str, ahead: int = 0) -> bool:
        i = self.i + ahead
        return self.k[i] == "N" and self.words[i] == word

    def name(self) -> None:
        """A binding's name."""
        if self.k[self.i] == "enum" or self.k[self.i] != "N":
            self.fail(f"expected a name, found {self.k[self.i] or 'end of text'!r}")
        self.i += 1

    def semicolon(self) -> None:
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k and k != "}" and not self.nl[self.i]:
            self.fail()

    # expressions

    def expression(self) -> str:
        kind = self.assignment()
        while self.take(","):
            self.assignment()
            kind = "x"
        return kind

    def plain(self) -> None:
        """An assignment expression in which 'in' is an operator again."""
        was, self.no_in = self.no_in, False
        self.assignment()
        self.no_in = was

    def assignment(self) -> str:
        k = self.k
        a = k[self.i]
        if a == "N":
            word = self.words[self.i]
            if k[self.i + 1] == "=>" and not self.nl[self.i + 1]:
                self.i += 2
                self.arrow_body()
                return "x"
            if word == "async" and not self.nl[self.i + 1]:
                if k[self.i + 1] == "N" and k[self.i + 2] == "=>":
                    self.i += 3
                    self.arrow_body()
                    return "x"
                if k[self.i + 1] in ("(", "<") and self.arrow(self.i + 1):
                    return "x"
            if word == "yield" and (k[self.i + 1] in ("N", "0", "S", "T", "T<", "R", "(", "[", "{", "new", "this", "function", "class", "null", "true", "false", "typeof", "!", "*", "-", "+", "super", "void", "delete", ";", ")", "}", "]", ",", "", ":") or self.nl[self.i + 1]):
                self.i += 1
                if not self.nl[self.i] and k[self.i] not in (")", "]", "}", ",", ";", "", ":", "in"):
                    self.take("*")
                    self.assignment()
                return "x"
        elif a in ("(", "<") and self.arrow(self.i):
            return "x"
        start = self.i
        kind = self.conditional()
        op = k[self.i]
        if op == ">" and k[self.i + 1] in (">=", ">>=") and self.at[self.i + 1] == self.at[self.i] + 1:
            self.i += 1
            op = ">>="
        if op in ASSIGN:
            if kind == "x" or kind == "p" and op != "=":
                raise Wrong(self.at[start], "no target of an assignment")
            self.i += 1
            self.assignment()
            return "x"
        return kind

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.k[self.i] == "?":
            self.i += 1
            self.plain()
            self.need(":")
            self.assignment()
            return "x"
        return kind

    def binary(self, least: int) -> str:
        k = self.k
        if k[self.i] == "#" and k[self.i + 1] == "in":
            self.i += 1
            kind = "x"
        else:
            kind = self.unary()
        while True:
            op = k[self.i]
            width = 1
            if op == ">" and self.ts:
                while width < 3 and k[self.i + width] == ">" and self.at[self.i + width] == self.at[self.i] + width:
                    width += 1
                if k[self.i + width] in (">=", ">>=") and self.at[self.i + width] == self.at[self.i] + width:
                    return kind
            level = BINARY.get(op if width == 1 else ">>", 0)
            if op == "in" and self.no_in:
                return kind
            if self.ts and op == "N" and self.words[self.i] in ("as", "satisfies") and not self.nl[self.i] and least <= 7:
                self.i += 1
                if self.k[self.i] == "const":
                    self.i += 1
                else:
                    self.type()
                kind = "a"
                continue
            if not level or level < least:
                return kind
            self.i += width
            self.binary(level if op == "**" else level + 1)
            kind = "x"

    def unary(self) -> str:
        k = self.k[self.i]
        if k in PREFIX:
            self.i += 1
            kind = self.unary()
            if k in ("++", "--") and kind not in ("n", "a"):
                self.fail("no target of an increment")
            return "x"
        if k == "N" and self.words[self.i] == "await" and self.k[self.i + 1] not in (")", "]", "}", ",", ";", "", "=", ".", "=>", ":", "?") and not (self.k[self.i + 1] in BINARY and self.k[self.i + 1] not in ("+", "-", "/")):
            self.i += 1
            self.unary()
            return "x"
        if k == "<" and self.ts:
            self.i += 1
            self.take("const") or self.type()
            self.need(">")
            self.unary()
            return "x"
        kind = self.postfix()
        if self.k[self.i] in ("++", "--") and not self.nl[self.i]:
            if kind not in ("n", "a"):
                self.fail("no target of an increment")
            self.i += 1
            return "x"
        return kind

    def postfix(self) -> str:
        k = self.k
        if k[self.i] == "new":
            kind = self.new()
        else:
            kind = self.primary()
        while True:
            a = k[self.i]
            if a == ".":
                self.i += 1
                self.member()
                kind = "a"
            elif a == "?.":
                self.i += 1
                if k[self.i] == "(":
                    self.arguments()
                elif k[self.i] == "[":
                    self.index()
                elif k[self.i] in ("T", "T<"):
                    self.template()
                elif self.ts and k[self.i] == "<":
                    self.type_arguments()
                    self.arguments()
                else:
                    self.member()
                kind = "x"
            elif a == "(":
                self.arguments()
                kind = "x"
            elif a == "[":
                self.index()
                kind = "a"
            elif a in ("T", "T<"):
                self.template()
                kind = "x"
            elif a == "!" and self.ts and not self.nl[self.i] and k[self.i + 1] not in ("=",):
                self.i += 1
            elif a == "<" and self.ts and kind in ("n", "a") and self.generic_call():
                kind = "x"
            else:
                return kind

    def member(self) -> None:
        if self.k[self.i] in NAMES or self.k[self.i] == "#":
            self.i += 1
        else:
            self.fail("expected a name after '.'")

    def index(self) -> None:
        self.need("[")
        was, self.no_in = self.no_in, False
        self.expression()
        self.no_in = was
        self.need("]")

    def generic_call(self) -> bool:
        start = self.i
        try:
            self.type_arguments()
            if self.k[self.i] in ("(", "T", "T<") or self.k[self.i] in (")", "]", ",", ";", ":", "}", "", "?.", "."):
                return True
        except Wrong:
            pass
        self.i = start
        return False

    def new(self) -> str:
        self.need("new")
        if self.take("."):
            self.name()
            return "x"
        if self.k[self.i] == "new":
            self.new()
        elif self.k[self.i] == "import":
            self.fail()
        else:
            self.primary()
        while True:
            a = self.k[self.i]
            if a == ".":
                self.i += 1
                self.member()
            elif a == "[":
                self.index()
            elif a in ("T", "T<"):
                self.template()
            elif a == "!" and self.ts and self.k[self.i + 1] in (".", "("):
                self.i += 1
            else:
                break
        if self.ts and self.k[self.i] == "<":
            start = self.i
            try:
                self.type_arguments()
            except Wrong:
                self.i = start
        if self.k[self.i] == "(":
            self.arguments()
        return "x"

    def arguments(self) -> None:
        self.need("(")
        was, self.no_in = self.no_in, False
        while self.k[self.i] != ")":
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.no_in = was
        self.need(")")

    def template(self) -> None:
        if self.take("T"):
            return
        self.need("T<")
        was, self.no_in = self.no_in, False
        while True:
            self.expression()
            if self.take("T>"):
                break
            self.need("T-")
        self.no_in = was

    def primary(self) -> str:
        a = self.k[self.i]
        if a == "N":
            word = self.words[self.i]
            if word == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(False)
                return "x"
            self.i += 1
            return "n"
        if a in ("0", "S", "R", "this", "null", "true", "false"):
            self.i += 1
            return "x"
        if a in ("T", "T<"):
            self.template()
            return "x"
        if a == "(":
            self.i += 1
            was, self.no_in = self.no_in, False
            kind = self.expression()
            self.no_in = was
            self.need(")")
            return kind if kind in ("n", "a") else "x"
        if a == "[":
            self.i += 1
            was, self.no_in = self.no_in, False
            while self.k[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
            self.no_in = was
            self.i += 1
            return "p"
        if a == "{":
            self.object()
            return "p"
        if a == "function":
            self.function(False)
            return "x"
        if a == "class" or a == "@":
            self.decorators()
            self.class_(False)
            return "x"
        if a == "super":
            self.i += 1
            if self.k[self.i] not in ("(", ".", "["):
                self.fail("'super' must be called or accessed")
            return "x"
        if a == "import":
            self.i += 1
            if self.take("."):
                self.member()
            elif self.k[self.i] != "(":
                self.fail("expected '(' after 'import'")
            return "x"
        self.fail()
        return "x"

    def object(self) -> None:
        self.need("{")
        was, self.no_in = self.no_in, False
        while self.k[self.i] != "}":
            if self.take("..."):
                self.assignment()
            else:
                self.property()
            if not self.take(","):
                break
        self.no_in = was
        self.need("}")

    def key(self) -> bool:
        """A property's key; True if it is a plain name."""
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            was, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = was
            self.need("]")
            return False
        if k in NAMES or k in ("0", "S", "#"):
            self.i += 1
            return k == "N"
        self.fail("expected a property")
        return False

    def property(self) -> None:
        ends = (",", "}", ":", "(", "=", "<")
        if self.k[self.i] == "N" and self.words[self.i] in ("get", "set", "async") and self.k[self.i + 1] not in ends:
            self.i += 1
        star = self.take("*")
        plain = self.key()
        if self.k[self.i] in ("(", "<"):
            self.method()
        elif star:
            self.fail("expected '('")
        elif self.take(":"):
            self.assignment()
        elif plain:
            if self.take("="):
                self.assignment()
        else:
            self.fail("expected ':'")

    def method(self) -> None:
        self.type_parameters()
        self.parameters()
        self.return_type()
        if self.k[self.i] == "{":
            self.body()
        elif self.ts:
            self.semicolon()
        else:
            self.need("{")

    def body(self) -> None:
        was, self.no_in = self.no_in, False
        self.block()
        self.no_in = was

    def function(self, declared: bool) -> None:
        self.need("function")
        self.take("*")
        if self.k[self.i] == "N":
            self.i += 1
        elif declared:
            self.name()
        self.type_parameters()
        self.parameters()
        self.return_type()
        if self.ts and declared and self.k[self.i] != "{":
            self.semicolon()
        else:
            self.body()

    def parameters(self) -> None:
        self.need("(")
        while self.k[self.i] != ")":
            self.decorators()
            while self.ts and self.k[self.i] == "N" and self.words[self.i] in MODIFIERS and self.k[self.i + 1] in ("N", "{", "["):
                self.i += 1
            rest = self.take("...")
            if self.ts and self.k[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.plain()
            if rest and self.k[self.i] != ")":
                self.fail("nothing may follow a rest parameter")
            if not self.take(","):
                break
        self.need(")")

    def binding(self) -> None:
        if self.take("["):
            while self.k[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.plain()
                if self.k[self.i] != "]":
                    self.need(",")
            self.i += 1
        elif self.take("{"):
            while self.k[self.i] != "}":
                if self.take("..."):
                    self.binding()
                else:
                    plain = self.key()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        self.fail("expected ':'")
                    if self.take("="):
                        self.plain()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.name()

    def return_type(self) -> None:
        if self.ts and self.take(":"):
            if self.is_word("asserts") and self.k[self.i + 1] in ("N", "this") and not self.nl[self.i + 1]:
                self.i += 2
                if self.is_word("is"):
                    self.i += 1
                    self.type()
            elif self.k[self.i] in ("N", "this") and self.is_word("is", 1) and not self.nl[self.i + 1]:
                self.i += 2
                self.type()
            else:
                self.type()

    def arrow(self, at: int) -> bool:
        """Parses an arrow function whose '(' or '<' stands at ``at``, if it is one."""
        start = self.i
        if self.k[at] == "(":
            close = self.match.get(at)
            if close is None:
                return False
            after = self.k[close + 1]
            if after != "=>" and not (self.ts and after == ":"):
                return False
            if after == "=>":
                self.i = at
                self.parameters()
                if self.i != close + 1:
                    self.fail()
                self.need("=>")
                self.arrow_body()
                return True
        elif not self.ts:
            return False
        known = len(self.errors)
        try:
            self.i = at
            self.type_parameters()
            self.parameters()
            self.return_type()
            if self.k[self.i] != "=>" or self.nl[self.i]:
                self.fail()
        except Wrong:
            self.i = start
            del self.errors[known:]
            return False
        self.i += 1
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.k[self.i] == "{":
            self.body()
        else:
            self.assignment()

    # classes

    def decorators(self) -> None:
        while self.take("@"):
            if self.k[self.i] == "(":
                self.primary()
            else:
                self.name()
                while True:
                    if self.take("."):
                        self.member()
                    elif self.k[self.i] == "(":
                        self.arguments()
                    elif self.ts and self.k[self.i] == "<":
                        self.type_arguments()
                    else:
                        break

    def class_(self, declared: bool) -> None:
        self.need("class")
        if self.k[self.i] == "N" and not (self.ts and self.words[self.i] == "implements"):
            self.i += 1
        elif declared:
            self.name()
        self.type_parameters()
        if self.take("extends"):
            self.postfix()
            if self.ts and self.k[self.i] == "<":
                self.type_arguments()
        if self.ts and self.is_word("implements"):
            self.i += 1
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while self.k[self.i] != "}":
            if self.take(";"):
                continue
            start = self.i
            try:
                self.element()
            except Wrong as w:
                if not self.k[self.i]:
                    raise
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                self.skip_balanced(OPEN, STOP)
        self.need("}")

    def element(self) -> None:
        self.decorators()
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", "")
        while self.k[self.i] == "N" and (self.words[self.i] in ("static", "async", "accessor") or self.ts and self.words[self.i] in MODIFIERS) and self.k[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.words[self.i] in ("async", "accessor")):
            if self.words[self.i] == "static" and self.k[self.i + 1] == "{":
                self.i += 1
                self.body()
                return
            self.i += 1
        if self.k[self.i] == "N" and self.words[self.i] in ("get", "set") and self.k[self.i + 1] not in ends and self.k[self.i + 1] != "*":
            self.i += 1
        self.take("*")
        if self.ts and self.k[self.i] == "[" and self.k[self.i + 1] == "N" and self.k[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            if self.take(":"):
                self.type()
            self.semicolon()
            return
        self.key()
        if self.ts:
            self.take("?") or self.take("!")
        if self.k[self.i] in ("(", "<"):
            self.method()
            return
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.plain()
        self.semicolon()

    # types

    def type_parameters(self) -> None:
        if self.ts and self.k[self.i] == "<":
            self.i += 1
            while self.k[self.i] != ">":
                while self.k[self.i] in ("const", "in") or self.k[self.i] == "N" and self.words[self.i] == "out" and self.k[self.i + 1] == "N":
                    self.i += 1
                self.name()
                if self.take("extends"):
                    self.type()
                if self.take("="):
                    self.type()
                if not self.take(","):
                    break
            self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.take(",") or self.k[self.i] == ">":
                break
        self.need(">")

    def type(self) -> None:
        if self.k[self.i] == "new" or self.is_word("abstract") and self.k[self.i + 1] == "new":
            self.i += 1 if self.k[self.i] == "new" else 2
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type()
            return
        if self.k[self.i] == "<" or self.k[self.i] == "(" and self.k[self.match.get(self.i, self.i) + 1] == "=>":
            self.type_parameters()
            self.parameters()
            self.need("=>")
            if self.k[self.i] in ("N", "this") and self.is_word("is", 1) or self.is_word("asserts") and self.k[self.i + 1] == "N":
                self.i += 2
                if self.k[self.i] not in (",", ")", ";", "}", "", "="):
                    self.type()
                return
            self.type()
            return
        self.union()
        if self.k[self.i] == "extends" and not self.nl[self.i] or self.k[self.i] == "extends" and self.k[self.i - 1] != "}":
            self.i += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        self.take("|") or self.take("&")
        while True:
            self.type_operand()
            if self.k[self.i] not in ("|", "&"):
                return
            self.i += 1

    def type_operand(self) -> None:
        k = self.k[self.i]
        if k == "N" and self.words[self.i] in ("keyof", "unique", "readonly", "infer") and self.k[self.i + 1] in ("N", "{", "(", "[", "typeof", "this", "S", "T") and not self.nl[self.i + 1]:
            infer = self.words[self.i] == "infer"
            self.i += 1
            self.type_operand()
            if infer and self.k[self.i] == "extends":
                start = self.i
                try:
                    self.i += 1
                    self.union()
                    if self.k[self.i] == "?":
                        self.i = start
                except Wrong:
                    self.i = start
            return
        if k == "typeof":
            self.i += 1
            if self.take("import"):
                self.arguments()
            elif self.k[self.i] in NAMES:
                self.i += 1
            else:
                self.fail()
            while self.take("."):
                self.member()
            if self.k[self.i] == "<":
                self.type_arguments()
        elif k == "import":
            self.i += 1
            self.arguments()
            while self.take("."):
                self.member()
            if self.k[self.i] == "<":
                self.type_arguments()
        elif k == "N" or k in ("this", "void", "null", "true", "false", "S", "0", "T", "function"):
            self.i += 1
            if k == "N":
                while self.take("."):
                    self.member()
                if self.k[self.i] == "<" and not self.nl[self.i]:
                    self.type_arguments()
        elif k == "T<":
            self.i += 1
            while True:
                self.type()
                if self.take("T>"):
                    break
                self.need("T-")
        elif k == "-":
            self.i += 1
            self.need("0")
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            while self.k[self.i] != "]":
                self.take("...")
                if self.k[self.i] in NAMES and (self.k[self.i + 1] == ":" or self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if not self.take(","):
                    break
            self.need("]")
        elif k == "{":
            self.members()
        else:
            self.fail("expected a type")
        while self.k[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if self.k[self.i] != "]":
                self.type()
            self.need("]")

    def members(self) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] in ("+", "-"):
                self.i += 1
            ends = (":", "?", "(", "<", ";", ",", "}")
            while self.k[self.i] == "N" and self.words[self.i] in ("readonly", "get", "set") and self.k[self.i + 1] not in ends:
                self.i += 1
            if self.k[self.i] in ("(", "<"):
                self.type_parameters()
                self.parameters()
                self.return_type()
            elif self.k[self.i] == "new" and self.k[self.i + 1] in ("(", "<"):
                self.i += 1
                self.type_parameters()
                self.parameters()
                self.return_type()
            elif self.k[self.i] == "[" and self.k[self.i + 1] == "N" and self.k[self.i + 2] in (":", "in"):
                self.i += 3
                self.type()
                if self.is_word("as"):
                    self.i += 1
                    self.type()
                self.need("]")
                if self.k[self.i] in ("+", "-"):
                    self.i += 1
                self.take("?")
                if self.take(":"):
                    self.type()
            else:
                self.key()
                self.take("?")
                if self.k[self.i] in ("(", "<"):
                    self.type_parameters()
                    self.parameters()
                    self.return_type()
                elif self.take(":"):
                    self.type()
            if not (self.take(";") or self.take(",")) and self.k[self.i] != "}" and not self.nl[self.i]:
                self.fail()
        self.need("}")

    # statements

    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.need("}")

    def statements(self, stop: str, also: tuple[str, ...] = ()) -> None:
        while self.k[self.i] and self.k[self.i] != stop and self.k[self.i] not in also:
            start = self.i
            try:
                self.statement()
            except Wrong as w:
                if not self.k[self.i]:
                    raise
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                self.skip_balanced(OPEN, STOP)
                self.take(";")
                if self.k[self.i] == "}" and not stop:
                    self.i += 1

    def variables(self) -> None:
        """After var, let or const."""
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            elif pattern and not self.no_in:
                self.fail("a pattern needs a value")
            if not self.take(","):
                return

    def statement(self) -> None:
        k = self.k[self.i]
        handler = STATEMENTS.get(k)
        if handler:
            handler(self)
            return
        if k == "N":
            word, after = self.words[self.i], self.k[self.i + 1]
            if word == "let" and after in ("N", "[", "{"):
                self.declaration()
                return
            if after == ":":
                self.i += 2
                self.statement()
                return
            if word == "async" and after == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True)
                return
            if word == "using" and after == "N" and not self.nl[self.i + 1]:
                self.declaration()
                return
            if self.await_using():
                self.i += 1
                self.declaration()
                return
            if self.ts and not self.nl[self.i + 1] and self.ts_statement(word, after):
                return
        self.expression()
        self.semicolon()

    def await_using(self) -> bool:
        """Whether a declaration 'await using x' stands here."""
        return self.is_word("await") and self.is_word("using", 1) and self.k[self.i + 2] == "N" and not self.nl[self.i + 1] and not self.nl[self.i + 2]

    def ts_statement(self, word: str, after: str) -> bool:
        if word == "type" and after == "N" and self.k[self.i + 2] in ("=", "<"):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif word == "interface" and after == "N":
            self.i += 2
            self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.members()
        elif word in ("namespace", "module") and after in ("N", "S"):
            self.i += 2
            while self.take("."):
                self.need("N")
            if self.k[self.i] == "{":
                self.block()
            else:
                self.semicolon()
        elif word == "global" and after == "{":
            self.i += 1
            self.block()
        elif word == "declare" and after in ("N", "const", "var", "function", "class", "enum"):
            self.i += 1
            if self.take("const") and self.k[self.i] != "enum":
                self.variables()
                self.semicolon()
            else:
                self.statement()
        elif word == "abstract" and after == "class":
            self.i += 1
            self.class_(True)
        else:
            return False
        return True

    def declaration(self) -> None:
        if self.ts and self.k[self.i] == "const" and self.k[self.i + 1] == "enum":
            self.i += 1
            self.enum()
            return
        constant = self.k[self.i] == "const"
        self.i += 1
        start = self.i
        self.variables()
        if constant and self.k[start] == "N" and self.k[start + 1] in (";", "") and not self.ts:
            raise Wrong(self.at[start], "a constant needs a value")
        self.semicolon()

    def enum(self) -> None:
        self.need("enum")
        if not self.ts:
            self.fail("'enum' is reserved")
        self.name()
        self.need("{")
        while self.k[self.i] != "}":
            self.key()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need("}")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def for_(self) -> None:
        self.i += 1
        if self.is_word("await"):
            self.i += 1
        self.need("(")
        kind = ""
        if self.k[self.i] != ";":
            self.no_in = True
            if self.await_using() and not self.is_word("of", 2):
                self.i += 1
            if self.k[self.i] in ("var", "const") or self.is_word("let") and self.k[self.i + 1] in ("N", "[", "{") or self.is_word("using") and self.k[self.i + 1] == "N" and not self.is_word("of", 1):
                self.i += 1
                self.variables()
                kind = "n"
            else:
                kind = self.expression()
            self.no_in = False
        if self.k[self.i] == "in" or self.is_word("of"):
            if kind == "x":
                self.fail("no target of a loop")
            of = self.k[self.i] != "in"
            self.i += 1
            self.plain() if of else self.expression()
        else:
            self.need(";")
            if self.k[self.i] != ";":
                self.expression()
            self.need(";")
            if self.k[self.i] != ")":
                self.expression()
        self.need(")")
        self.statement()

    def jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "N" and not self.nl[self.i]:
            self.i += 1
        self.semicolon()

    def return_(self) -> None:
        self.i += 1
        if self.k[self.i] not in (";", "}", "") and not self.nl[self.i]:
            self.expression()
        self.semicolon()

    def throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.fail("nothing is thrown")
        self.expression()
        self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'catch' or 'finally'")

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while self.k[self.i] in ("case", "default"):
            if self.take("case"):
                self.expression()
            else:
                self.i += 1
            self.need(":")
            self.statements("}", ("case", "default"))
        self.need("}")

    def with_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def empty(self) -> None:
        self.i += 1

    def debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def function_statement(self) -> None:
        self.function(True)

    def class_statement(self) -> None:
        self.decorators()
        if self.k[self.i] == "export":
            self.export()
            return
        if self.ts and self.is_word("abstract"):
            self.i += 1
        self.class_(True)

    def import_(self) -> None:
        if self.k[self.i + 1] in ("(", "."):
            self.expression()
            self.semicolon()
            return
        self.i += 1
        if self.take("S"):
            self.attributes()
            self.semicolon()
            return
        if self.ts and self.is_word("type") and (self.k[self.i + 1] in ("{", "*") or self.k[self.i + 1] == "N" and not self.is_word("from", 1)):
            self.i += 1
        if self.k[self.i] == "N":
            self.i += 1
            if self.ts and self.take("="):
                if self.is_word("require"):
                    self.i += 1
                    self.arguments()
                else:
                    self.need("N")
                    while self.take("."):
                        self.member()
                self.semicolon()
                return
            if not self.take(","):
                self.source()
                return
        if self.take("*"):
            if not self.is_word("as"):
                self.fail("expected 'as'")
            self.i += 1
            self.name()
        else:
            self.specifiers(True)
        self.source()

    def attributes(self) -> None:
        if (self.k[self.i] == "with" or self.is_word("assert")) and self.k[self.i + 1] == "{":
            self.i += 1
            self.object()

    def source(self) -> None:
        if not self.is_word("from"):
            self.fail("expected 'from'")
        self.i += 1
        self.need("S")
        self.attributes()
        self.semicolon()

    def specifiers(self, names: bool) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            if self.ts and self.is_word("type") and self.k[self.i + 1] in NAMES and not self.is_word("as", 1):
                self.i += 1
            if self.k[self.i] not in NAMES and self.k[self.i] != "S":
                self.fail("expected a name")
            plain = self.k[self.i] == "N"
            self.i += 1
            if self.is_word("as"):
                self.i += 1
                if names:
                    self.name()
                elif self.k[self.i] in NAMES or self.k[self.i] == "S":
                    self.i += 1
                else:
                    self.fail("expected a name")
            elif names and not plain:
                self.fail("expected 'as'")
            if not self.take(","):
                break
        self.need("}")

    def export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.k[self.i] == "function" or self.is_word("async") and self.k[self.i + 1] == "function":
                if self.k[self.i] == "N":
                    self.i += 1
                self.function(False)
            elif self.k[self.i] in ("class", "@"):
                self.decorators()
                self.class_(False)
            elif self.ts and self.is_word("abstract") and self.k[self.i + 1] == "class":
                self.i += 1
                self.class_(False)
            elif self.ts and self.is_word("interface"):
                self.statement()
            else:
                self.assignment()
                self.semicolon()
        elif self.take("*"):
            if self.is_word("as"):
                self.i += 2
            self.source()
        elif self.k[self.i] == "{" or self.ts and self.is_word("type") and self.k[self.i + 1] in ("{", "*"):
            if self.is_word("type"):
                self.i += 1
            if self.take("*"):
                if self.is_word("as"):
                    self.i += 2
                self.source()
                return
            self.specifiers(False)
            if self.is_word("from"):
                self.source()
            else:
                self.semicolon()
        elif self.ts and self.take("="):
            self.expression()
            self.semicolon()
        elif self.ts and self.is_word("as"):
            self.i += 1
            if self.is_word("namespace"):
                self.i += 1
            self.name()
            self.semicolon()
        elif self.ts and self.take("import"):
            self.i -= 1
            self.import_()
        elif self.k[self.i] in ("var", "const", "function", "class", "@", "enum") or self.is_word("let") or self.is_word("async"):
            self.statement()
        elif self.ts and self.k[self.i] == "N" and self.words[self.i] in ("type", "interface", "namespace", "module", "declare", "abstract"):
            self.statement()
        else:
            self.fail("nothing to export")

    def file(self) -> list[Wrong]:
        try:
            self.statements("")
        except Wrong as w:
            self.errors.append(w)
        except RecursionError:
            self.errors.append(Wrong(0, "nested too deeply"))
        return sorted(self.errors, key=lambda w: w.at)


STATEMENTS = {
    "{": Script.block, "var": Script.declaration, "const": Script.declaration, "if": Script.if_, "for": Script.for_, "while": Script.while_, "do": Script.do, "return": Script.return_, "break": Script.jump, "continue": Script.jump,
    "throw": Script.throw, "try": Script.try_, "switch": Script.switch, "with": Script.with_, ";": Script.empty, "debugger": Script.debugger, "function": Script.function_statement, "class": Script.class_statement, "@": Script.class_statement,
    "import": Script.import_, "export": Script.export, "enum": Script.enum,
}


def parse(text: str) -> list[Wrong]:
    """Errors of a JavaScript text."""
    return Script(text.lstrip("﻿"), False).file()


def parse_ts(text: str) -> list[Wrong]:
    """Errors of a TypeScript text."""
    return Script(text.lstrip("﻿"), True).file()
