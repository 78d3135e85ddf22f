"""Go: recursive-descent declarations and statements, precedence climbing for expressions."""

from __future__ import annotations

from codectx.llm.syntax.braces import GO_TOKEN, GO_WORDS, lex_simple
from codectx.llm.syntax.core import Parser, Wrong

BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
UNARY = frozenset("+ - ! ^ * & <-".split())
OPEN = {"(": ")", "[": "]", "{": "}"}
STOP = frozenset([";", "}"])
TYPE_BEGIN = frozenset("N ( [ * func struct interface map chan <-".split())


class Go(Parser):
    def __init__(self, kinds: list[str], starts: list[int], errors: list[Wrong]):
        super().__init__(kinds, starts, errors)
        #: Below 0, a '{' after an operand begins a block and no composite literal.
        self.level = 0

    # types

    def type(self) -> None:
        k = self.k[self.i]
        if k == "N":
            self.i += 1
            if self.take("."):
                self.need("N")
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
                self.i += 1
                self.types("]")
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.inside()
                self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.struct()
        elif k == "interface":
            self.interface()
        else:
            self.fail("expected a type")

    def types(self, close: str) -> None:
        while self.k[self.i] != close:
            self.type()
            if not self.take(","):
                break
        self.need(close)

    def inside(self) -> None:
        level, self.level = self.level, 0
        self.expression()
        self.level = level

    def struct(self) -> None:
        self.i += 1
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "*":
                self.type()
            elif self.k[self.i] == "N" and self.k[self.i + 1] in (";", "}", "S", "."):
                self.type()
            elif self.k[self.i] == "N" and self.k[self.i + 1] == "[" and self.k[self.i + 2] == "N" and self.k[self.i + 3] in ("]", ",") and self.k[self.i + 4] in (";", "}", "S"):
                self.type()
            else:
                self.need("N")
                while self.take(","):
                    self.need("N")
                self.type()
            self.take("S")
            if not self.take(";"):
                break
        self.need("}")

    def interface(self) -> None:
        self.i += 1
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "N" and self.k[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.union()
            if not self.take(";"):
                break
        self.need("}")

    def union(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def parameters(self) -> None:
        """'(' groups of names and types or types alone ')'. Names without types are types by themselves, so each entry is a type with one more after it or none."""
        self.need("(")
        while self.k[self.i] != ")":
            if self.take("..."):
                self.type()
            else:
                self.type()
                if self.k[self.i] not in (",", ")"):
                    self.take("...")
                    self.type()
            if not self.take(","):
                break
        self.need(")")

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.k[self.i] in TYPE_BEGIN:
            self.type()

    def type_parameters(self) -> None:
        if self.k[self.i] == "[":
            self.i += 1
            while self.k[self.i] != "]":
                self.need("N")
                while self.take(","):
                    self.need("N")
                self.union()
                if not self.take(","):
                    break
            self.need("]")

    # expressions

    def expression(self, least: int = 1) -> None:
        self.unary()
        while True:
            level = BINARY.get(self.k[self.i], 0)
            if level < least or not level:
                return
            self.i += 1
            self.expression(level + 1)

    def unary(self) -> None:
        while self.k[self.i] in UNARY:
            self.i += 1
        self.primary()

    def primary(self) -> None:
        k = self.k[self.i]
        literal = False
        if k == "N":
            self.i += 1
            literal = True
        elif k in ("0", "S"):
            self.i += 1
        elif k == "(":
            self.i += 1
            level, self.level = self.level, 0
            if self.k[self.i] in ("*", "[", "func", "chan", "<-", "map", "struct", "interface"):
                self.type_or_expression()
            else:
                self.expression()
            self.level = level
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
            if self.k[self.i] == "{":
                level, self.level = self.level, 0
                self.block()
                self.level = level
        elif k in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.k[self.i] == "{":
                self.composite()
            elif self.k[self.i] != "(":
                if self.k[self.i] not in (")", ","):
                    self.fail("a type can't be a value")
        else:
            self.fail()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                else:
                    self.need("N")
            elif k == "(":
                self.arguments()
                literal = False
            elif k == "[":
                self.i += 1
                level, self.level = self.level, 0
                if self.k[self.i] == "]":
                    self.fail("expected an index")
                if self.k[self.i] != ":":
                    self.type_or_expression()
                    while self.take(","):
                        if self.k[self.i] == "]":
                            break
                        self.type_or_expression()
                for _ in range(2):
                    if self.take(":") and self.k[self.i] not in (":", "]"):
                        self.expression()
                self.level = level
                self.need("]")
            elif k == "{" and literal and self.level >= 0:
                self.composite()
                literal = False
            else:
                return

    def type_or_expression(self) -> None:
        k = self.k[self.i]
        if k in ("[", "map", "chan", "struct", "interface", "func"):
            start = self.i
            try:
                self.expression()
            except Wrong:
                self.i = start
                self.type()
        else:
            start = self.i
            try:
                self.expression()
            except Wrong:
                far, self.i = self.i, start
                try:
                    self.type()
                except Wrong:
                    self.i = far
                    self.fail()

    def arguments(self) -> None:
        self.i += 1
        level, self.level = self.level, 0
        while self.k[self.i] != ")":
            self.type_or_expression()
            self.take("...")
            if not self.take(","):
                break
        self.level = level
        self.need(")")

    def composite(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        while self.k[self.i] != "}":
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
        self.level = level
        self.need("}")

    def element(self) -> None:
        if self.k[self.i] == "{":
            self.composite()
        else:
            self.expression()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    # statements

    def block(self) -> None:
        self.need("{")
        self.statements(frozenset("}"))
        self.need("}")

    def statements(self, stop: frozenset[str]) -> None:
        while self.k[self.i] and self.k[self.i] not in stop:
            if self.take(";"):
                continue
            start = self.i
            try:
                self.statement()
                if self.k[self.i] not in stop and not self.take(";"):
                    self.fail("expected the statement's end, found " + repr(self.k[self.i] or "end of text"))
            except Wrong as w:
                if not self.k[self.i]:
                    raise
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                self.skip_balanced(OPEN, STOP)

    def simple(self, ranged: bool = False) -> bool:
        """A simple statement. True: it was a range clause."""
        if ranged and self.take("range"):
            self.expression()
            return True
        self.expressions()
        k = self.k[self.i]
        if k in ASSIGN:
            self.i += 1
            if ranged and self.take("range"):
                self.expression()
                return True
            self.expressions()
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expression()
        return False

    def header(self) -> None:
        """What stands between 'if' or 'switch' and the block."""
        level, self.level = self.level, -1
        if self.k[self.i] not in ("{", ";"):
            self.simple()
        if self.take(";") and self.k[self.i] != "{":
            self.simple()
        self.level = level

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_statement()
        elif k == "for":
            self.i += 1
            level, self.level = self.level, -1
            if self.k[self.i] != "{":
                done = self.k[self.i] != ";" and self.simple(True)
                if not done and self.take(";"):
                    if self.k[self.i] != ";":
                        self.simple()
                    self.need(";")
                    if self.k[self.i] != "{":
                        self.simple()
            self.level = level
            self.block()
        elif k == "switch":
            self.i += 1
            self.header()
            self.cases()
        elif k == "select":
            self.i += 1
            self.cases()
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto"):
            self.i += 1
            self.take("N")
        elif k == "fallthrough":
            self.i += 1
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
        elif k == "N" and self.k[self.i + 1] == ":":
            self.i += 2
            if self.k[self.i] not in ("}", ";"):
                self.statement()
        else:
            self.simple()

    def if_statement(self) -> None:
        self.i += 1
        if self.k[self.i] == "{":
            self.fail("a condition is missing")
        self.header()
        self.block()
        if self.take("else"):
            if self.k[self.i] == "if":
                self.if_statement()
            else:
                self.block()

    def cases(self) -> None:
        self.need("{")
        while self.k[self.i] in ("case", "default"):
            if self.take("case"):
                while True:
                    self.type_or_expression()
                    if not self.take(","):
                        break
                if self.k[self.i] in ASSIGN:
                    self.i += 1
                    self.expressions()
                elif self.take("<-"):
                    self.expression()
            else:
                self.i += 1
            self.need(":")
            self.statements(frozenset(["case", "default", "}"]))
        self.need("}")

    def declaration(self) -> None:
        word = self.k[self.i]
        self.i += 1
        one = {"var": self.var, "const": self.const, "type": self.type_spec, "import": self.import_spec}[word]
        if self.take("("):
            while self.k[self.i] != ")":
                one()
                if not self.take(";"):
                    break
            self.need(")")
        else:
            one()

    def var(self) -> None:
        self.need("N")
        while self.take(","):
            self.need("N")
        if self.k[self.i] != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def const(self) -> None:
        self.need("N")
        while self.take(","):
            self.need("N")
        if self.k[self.i] in TYPE_BEGIN:
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("N")
        if self.k[self.i] == "[" and self.k[self.i + 1] == "N" and self.k[self.i + 2] != "]":
            start = self.i
            try:
                self.type_parameters()
            except Wrong:
                self.i = start
        self.take("=")
        self.type()

    def import_spec(self) -> None:
        if self.k[self.i] in ("N", "."):
            self.i += 1
        self.need("S")

    def file(self) -> None:
        try:
            self.need("package")
            self.need("N")
            if self.k[self.i]:
                self.need(";")
        except Wrong as w:
            self.errors.append(w)
        declared = False
        while self.k[self.i]:
            if self.take(";"):
                continue
            start = self.i
            try:
                k = self.k[self.i]
                if k == "func":
                    declared = True
                    self.i += 1
                    if self.k[self.i] == "(":
                        self.parameters()
                    self.need("N")
                    self.type_parameters()
                    self.signature()
                    if self.k[self.i] == "{":
                        self.block()
                elif k in ("var", "const", "type") or k == "import" and not declared:
                    declared = declared or k != "import"
                    self.declaration()
                else:
                    self.fail("no declaration")
                if self.k[self.i]:
                    self.need(";")
            except Wrong as w:
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                while self.k[self.i] and self.k[self.i] not in ("func", "type", "var", "const"):
                    self.i += 1


def parse(text: str) -> list[Wrong]:
    errors: list[Wrong] = []
    kinds, starts = lex_simple(text.lstrip("﻿"), errors, GO_TOKEN, GO_WORDS, True)
    try:
        Go(kinds, starts, errors).file()
    except RecursionError:
        errors.append(Wrong(0, "nested too deeply"))
    return sorted(errors, key=lambda w: w.at)
