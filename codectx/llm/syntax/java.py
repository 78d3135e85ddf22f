"""Java: recursive-descent declarations and statements, precedence climbing for expressions."""

from __future__ import annotations

from codectx.llm.syntax.braces import JAVA_TOKEN, JAVA_WORDS, lex_simple
from codectx.llm.syntax.core import Parser, Wrong

PRIMITIVE = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
BINARY = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
OPEN = {"(": ")", "[": "]", "{": "}"}
STOP = frozenset([";", "}"])
#: What may follow '(Type)' if that is a cast to a reference type.
CAST = frozenset(["N", "0", "S", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch", *PRIMITIVE])


class Java(Parser):
    """Expressions return 'v' what can be assigned to, 'c' what may stand as a statement, 'x' anything else."""

    def __init__(self, text: str):
        errors: list[Wrong] = []
        kinds, starts = lex_simple(text, errors, JAVA_TOKEN, JAVA_WORDS, False)
        super().__init__(kinds, starts, errors)
        self.text = text
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, k in enumerate(kinds):
            if k == "(":
                stack.append(i)
            elif k == ")" and stack:
                self.match[stack.pop()] = i

    def is_word(self, word: str, ahead: int = 0) -> bool:
        i = self.i + ahead
        at = self.at[i]
        return self.k[i] == "N" and self.text.startswith(word, at) and not self.text[at + len(word) : at + len(word) + 1].isidentifier()

    def name(self) -> None:
        if self.k[self.i] not in ("N", "_"):
            self.fail(f"expected a name, found {self.k[self.i] or 'end of text'!r}")
        self.i += 1

    def dotted(self) -> None:
        self.need("N")
        while self.k[self.i] == "." and self.k[self.i + 1] == "N":
            self.i += 2

    # types

    def type(self, void: bool = False) -> None:
        self.annotations()
        k = self.k[self.i]
        if k in PRIMITIVE or void and k == "void":
            self.i += 1
        else:
            self.need("N")
            self.type_arguments()
            while self.k[self.i] == "." and self.k[self.i + 1] in ("N", "@"):
                self.i += 1
                self.annotations()
                self.need("N")
                self.type_arguments()
        self.brackets()

    def brackets(self) -> None:
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]" or self.k[self.i] == "@" and self.k[self.i + 1] == "N" and self.k[self.i + 2] == "[":
            self.annotations()
            self.i += 2

    def type_arguments(self) -> None:
        if self.take("<"):
            while self.k[self.i] != ">":
                self.annotations()
                if self.take("?"):
                    if self.take("extends") or self.take("super"):
                        self.type()
                else:
                    self.type()
                if not self.take(","):
                    break
            self.need(">")

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.annotations()
                self.need("N")
                if self.take("extends"):
                    self.bound()
                if not self.take(","):
                    break
            self.need(">")

    def bound(self) -> None:
        self.type()
        while self.take("&"):
            self.type()

    def annotations(self) -> None:
        while self.k[self.i] == "@" and self.k[self.i + 1] != "interface":
            self.i += 1
            self.dotted()
            if self.take("("):
                if self.k[self.i] != ")":
                    if self.k[self.i] == "N" and self.k[self.i + 1] == "=":
                        while True:
                            self.need("N")
                            self.need("=")
                            self.value()
                            if not self.take(","):
                                break
                    else:
                        self.value()
                self.need(")")

    def value(self) -> None:
        if self.k[self.i] == "@":
            self.annotations()
        elif self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                self.value()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.conditional()

    def modifiers(self) -> None:
        while True:
            if self.k[self.i] == "@" and self.k[self.i + 1] != "interface":
                self.annotations()
            elif self.k[self.i] in MODIFIERS and not (self.k[self.i] == "default" and self.k[self.i + 1] in (":", "->")):
                self.i += 1
            elif self.is_word("sealed") and self.k[self.i + 1] in ("class", "interface", "abstract", "public", "static"):
                self.i += 1
            elif self.is_word("non") and self.k[self.i + 1] == "-" and self.is_word("sealed", 2):
                self.i += 3
            else:
                return

    # expressions

    def expression(self) -> str:
        start = self.i
        if self.lambda_():
            return "x"
        kind = self.conditional()
        op = self.k[self.i]
        if op == ">" and self.k[self.i + 1] in (">=", ">>=", ">>>="):
            self.i += 1
            op = ">>="
        if op in ASSIGN:
            if kind != "v":
                raise Wrong(self.at[start], "no target of an assignment")
            self.i += 1
            self.expression()
            return "c"
        return kind

    def lambda_(self) -> bool:
        if self.k[self.i] in ("N", "_") and self.k[self.i + 1] == "->":
            self.i += 2
        elif self.k[self.i] == "(" and self.k[self.match.get(self.i, self.i) + 1] == "->":
            close = self.match[self.i]
            self.i += 1
            if self.i < close:
                if self.k[self.i] in ("N", "_") and self.k[self.i + 1] in (",", ")"):
                    self.name()
                    while self.take(","):
                        self.name()
                else:
                    self.i -= 1
                    self.parameters()
                    self.i -= 1
            self.need(")")
            self.need("->")
        else:
            return False
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()
        return True

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.take("?"):
            self.lambda_() or self.expression()
            self.need(":")
            self.lambda_() or self.conditional()
            return "x"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        k = self.k
        while True:
            op = k[self.i]
            width = 1
            if op == ">":
                while width < 3 and k[self.i + width] == ">" and self.at[self.i + width] == self.at[self.i] + width:
                    width += 1
                if k[self.i + width] in (">=", ">>=") and self.at[self.i + width] == self.at[self.i] + width:
                    return kind
            level = BINARY.get(op if width == 1 else ">>", 0)
            if not level or level < least:
                return kind
            self.i += width
            kind = "x"
            if op == "instanceof":
                self.pattern()
            else:
                self.binary(level + 1)

    def pattern(self) -> None:
        while self.k[self.i] in ("final", "@"):
            self.modifiers()
        self.type()
        if self.k[self.i] == "(":
            self.i += 1
            while self.k[self.i] != ")":
                if self.k[self.i] == "_":
                    self.i += 1
                else:
                    self.pattern()
                if not self.take(","):
                    break
            self.need(")")
        if self.k[self.i] in ("N", "_") and not self.is_word("when"):
            self.i += 1

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "x"
        if k in ("++", "--"):
            self.i += 1
            if self.unary() != "v":
                self.fail("no target of an increment")
            return "c"
        if k == "(" and self.cast():
            return "x"
        kind = self.primary()
        if self.k[self.i] in ("++", "--"):
            if kind != "v":
                self.fail("no target of an increment")
            self.i += 1
            return "c"
        return kind

    def cast(self) -> bool:
        close = self.match.get(self.i)
        if close is None:
            return False
        after = self.k[close + 1]
        primitive = self.k[self.i + 1] in PRIMITIVE
        if not primitive and (after not in CAST or self.k[self.i + 1] not in ("N", "@")):
            return False
        start = self.i
        try:
            self.i += 1
            self.bound()
            if self.i != close:
                raise Wrong(0, "")
        except Wrong:
            self.i = start
            return False
        self.i += 1
        self.lambda_() or self.unary()
        return True

    def primary(self) -> str:
        k = self.k[self.i]
        if k == "N":
            if self.generic_reference():
                kind = "x"
            else:
                self.i += 1
                kind = "v"
                if self.k[self.i] == "(":
                    self.arguments()
                    kind = "c"
        elif k in ("0", "S", "true", "false", "null"):
            self.i += 1
            kind = "x"
        elif k == "this" or k == "super":
            self.i += 1
            kind = "x"
            if self.k[self.i] == "(":
                self.arguments()
                kind = "c"
            elif k == "super" and self.k[self.i] not in (".", "::"):
                self.fail("'super' must be called or accessed")
        elif k == "(":
            self.i += 1
            kind = self.expression()
            kind = "v" if kind == "v" else "x"
            self.need(")")
        elif k == "new":
            kind = self.new()
        elif k == "switch":
            self.switch()
            kind = "x"
        elif k in PRIMITIVE or k == "void":
            self.type(True)
            if self.k[self.i] == "::":
                pass
            else:
                self.need(".")
                self.need("class")
            kind = "x"
        else:
            self.fail()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.type_arguments()
                a = self.k[self.i]
                if a == "N":
                    self.i += 1
                    kind = "v"
                    if self.k[self.i] == "(":
                        self.arguments()
                        kind = "c"
                elif a == "new":
                    kind = self.new()
                elif a in ("this", "class", "super"):
                    self.i += 1
                    kind = "x"
                    if a == "super" and self.k[self.i] == "(":
                        self.arguments()
                        kind = "c"
                else:
                    self.fail("expected a name after '.'")
            elif k == "[":
                if self.k[self.i + 1] == "]":
                    self.brackets()
                    if self.k[self.i] == ".":
                        self.need(".")
                        self.need("class")
                    elif self.k[self.i] != "::":
                        self.fail("an index is missing")
                    kind = "x"
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                kind = "v"
            elif k == "::":
                self.i += 1
                self.type_arguments()
                if not self.take("new"):
                    self.need("N")
                kind = "x"
            else:
                return kind

    def generic_reference(self) -> bool:
        """Type<Arguments>::name, which begins like a comparison."""
        if self.k[self.i + 1] != "<":
            return False
        start = self.i
        try:
            self.type()
            if self.k[self.i] == "::":
                return True
        except Wrong:
            pass
        self.i = start
        return False

    def arguments(self) -> None:
        self.need("(")
        while self.k[self.i] != ")":
            self.expression()
            if not self.take(","):
                break
        self.need(")")

    def new(self) -> str:
        self.need("new")
        self.annotations()
        self.type_arguments()
        if self.k[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.need("N")
            self.type_arguments()
            while self.take("."):
                self.need("N")
                self.type_arguments()
        if self.k[self.i] == "(":
            self.arguments()
            if self.k[self.i] == "{":
                self.class_body()
            return "c"
        if self.k[self.i] != "[":
            self.fail("expected '(' or '['")
        sized = False
        while self.k[self.i] == "[":
            self.i += 1
            if self.take("]"):
                continue
            self.expression()
            self.need("]")
            sized = True
        if self.k[self.i] == "{" and not sized:
            self.initializer()
        elif not sized:
            self.fail("a size is missing")
        return "x"

    def initializer(self) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "{":
                self.initializer()
            else:
                self.expression()
            if not self.take(","):
                break
        self.need("}")

    # statements

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self, labels: bool = False) -> None:
        while self.k[self.i] and self.k[self.i] != "}":
            if labels and self.k[self.i] in ("case", "default"):
                return
            start = self.i
            try:
                self.statement(True)
            except Wrong as w:
                if not self.k[self.i]:
                    raise
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                self.skip_balanced(OPEN, STOP)
                self.take(";")

    def local(self) -> bool:
        """Parses a local variable's declaration, if there is one."""
        k = self.k[self.i]
        if k in PRIMITIVE and self.k[self.i + 1] in ("N", "_", "[", "@"):
            start = self.i
            self.type()
            if self.k[self.i] in ("N", "_"):
                self.variables()
                return True
            self.i = start
            return False
        if k not in ("N", "@", "final"):
            return False
        start = self.i
        sure = k == "final" or k == "@"
        try:
            self.modifiers()
            self.type()
            if self.k[self.i] not in ("N", "_") or self.k[self.i + 1] not in ("=", ";", ",", ":", "[", ")") and not sure:
                raise Wrong(self.at[self.i], "expected a name")
        except Wrong:
            self.i = start
            if sure:
                raise
            return False
        self.variables()
        return True

    def variables(self) -> None:
        while True:
            self.name()
            self.brackets()
            if self.take("="):
                if self.k[self.i] == "{":
                    self.initializer()
                else:
                    self.expression()
            if not self.take(","):
                return

    def type_declaration_ahead(self) -> bool:
        i = self.i
        while self.k[i] in MODIFIERS or self.k[i] == "@" and self.k[i + 1] == "N":
            if self.k[i] == "@":
                i += 2
                while self.k[i] == ".":
                    i += 2
                if self.k[i] == "(":
                    i = self.match.get(i, i) + 1
            else:
                i += 1
        if self.k[i] in ("class", "interface", "enum") or self.k[i] == "@" and self.k[i + 1] == "interface":
            return True
        at = self.at[i]
        if self.k[i] == "N" and self.text.startswith(("sealed ", "non-sealed"), at):
            return self.k[i + 1] in ("class", "interface", "abstract", "-")
        return self.k[i] == "N" and self.text.startswith("record", at) and not self.text[at + 6 : at + 7].isidentifier() and self.k[i + 1] == "N" and self.k[i + 2] in ("(", "<")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self, declared: bool = False) -> None:
        k = self.k[self.i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k == "while":
            self.i += 1
            self.condition()
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == "for":
            self.for_()
        elif k == "return":
            self.i += 1
            if self.k[self.i] != ";":
                self.expression()
            self.need(";")
        elif k == "throw":
            self.i += 1
            self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.i += 1
            self.take("N")
            self.need(";")
        elif k == "try":
            self.try_()
        elif k == "switch":
            self.switch()
            if self.k[self.i] == ".":
                self.fail()
        elif k == "synchronized" and self.k[self.i + 1] == "(":
            self.i += 1
            self.condition()
            self.block()
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif k == "N" and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif self.is_word("yield") and self.k[self.i + 1] not in ASSIGN and self.k[self.i + 1] not in (".", "(", "[", "++", "--", "->"):
            self.i += 1
            self.expression()
            self.need(";")
        elif self.is_word("yield") and self.k[self.i + 1] == "(":
            self.i += 1
            self.expression()
            self.need(";")
        elif declared and self.type_declaration_ahead():
            self.type_declaration()
        elif self.local():
            if not declared:
                self.fail("a declaration must stand in a block")
            self.need(";")
        else:
            start = self.i
            if self.expression() != "c":
                raise Wrong(self.at[start], "no statement")
            self.need(";")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if self.k[self.i] != ";":
            if self.local():
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
            else:
                self.expression()
                while self.take(","):
                    self.expression()
        self.need(";")
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")
        if self.k[self.i] != ")":
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")
        self.statement()

    def try_(self) -> None:
        self.i += 1
        done = False
        if self.take("("):
            done = True
            while self.k[self.i] != ")":
                self.local() or self.expression()
                if not self.take(";"):
                    break
            self.need(")")
        self.block()
        while self.take("catch"):
            done = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not done:
            self.fail("expected 'catch' or 'finally'")

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while self.k[self.i] in ("case", "default"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.take("default"):
                        self.label()
                    if not self.take(","):
                        break
                if self.is_word("when"):
                    self.i += 1
                    self.conditional()
            if self.take("->"):
                if self.k[self.i] == "{":
                    self.block()
                elif self.k[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                self.statements(True)
        self.need("}")

    def label(self) -> None:
        if self.k[self.i] == "N" or self.k[self.i] == "final":
            start = self.i
            try:
                self.pattern()
                if self.k[self.i] in ("->", ":", ",") or self.is_word("when"):
                    if self.i > start + 1:
                        return
            except Wrong:
                pass
            self.i = start
        self.conditional()

    # declarations

    def parameters(self) -> None:
        self.need("(")
        while self.k[self.i] != ")":
            self.modifiers()
            self.type()
            self.annotations()
            self.take("...")
            if self.k[self.i] == "this":
                self.i += 1
            else:
                self.name()
                if self.k[self.i] == "." and self.k[self.i + 1] == "this":
                    self.i += 2
            self.brackets()
            if not self.take(","):
                break
        self.need(")")

    def type_declaration(self) -> None:
        self.modifiers()
        if self.take("class"):
            self.need("N")
            self.type_parameters()
            if self.take("extends"):
                self.type()
            self.supers("implements")
        elif self.take("interface"):
            self.need("N")
            self.type_parameters()
            self.supers("extends")
        elif self.take("enum"):
            self.need("N")
            self.supers("implements")
            self.enum_body()
            return
        elif self.take("@"):
            self.need("interface")
            self.need("N")
        elif self.is_word("record"):
            self.i += 1
            self.need("N")
            self.type_parameters()
            self.parameters()
            self.supers("implements")
        else:
            self.fail("expected a type declaration")
        self.class_body()

    def supers(self, word: str) -> None:
        if self.take(word):
            self.type()
            while self.take(","):
                self.type()
        if self.is_word("permits"):
            self.i += 1
            self.type()
            while self.take(","):
                self.type()

    def enum_body(self) -> None:
        self.need("{")
        while self.k[self.i] in ("N", "@"):
            self.annotations()
            self.need("N")
            if self.k[self.i] == "(":
                self.arguments()
            if self.k[self.i] == "{":
                self.class_body()
            if not self.take(","):
                break
        if self.take(";"):
            self.members()
        self.need("}")

    def class_body(self) -> None:
        self.need("{")
        self.members()
        self.need("}")

    def members(self) -> None:
        while self.k[self.i] and self.k[self.i] != "}":
            start = self.i
            try:
                self.member()
            except Wrong as w:
                if not self.k[self.i]:
                    raise
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                self.skip_balanced(OPEN, STOP)
                self.take(";")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.k[self.i] == "{" or self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.take("static")
            self.block()
            return
        if self.type_declaration_ahead():
            self.type_declaration()
            return
        self.modifiers()
        if self.type_declaration_ahead():
            self.type_declaration()
            return
        self.type_parameters()
        self.annotations()
        if self.k[self.i] == "N" and self.k[self.i + 1] in ("(", "{"):
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        self.type(True)
        if self.k[self.i + 1] == "(":
            self.need("N")
            self.parameters()
            self.brackets()
            self.throws()
            if self.take("default"):
                self.value()
            if not self.take(";"):
                self.block()
            return
        self.variables()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()

    def module_ahead(self) -> bool:
        """Whether the declaration of a module stands here."""
        k = 1 if self.is_word("open") else 0
        return self.is_word("module", k) and self.k[self.i + k + 1] == "N" and self.k[self.i + k + 2] in (".", "{")

    def module(self) -> None:
        self.i += 2 if self.is_word("open") else 1
        self.dotted()
        self.need("{")
        while not self.take("}"):
            word = next((w for w in ("requires", "exports", "opens", "uses", "provides") if self.is_word(w)), "")
            if not word:
                self.fail("expected a directive of a module")
            self.i += 1
            while word == "requires" and (self.k[self.i] == "static" or self.is_word("transitive") and self.k[self.i + 1] in ("N", "static")):
                self.i += 1
            self.dotted()
            if word in ("exports", "opens") and self.is_word("to") or word == "provides":
                if not self.is_word("to" if word != "provides" else "with"):
                    self.fail("expected 'with'")
                self.i += 1
                self.dotted()
                while self.take(","):
                    self.dotted()
            self.need(";")

    def file(self) -> list[Wrong]:
        try:
            start = self.i
            if self.k[self.i] == "@":
                self.annotations()
                if self.k[self.i] != "package":
                    self.i = start
            if self.take("package"):
                self.dotted()
                self.need(";")
        except Wrong as w:
            self.errors.append(w)
        loose, main = None, False  # members outside of any type make a class of their own if 'main' is among them
        while self.k[self.i]:
            start = self.i
            try:
                if self.take(";"):
                    continue
                if self.k[self.i] == "@" and self.k[self.i + 1] != "interface":
                    self.annotations()
                    if not self.module_ahead():
                        self.i = start
                if self.module_ahead():
                    self.module()
                elif self.take("import"):
                    self.take("static")
                    if self.is_word("module") and self.k[self.i + 1] == "N":
                        self.i += 1
                    self.dotted()
                    if self.take("."):
                        self.need("*")
                    self.need(";")
                elif self.type_declaration_ahead():
                    self.type_declaration()
                else:
                    self.modifiers()
                    declared = self.type_declaration_ahead()
                    self.i = start
                    if declared or self.k[start] == "}":
                        self.type_declaration()
                    else:
                        self.member()
                        loose = start if loose is None else loose
                        main = main or any(self.is_word("main", k - self.i) and self.k[k + 1] == "(" for k in range(start, self.i))
            except Wrong as w:
                self.errors.append(w)
                self.i = max(self.i, start + 1)
                while self.k[self.i] and not self.type_declaration_ahead():
                    self.i += 1
            except RecursionError:
                self.errors.append(Wrong(0, "nested too deeply"))
                break
        if loose is not None and not main:
            self.errors.append(Wrong(self.at[loose], "a member outside of any type"))
        return sorted(self.errors, key=lambda w: w.at)


def parse(text: str) -> list[Wrong]:
    return Java(text.lstrip("﻿")).file()
