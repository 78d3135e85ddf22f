"""What the parsers share: the token stream, expectations and panic-mode recovery."""

from __future__ import annotations

import sys
from collections.abc import Callable

#: Calls within calls that a parser may make: some 100,000 levels of nesting, for which it takes less than 200 MB (calls among Python functions don't use
#: the process's stack). Go's compiler refuses more than 100,000 levels by itself, those of JavaScript and Java overflow far earlier. Fixed value.
MOST_CALLS = 1_000_000

#: How many ends stand behind the last token, so that parsers may look ahead anywhere.
LOOK = 8


class Wrong(Exception):
    """The text isn't valid at an offset."""

    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


class Parser:
    """A stream of token kinds. A keyword's or operator's kind is its own text; 'N' a name, '0' a number, 'S' a string, '' the end."""

    def __init__(self, kinds: list[str], starts: list[int], errors: list[Wrong]):
        self.k, self.at, self.i, self.errors = kinds, starts, 0, errors

    def fail(self, why: str = "") -> None:
        kind = self.k[self.i]
        raise Wrong(self.at[self.i], why or f"unexpected {'end of text' if not kind else kind!r}")

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind!r}, found {self.k[self.i] or 'end of text'!r}")
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def skip_balanced(self, opening: dict[str, str], stop: frozenset[str]) -> None:
        """Panic mode: pass over tokens until one of ``stop`` outside of any bracket that opens on the way."""
        depth = 0
        closing = frozenset(opening.values())
        while self.k[self.i]:
            kind = self.k[self.i]
            if depth == 0 and kind in stop:
                return
            if kind in opening:
                depth += 1
            elif kind in closing:
                depth = max(0, depth - 1)
            self.i += 1


def deep(parse: Callable[[str], list[Wrong]]) -> Callable[[str], list[Wrong]]:
    """``parse`` with room for texts as deeply nested as MOST_CALLS allows; deeper ones are invalid, 'nested too deeply'."""

    def parse_deep(text: str) -> list[Wrong]:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, MOST_CALLS))
        try:
            return parse(text)
        finally:
            sys.setrecursionlimit(before)

    return parse_deep
