"""The query language: keywords, a type signature, or both with a colon between.

``max: (Int, Int) => Int``, ``List[A] => Option[A]``, ``"to string": A => String``, ``create list``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.types import FUNCTION, TUPLE
from .errors import SyntaxProblem


@dataclass(frozen=True)
class Raw:
    """A type as written: names not yet resolved."""

    name: str
    args: tuple[Raw, ...] = ()

    def __str__(self) -> str:
        return self.name + (f"[{', '.join(map(str, self.args))}]" if self.args else "")


@dataclass(frozen=True)
class RawQuery:
    keywords: str = ""
    type: Raw | None = None


_TOKEN = re.compile(r"\s*(=>|[.,\[\]()]|(?:(?!=>[\s(])[^.,\[\]()\s])+)")
_KEYWORDS = re.compile(r'\s*(?:"([^"]*)"|([^:.,\[\]()]+?))\s*$')
_HEAD = re.compile(r'\s*(?:"([^"]*)"|([^:.,\[\]()"]*))\s*:\s+(?=\S)|\s*(?:"([^"]*)"|([^:.,\[\]()"]*)):\s*$')


class _Reader:
    def __init__(self, text: str):
        self.words, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxProblem(f"unexpected {text[at:]!r}")
            self.words.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def next(self, expected: str = "") -> str:
        word = self.peek()
        if not word or (expected and word != expected):
            raise SyntaxProblem(f"expected {expected or 'a type'!r}, found {word or 'the end'!r}")
        self.at += 1
        return word

    def type(self) -> Raw:
        """An operand, or a function from it; arrows group to the right."""
        empty = self.words[self.at : self.at + 2] == ["(", ")"]
        if empty:
            self.at += 2
            self.next("=>")
            return Raw(FUNCTION.format(0), (self.type(),))
        params, tuple_ = self.operand()
        if self.peek() != "=>":
            return params[0] if not tuple_ else Raw(TUPLE.format(len(params)), tuple(params))
        self.next("=>")
        return Raw(FUNCTION.format(len(params)), (*params, self.type()))

    def operand(self) -> tuple[list[Raw], bool]:
        """Types in parentheses (a tuple, or parameters before an arrow), or one simple type."""
        if self.peek() != "(":
            return [self.simple()], False
        self.next("(")
        inside = self.several()
        self.next(")")
        return inside, len(inside) > 1

    def several(self) -> list[Raw]:
        out = [self.type()]
        while self.peek() == ",":
            self.next()
            out.append(self.type())
        return out

    def simple(self) -> Raw:
        parts = [self.name()]
        while self.peek() == ".":
            self.next()
            parts.append(self.name())
        args: list[Raw] = []
        if self.peek() == "[":
            self.next()
            args = self.several()
            self.next("]")
        return Raw(".".join(parts), tuple(args))

    def name(self) -> str:
        word = self.next()
        if word in ("=>", ".", ",", "[", "]", "(", ")"):
            raise SyntaxProblem(f"expected a name, found {word!r}")
        return word


def read_type(text: str) -> Raw:
    reader = _Reader(text)
    out = reader.type()
    if reader.peek():
        raise SyntaxProblem(f"unexpected {reader.peek()!r}")
    return out


def parse(text: str) -> RawQuery:
    """Keywords with a type, else a type, else keywords."""
    head = _HEAD.match(text)
    if head and head.end() < len(text):
        return RawQuery((head[1] or head[2] or "").strip(), read_type(text[head.end() :]))
    try:
        return RawQuery("", read_type(text))
    except SyntaxProblem as problem:
        words = _KEYWORDS.match(text)
        if not words:
            raise problem
        return RawQuery((words[1] if words[1] is not None else words[2]).strip())
