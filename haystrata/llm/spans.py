"""Spans of text: their digest columns, and pattern searches whose time is linear in the text."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

Span = tuple[str, int, int]  # kind, begin, end in code points, end exclusive


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Taken:
    """Disjoint stretches of a text in order; whether a further one meets any of them takes a binary search."""

    def __init__(self, spans: list[Span] = ()):
        self.parts: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.parts and a < self.parts[-1][1]:
                self.parts[-1] = (self.parts[-1][0], max(b, self.parts[-1][1]))
            else:
                self.parts.append((a, b))

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.parts, (b,)) - 1  # the last that begins before b
        return i >= 0 and self.parts[i][1] > a

    def add(self, a: int, b: int) -> None:
        """Takes a stretch that meets none."""
        insort(self.parts, (a, b))


_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ sign."""
    last = 0
    for m in _AT.finditer(text) if "@" in text else ():
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            last = m.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers with parts of 255 at most: every dotted run is cut into fours."""
    for m in _DOTTED.finditer(text):
        parts, a = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(q) <= 3 and int(q or "0") <= 255 for q in (p.lstrip("0") for p in four)):
                yield a, b
            a = b + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digit_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost matches of [0-9]([\\x20-]?[0-9])+ with their digits."""
    for m in _DIGITS.finditer(text):
        yield m.start(), m.end(), m[0].replace(" ", "").replace("-", "")


def phones(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost matches of \\+[0-9][\\x20().0-9-]+[0-9] with their digits."""
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            b = m.end()
            while b > at + 2 and not "0" <= text[b - 1] <= "9":
                b -= 1
            if b > at + 3:
                yield at, b, "".join(c for c in text[at:b] if "0" <= c <= "9")
                at = text.find("+", b)
                continue
        at = text.find("+", at + 1)
