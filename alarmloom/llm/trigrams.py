"""Boolean trigram queries of regular expressions.

``trigram_query`` reads a pattern and says which trigrams every text with a match must
hold, in lower case. Each part of a pattern is known by the whole strings it can
match, as long as these are few, or else by the strings it can begin and end with, and by
conditions that hold whatever it matches. Where parts meet, the ends of one and the
beginnings of the next give trigrams that lie across.

Patterns may use literals, escapes, classes, groups, alternatives, repeats and flags
at the start; of any other construct (look-around, back-references) nothing is
claimed but that it stands in the way of trigrams across it.

A condition is a set of alternatives, each a set of trigrams that must all be there. The
set with one empty alternative claims nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

Condition = frozenset[frozenset[str]]
ANYTHING: Condition = frozenset({frozenset()})
#: More strings or alternatives than these are given up for a weaker claim.
MOST_STRINGS, MOST_ALTERNATIVES, MOST_CLASS = 32, 64, 8
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\x0b", "a": "\x07"}


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def both(a: Condition, b: Condition) -> Condition:
    """Both hold; of alternatives that hold whenever another does, the weaker stays."""
    if a == ANYTHING or b == ANYTHING:
        return b if a == ANYTHING else a
    joined = weakest({x | y for x in a for y in b})
    return joined if len(joined) <= MOST_ALTERNATIVES else min(a, b, key=len)


def either(a: Condition, b: Condition) -> Condition:
    joined = weakest(a | b)
    return joined if len(joined) <= MOST_ALTERNATIVES else ANYTHING


def weakest(alternatives) -> Condition:
    return frozenset(x for x in alternatives if not any(y < x for y in alternatives))


def one_of(strings: frozenset[str]) -> Condition:
    """One of the strings is there, so all of its trigrams."""
    return weakest({trigrams(s) for s in strings})


@dataclass(frozen=True)
class Known:
    """What is known of a part: ``exact`` strings (None: too many), what it begins and ends with, and a condition."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    condition: Condition = ANYTHING

    def weakened(self) -> Known:
        """Without exact strings: these give the condition, and their ends remain."""
        if self.exact is None:
            return self
        begins, ends = shortened(self.exact, lambda s, n: s[:n]), shortened(self.exact, lambda s, n: s[-n:] if n else "")
        return Known(None, begins, ends, both(self.condition, one_of(self.exact)))


def shortened(strings: frozenset[str], cut) -> frozenset[str]:
    """Beginnings or ends of at most two characters, fewer if there are too many of them."""
    return next(c for n in (2, 1, 0) if len(c := frozenset(cut(s, n) for s in strings)) <= MOST_STRINGS)


UNKNOWN = Known(None, frozenset({""}), frozenset({""}))


def text(*strings: str) -> Known:
    """Lower-cased strings; of characters beyond ASCII, whose cases depend on what stands around them, nothing is claimed."""
    if not all(s.isascii() for s in strings):
        return UNKNOWN
    found = frozenset(s.lower() for s in strings)
    return Known(found, found, found)


EMPTY = text("")


def followed(a: Known, b: Known) -> Known:
    """``a`` and then ``b``."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return text(*(x + y for x, y in product(a.exact, b.exact)))
    wide_a, wide_b = a.weakened(), b.weakened()
    across = frozenset(x + y for x, y in product(a.exact or wide_a.ends, b.exact or wide_b.begins)) if len(a.exact or wide_a.ends) * len(b.exact or wide_b.begins) <= MOST_STRINGS**2 else frozenset({""})
    begins = wide_a.begins if a.exact is None else shortened(frozenset(x + y for x, y in product(a.exact, wide_b.begins)), lambda s, n: s[:n])
    ends = wide_b.ends if b.exact is None else shortened(frozenset(x + y for x, y in product(wide_a.ends, b.exact)), lambda s, n: s[-n:] if n else "")
    return Known(None, begins, ends, both(both(wide_a.condition, wide_b.condition), one_of(across)))


def alternatives(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return text(*(a.exact | b.exact))
    a, b = a.weakened(), b.weakened()
    begins = shortened(a.begins | b.begins, lambda s, n: s[:n])
    ends = shortened(a.ends | b.ends, lambda s, n: s[-n:] if n else "")
    return Known(None, begins, ends, either(a.condition, b.condition))


def repeated(a: Known, least: int, most: int | None) -> Known:
    """``a`` from ``least`` to ``most`` times (None: any number)."""
    if most == 0:
        return EMPTY
    out = EMPTY
    for _ in range(min(least, 3)):  # three in a row say what more of them would
        out = followed(out, a)
    if most is not None and most <= 3:
        for _ in range(most - least):
            out = alternatives(out, followed(out, a))
        return out
    if most == least:
        return out if least <= 3 else Known(None, out.weakened().begins, out.weakened().ends, out.weakened().condition)
    if not least:
        return UNKNOWN
    wide, one = out.weakened(), a.weakened()
    # more of them may stand between the first and the last
    return Known(None, wide.begins if least > 1 else one.begins, wide.ends if least > 1 else one.ends, wide.condition)


class Reader:
    """Reads a pattern from left to right."""

    def __init__(self, pattern: str):
        re.compile(pattern)  # a pattern that is none raises here
        flags = re.match(r"\(\?[aimsux]+\)", pattern)
        if flags and "x" in flags[0]:
            raise ValueError("patterns in verbose form are not read")
        self.pattern, self.at = pattern, flags.end() if flags else 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.pattern[self.at - n : self.at]

    def choice(self) -> Known:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = alternatives(out, self.sequence())
        return out

    def sequence(self) -> Known:
        out = EMPTY
        while self.peek() not in ("", "|", ")"):
            out = followed(out, self.counted(self.atom()))
        return out

    def counted(self, a: Known) -> Known:
        found = re.compile(r"(?:([*+?])|\{(\d+)(,?)(\d*)\})[?+]?").match(self.pattern, self.at)
        if not found:
            return a
        sign, low, comma, high = found.groups()
        self.at = found.end()
        if sign:
            return repeated(a, int(sign == "+"), 1 if sign == "?" else None)
        return repeated(a, int(low), int(high) if high else None if comma else int(low))

    def atom(self) -> Known:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.one_class()
        if c == "\\":
            return self.escape()
        if c in "^$":
            return EMPTY
        return UNKNOWN if c == "." else text(c)

    def group(self) -> Known:
        look = False
        if self.peek() == "?":
            found = re.compile(r"\?(?:P<\w+>|<\w+>|[:>]|<?[=!])").match(self.pattern, self.at)
            if not found:
                raise ValueError(f"the group at {self.at} of {self.pattern!r} is not read")
            self.at, look = found.end(), found[0][-1] in "=!"
        inside = self.choice()
        self.take()
        # what is looked at is no part of the match, and nothing across it is claimed
        return UNKNOWN if look else inside

    def escape(self) -> Known:
        c = self.take()
        if c == "x":
            return text(chr(int(self.take(2), 16)))
        if c == "u":
            return text(chr(int(self.take(4), 16)))
        if c in ESCAPES:
            return text(ESCAPES[c])
        if c in "bBAZz":
            return EMPTY
        return UNKNOWN if c.isalnum() else text(c)

    def one_class(self) -> Known:
        """Any character of a class: the characters themselves if they are few."""
        inverted = self.peek() == "^"
        if inverted:
            self.take()
        chars: set[str] | None = set()
        first = True
        while first or self.peek() != "]":
            first = False
            low = self.class_character()
            if low is None or chars is None:
                chars = None
                continue
            high = low
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.class_character()
            if high is None or ord(high) - ord(low) > 64:
                chars = None
            else:
                chars |= {chr(x) for x in range(ord(low), ord(high) + 1)}
        self.take()
        return UNKNOWN if inverted or chars is None or len(chars) > MOST_CLASS else text(*chars)

    def class_character(self) -> str | None:
        """The next character of a class; None for a class within it."""
        c = self.take()
        if c != "\\":
            return c
        c = self.take()
        if c in "xu":
            return chr(int(self.take(2 if c == "x" else 4), 16))
        return ESCAPES.get(c, None if c.isalnum() else c)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which lies whole in each text that matches; None if nothing is sure."""
    reader = Reader(pattern)
    found = reader.choice()
    if reader.at != len(pattern):
        raise ValueError(f"{pattern!r} is not read beyond {reader.at}")
    condition = found.weakened().condition
    return None if frozenset() in condition else sorted(condition, key=sorted)
