"""Patterns of secrets and the Boolean trigram query that each pattern implies."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

MOST_STRINGS = 64
MOST_CHARACTERS = 8

# A query is a trigram, ("and", parts) or ("or", parts); an empty "and" holds for every text.
Trigrams = str | tuple[str, tuple]
ANYTHING: Trigrams = ("and", ())


@dataclass(frozen=True)
class SecretRule:
    """`pattern` finds candidates; `check(match)` confirms one. Flags are ASCII, so only A-Z and a-z fold."""

    kind: str
    pattern: str
    check: Callable[[re.Match], bool] = lambda match: True
    any_case: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The first three are those of the contract; the others are the published forms of well-known tokens.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               lambda m: len(m[2]) >= 6, any_case=True, base=True),
    SecretRule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, base=True),
    SecretRule("hex", r"[0-9a-f]{24,}", base=True),  # a greedy run of 24 or more: shorter runs would be dropped anyway
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _all_of(parts: list[Trigrams]) -> Trigrams:
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any_of(parts: list[Trigrams]) -> Trigrams:
    parts = list(dict.fromkeys(parts))
    if ANYTHING in parts:
        return ANYTHING
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _in_strings(strings: set[str]) -> Trigrams:
    """What a text contains if it contains one of these strings; trigrams are lower case."""
    # trigrams are those of UTF-8 bytes, kept as text of one character per byte
    encoded = [s.encode().lower().decode("latin-1") for s in strings]
    return _any_of([_all_of([s[i:i + 3] for i in range(len(s) - 2)]) for s in encoded])


def _walk(nodes) -> tuple[set[str] | None, Trigrams]:
    """The strings a sequence can match, if they are few, and what any text matching it must contain."""
    held, needed, whole = {""}, [], True

    def cut() -> None:
        nonlocal held, whole
        needed.append(_in_strings(held))
        held, whole = {""}, False

    for op, value in nodes:
        strings, query = _node(op, value)
        if strings is None:
            cut()
            needed.append(query)
        elif len(held) * len(strings) > MOST_STRINGS:
            cut()
            held = strings
        else:
            held = {a + b for a, b in product(held, strings)}
    if whole:
        return held, _in_strings(held)
    needed.append(_in_strings(held))
    return None, _all_of(needed)


def _node(op, value) -> tuple[set[str] | None, Trigrams]:
    if op is sre.LITERAL:
        return {chr(value)}, ANYTHING
    if op is sre.IN:
        chars = set()
        for kind, what in value:
            if kind is sre.LITERAL:
                chars.add(chr(what))
            elif kind is sre.RANGE and what[1] - what[0] < MOST_CHARACTERS:
                chars |= {chr(c) for c in range(what[0], what[1] + 1)}
            else:
                return None, ANYTHING
        return (chars, ANYTHING) if len(chars) <= MOST_CHARACTERS else (None, ANYTHING)
    if op is sre.SUBPATTERN:
        return _walk(value[3])
    if op is sre.BRANCH:
        branches = [_walk(b) for b in value[1]]
        if all(strings is not None for strings, _ in branches):
            together = set().union(*[strings for strings, _ in branches])
            if len(together) <= MOST_STRINGS:
                return together, _in_strings(together)
        return None, _any_of([query for _, query in branches])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _walk(inner)
        if least == 0 and most == 1 and strings is not None:
            return strings | {""}, ANYTHING
        return None, query if least else ANYTHING
    if op is sre.AT:
        return {""}, ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Trigrams:
    """The Boolean query over lower-case trigrams that every text with a match satisfies.

    Sequences of literals, small classes, options and alternatives are multiplied out to strings; their trigrams
    are joined by "and" within a string and by "or" between strings. Anything else separates strings.
    """
    return _walk(_parser.parse(pattern))[1]


def trigrams_in(query: Trigrams) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*[trigrams_in(p) for p in query[1]]) if query[1] else set()
