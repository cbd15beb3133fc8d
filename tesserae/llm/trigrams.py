"""Boolean trigram queries derived from regular expressions.

``trigram_query(pattern)`` returns clauses: any text that the pattern matches has,
in lower case, all trigrams of at least one clause.  None: the pattern demands no
trigram, so every text must be scanned.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

#: Strings kept for a piece of the pattern, and clauses of a query, before the derivation gives up on that piece.
MAX_STRINGS = 64
#: A literal's trigrams asked for: its ends and its middle. Fewer trigrams admit more candidates, never fewer.
PER_LITERAL = 3


def _class(items) -> list[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return sorted(out) if len(out) <= 8 else None


def _trigrams(text: str) -> frozenset[str]:
    found = [text[k : k + 3] for k in range(len(text) - 2)]
    if len(found) > PER_LITERAL:
        found = [found[0], found[len(found) // 2], found[-1]]
    return frozenset(found)


def _and(a: set[frozenset[str]] | None, b: set[frozenset[str]] | None) -> set[frozenset[str]] | None:
    if a is None or b is None:
        return b if a is None else a
    joined = {x | y for x in a for y in b}
    return joined if len(joined) <= MAX_STRINGS else min(a, b, key=len)


def _walk(items) -> tuple[set[str] | None, set[frozenset[str]] | None]:
    """(the strings that this part can be, or None for too many; clauses that hold besides)."""
    now: set[str] = {""}
    clauses: set[frozenset[str]] | None = None

    def flush() -> None:
        nonlocal now, clauses
        if now and all(len(x) >= 3 for x in now):
            clauses = _and(clauses, {_trigrams(x) for x in now})
        now = {""}

    whole = True
    for kind, value in items:
        strings: set[str] | None = None
        inner: set[frozenset[str]] | None = None
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = set(found) if (found := _class(value)) else None
        elif kind is op.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif kind is op.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in parts):
                strings = {x for s, _ in parts for x in s}
            else:
                each = [_and({_trigrams(x) for x in s} if s and all(len(x) >= 3 for x in s) else None, c) for s, c in parts]
                inner = None if any(c is None for c in each) else {x for c in each for x in c}
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            s, c = _walk(body)
            if low == 0 and high == 1 and s is not None:
                strings = s | {""}
            elif low >= 1:
                inner = c
                if s is not None and low == high and len(s) ** low <= MAX_STRINGS:
                    strings = {""}
                    for _ in range(low):
                        strings = {x + y for x in strings for y in s}
                elif s is not None and len(s) == 1 and low >= 3:
                    inner = _and(inner, {_trigrams("".join(s) * 3)})
        elif kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
            strings = {""}
        clauses = _and(clauses, inner)
        if strings is not None and len(now) * len(strings) <= MAX_STRINGS:
            now = {x + y for x in now for y in strings}
        else:
            flush()
            whole = False
            if strings is not None and len(strings) <= MAX_STRINGS:
                now = set(strings)
    if whole:
        return now, clauses
    flush()
    return None, clauses


def trigram_query(pattern: str) -> list[list[str]] | None:
    strings, clauses = _walk(parser.parse(pattern))
    if strings is not None and all(len(x) >= 3 for x in strings):
        clauses = _and(clauses, {_trigrams(x) for x in strings})
    return None if not clauses else sorted(sorted(x) for x in clauses)
