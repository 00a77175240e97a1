"""From a regular expression to the trigrams that every match must contain.

A query is a set of clauses, each a set of trigrams: a text can match only if it has
all trigrams of some clause. The clause without trigrams stands for "any text".
Everything is folded to lower case, as the index is.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

ANY = frozenset([frozenset()])
_MOST = 64  # strings or clauses followed at a time; beyond that less is required


def _simplified(clauses) -> frozenset:
    """Without clauses that ask for more than another one does."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > _MOST:
        return a if b == ANY or (a != ANY and len(a) <= len(b)) else b
    return _simplified(x | y for x, y in product(a, b))


def _of_strings(strings: set[str]) -> frozenset:
    return _simplified(
        frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings
    )


def _characters(items) -> set[str] | None:
    """The characters of a small class, None for a large or negated one."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < _MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(items) -> tuple[set[str] | None, frozenset]:
    """The exact strings a sequence matches, if few, and its query."""
    query, exact, whole = ANY, {""}, True
    for kind, value in items:
        strings, part = _element(kind, value)
        if strings is not None and len(strings) * len(exact) <= _MOST:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        query, whole = _both(_both(query, _of_strings(exact)), part), False
        exact = strings if strings is not None else {""}
    query = _both(query, _of_strings(exact))
    return (exact if whole else None), query


def _element(kind, value) -> tuple[set[str] | None, frozenset]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.IN:
        return _characters(value), ANY
    if kind is op.SUBPATTERN:
        return _walk(value[-1])
    if kind is op.BRANCH:
        parts = [_walk(p) for p in value[1]]
        exact = (
            set().union(*[s for s, _ in parts]) if all(s is not None for s, _ in parts) else None
        )
        return exact, _simplified(c for _, q in parts for c in q)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        exact, query = _walk(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        if low == high and exact is not None and len(exact) ** low <= _MOST:
            return {"".join(p) for p in product(exact, repeat=low)}, query if low else ANY
        return None, query if low else ANY
    return ({""}, ANY) if kind is op.AT else (None, ANY)


def trigram_query(pattern: str) -> frozenset:
    """Clauses of trigrams, one of which every match of the pattern contains in full."""
    return _walk(parser.parse(pattern))[1]
