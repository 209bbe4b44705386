"""Boolean trigram queries of regular expressions.

A query is a set of alternatives, each a set of trigrams that a matching text must contain;
`ANY` (one alternative without trigrams) is what every text fulfils. Trigrams are lower-case,
so they hold for texts in either case.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Beyond so many strings, or alternatives, a part of the pattern counts as unknown.
MOST = 64


def either(a: Query, b: Query) -> Query:
    """Alternatives that ask for more than another one add nothing."""
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def all_of(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    return either(out, out) if len(out) <= MOST else a


def _of_strings(strings: set[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = either(out, frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]))
    return out


def _item(op, arg) -> tuple[set[str] | None, Query]:
    """The strings that a part stands for, if they are few, else its query."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, ANY
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANY
        query: Query = frozenset()
        for strings, own in parts:
            query = either(query, own if strings is None else _of_strings(strings))
        return None, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if most == 1 and strings is not None:
            return strings | ({""} if least == 0 else set()), ANY
        if least == 0:
            return None, ANY
        return None, query if strings is None else _of_strings(strings)
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ANY, True
    for op, arg in items:
        more, own = _item(op, arg)
        if more is not None and len(strings) * len(more) <= MOST:
            strings = {a + b for a in strings for b in more}
            continue
        whole = False
        query = all_of(all_of(query, _of_strings(strings)), own)
        strings = more if more is not None else {""}
    if whole:
        return strings, ANY
    return None, all_of(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)
