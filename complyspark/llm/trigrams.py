"""Boolean trigram queries of regular expressions.

A query is a list of alternatives, each a set of lower-case trigrams that every
match of the expression holds (in lower case); None: no trigram is mandatory."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from itertools import product

EXACT = 64
"""Strings that one part of an expression may stand for while they are listed one by one."""
CLASS = 8
"""Characters of a class that are still listed one by one."""

Query = list[frozenset[str]] | None


def _of_strings(strings: set[str]) -> Query:
    out = []
    for s in sorted(strings):
        grams = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        if not grams:
            return None
        out.append(grams)
    return _simplify(out)


def _simplify(alternatives: list[frozenset[str]]) -> Query:
    """Alternatives that ask for more than another one are no use."""
    return [a for a in dict.fromkeys(alternatives) if not any(b < a for b in alternatives)]


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > EXACT:
        return min(a, b, key=len)
    return _simplify([x | y for x in a for y in b])


def _or(parts: list[Query]) -> Query:
    out: list[frozenset[str]] = []
    for p in parts:
        if p is None:
            return None
        out += p
    return _simplify(out)


def _class(items: list) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < CLASS:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= CLASS else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings the nodes stand for, or None; their query)."""
    query: Query = None
    run: set[str] = {""}
    exact = True

    def flush() -> None:
        nonlocal query, run
        query, run = _and(query, _of_strings(run)), {""}

    for op, arg in nodes:
        inner: Query = None
        strings: set[str] | None
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _class(arg)
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            inner = _or([p[1] if p[0] is None else _of_strings(p[0]) for p in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, sub = arg
            strings, inner = _walk(sub)
            if strings is not None and (least, most) == (0, 1):
                strings = strings | {""}
            elif not (strings is not None and least == most == 1):
                inner = (inner if strings is None else _of_strings(strings)) if least else None
                strings = None
        elif op is sre.AT:
            continue
        else:
            strings = None
        if strings is not None and len(run) * len(strings) <= EXACT:
            run = {a + b for a, b in product(run, strings)}
            continue
        if strings is not None:
            flush()
            run, exact = set(strings), False
            continue
        flush()
        exact = False
        query = _and(query, inner)
    if exact:
        return run, None
    flush()
    return None, query


def trigram_query(pattern: str) -> Query:
    strings, query = _walk(sre_parse.parse(pattern))
    return _of_strings(strings) if strings is not None else query
