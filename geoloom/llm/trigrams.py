"""Boolean trigram queries that a regular expression implies.

A query is a disjunction of conjunctions: a list of sets of trigrams, in lower case; a text that matches the expression has
all trigrams of at least one set. None stands for no requirement: the expression lacks mandatory trigrams.
"""

from __future__ import annotations

import re._constants as c
from re import _parser

MOST = 64


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(sets: set[frozenset[str]]) -> list[frozenset[str]]:
    """The sets that hold no other one: A or (A and B) is A."""
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _either(texts: set[str]) -> list[frozenset[str]] | None:
    sets = {_grams(t) for t in texts}
    return None if frozenset() in sets else _least(sets)


def _both(a, b):
    if a is None or b is None:
        return a if b is None else b
    out = _least({x | y for x in a for y in b})
    return out if len(out) <= MOST else a


def _walk(nodes) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """(all texts that match, or None if they are not few; the query)."""
    run, whole, query = {""}, True, None

    def flush():
        nonlocal run, whole, query
        query, run, whole = _both(query, _either(run)), {""}, False

    for op, arg in nodes:
        exact, needs = None, None
        if op is c.LITERAL:
            exact = {chr(arg).lower()}
        elif op is c.IN and all(k is c.LITERAL for k, _ in arg) and len(arg) <= 4:
            exact = {chr(v).lower() for _, v in arg}
        elif op is c.SUBPATTERN:
            exact, needs = _walk(arg[3])
        elif op is c.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            elif all(q is not None for _, q in parts):
                needs = sorted({s for _, q in parts for s in q}, key=sorted)
        elif op is c.MAX_REPEAT:
            low, high, inner = arg
            exact, needs = _walk(inner)
            if low == 0:
                exact, needs = (exact | {""} if exact is not None and high == 1 else None), None
            elif not (low == high == 1):
                if exact is not None and (longer := {x + y for x in run for y in exact}) and len(longer) <= MOST:
                    run = longer
                flush()
                if exact is not None:
                    run = set(exact)
                    flush()
                    continue
        elif op is c.AT:
            continue
        longer = {x + y for x in run for y in exact} if exact is not None else set()
        if exact is None or len(longer) > MOST:
            flush()
            query = _both(query, needs)
            if exact is not None:
                run = exact
        else:
            run = longer
    final = _both(query, _either(run))
    return (run if whole else None), final


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    return _walk(_parser.parse(regex))[1]
