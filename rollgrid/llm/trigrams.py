"""Boolean trigram queries from regular expressions.

A query is a disjunction of conjunctions: any text that the expression matches
holds, in lower case, every trigram of at least one of them. The empty
conjunction asks for nothing, so an expression that has it must be tried on
every text.
"""

from __future__ import annotations

from itertools import product
from re import _constants as c
from re import _parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])

#: Strings that are tracked exactly at a time, and conjunctions of a query.
MOST = 64


def _tidy(query: Query) -> Query:
    """Without conjunctions that another one implies; beyond MOST, no demand at all."""
    kept = frozenset(q for q in query if not any(p < q for p in query))
    return kept if len(kept) <= MOST else ANY


def _both(a: Query, b: Query) -> Query:
    return _tidy(frozenset(x | y for x, y in product(a, b)))


def _of_strings(strings: frozenset[str]) -> Query:
    return _tidy(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _class_members(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < MOST:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > 4:  # wide classes demand nothing
            return None
    return frozenset(out)


def _walk(nodes: list) -> tuple[frozenset[str] | None, Query]:
    """The strings that a sequence matches, if few, else None; and its query."""
    query: Query = ANY
    strings: frozenset[str] = frozenset([""])
    exact = True
    for op, arg in nodes:
        own: frozenset[str] | None = None
        demand: Query = ANY
        if op is c.LITERAL:
            own = frozenset([chr(arg).lower()])
        elif op is c.IN:
            own = _class_members(arg)
        elif op is c.SUBPATTERN:
            own, demand = _walk(arg[-1])
        elif op is c.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            own = frozenset().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            demand = _tidy(frozenset().union(*(p[1] if p[0] is None else _of_strings(p[0]) for p in parts)))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, inner = arg
            strings_in, demand_in = _walk(list(inner))
            if strings_in is not None and least == most == 1 or (least, most) == (0, 1) and strings_in is not None:
                own = strings_in | (frozenset([""]) if least == 0 else frozenset())
            elif least:
                demand = demand_in if strings_in is None else _of_strings(strings_in)
        elif op is c.AT:
            own = frozenset([""])
        joined = frozenset(a + b for a, b in product(strings, own)) if own is not None and len(own) * len(strings) <= MOST else None
        if joined is not None:
            strings = joined
            continue
        query = _both(query, _of_strings(strings))
        query = _both(query, demand if own is None else _of_strings(own))
        strings, exact = frozenset([""]), False
    if exact:
        return strings, ANY
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, without regard to case."""
    strings, query = _walk(list(_parser.parse(pattern)))
    return query if strings is None else _of_strings(strings)
