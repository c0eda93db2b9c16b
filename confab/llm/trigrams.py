"""Boolean trigram queries derived from regular expressions.

``query(pattern)`` returns a disjunction of trigram sets: a text that matches holds every
trigram of at least one set (letter case folded).  ``None`` means that no trigram is
mandatory, so such a rule scans every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

#: Sets of strings larger than this are given up (a condition is dropped, never invented).
MOST = 64
_ANY = frozenset({frozenset()})


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(q: frozenset) -> frozenset:
    """Absorption: a set that holds another one adds nothing to the disjunction."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(p: frozenset, q: frozenset) -> frozenset:
    """Both conditions; where their product grows too large, the more selective one alone."""
    if len(p) * len(q) > MOST:
        return min(p, q, key=lambda x: (x == _ANY, len(x)))
    return _least(frozenset(a | b for a in p for b in q))


def _of_strings(strings: set[str]) -> frozenset:
    return _least(frozenset(trigrams(s) for s in strings))


def _strings(op, arg) -> set[str] | None:
    """All strings of a node, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 4:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is sre.BRANCH:
        parts = [_sequence(b)[0] for b in arg[1]]
        out = set().union(*(p for p in parts if p is not None))
        return out if all(p is not None for p in parts) and len(out) <= MOST else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        if high == sre.MAXREPEAT or high > 4:
            return None
        once = _sequence(body)[0]
        if once is None:
            return None
        out, power = set(), {""}
        for k in range(int(high) + 1):
            out |= power if k >= low else set()
            power = {a + b for a in power for b in once}
            if len(power) > MOST:
                return None
        return out
    if op is sre.AT:
        return {""}
    return None


def _condition(op, arg) -> frozenset:
    """What a node without a short list of strings demands."""
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is sre.BRANCH:
        return _least(frozenset().union(*(_sequence(b)[1] for b in arg[1])))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _sequence(arg[2])[1]
    return _ANY


def _sequence(nodes) -> tuple[set[str] | None, frozenset]:
    """(all strings if few, condition) of a concatenation."""
    exact, run, need = True, {""}, _ANY
    for op, arg in nodes:
        strings = _strings(op, arg)
        joined = {a + b for a in run for b in strings} if strings is not None and len(run) * len(strings) <= MOST else None
        if joined is not None:
            run = joined
            continue
        exact, need = False, _both(need, _of_strings(run))
        run = {""} if strings is None else strings
        if strings is None:
            need = _both(need, _condition(op, arg))
    need = _both(need, _of_strings(run))
    return (run if exact else None), need


def query(pattern: str) -> list[frozenset[str]] | None:
    need = _sequence(parser.parse(pattern))[1]
    return None if frozenset() in need else sorted(need, key=sorted)
