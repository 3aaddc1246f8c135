"""Literals that every match of an expression has: what to look for before the expression is tried."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as ops
from re import _parser as syntax
from typing import Any

FLAGS = re.IGNORECASE | re.ASCII
#: Shortest literal that is worth looking for.
LEAST = 3


def literals(pattern: str, least: int = LEAST) -> frozenset[str] | None:
    """Literals in lower case, at least one of which is in the lower-cased text of any match; None if none of `least` characters are known."""

    def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
        worth = lambda x: (min(map(len, x)), -len(x)) if x else (0, 0)
        return max(a, b, key=worth)

    def of(items: Iterable[tuple[Any, Any]]) -> frozenset[str] | None:
        best: frozenset[str] | None = None
        run: list[str] = []

        def closed() -> frozenset[str] | None:
            text = "".join(run).lower()
            run.clear()
            return better(best, frozenset([text])) if text else best

        for op, arg in items:
            if op is ops.LITERAL and arg < 128:
                run.append(chr(arg))
                continue
            best = closed()
            found = None
            if op is ops.SUBPATTERN:
                found = of(arg[3])
            elif op is ops.ATOMIC_GROUP:
                found = of(arg)
            elif op is ops.BRANCH:
                every = [of(x) for x in arg[1]]
                found = frozenset().union(*every) if all(every) else None
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
                found = of(arg[2])
            best = better(best, found)
        return closed()

    found = of(syntax.parse(pattern, FLAGS))
    return found if found and min(map(len, found)) >= least else None
