"""Two-valued predicates: a comparison with null is false, a negated one true.

Leaves are written so that a filter on them still reaches the scan: null already counts as false at the top of a filter
and under AND and OR, so only ``not_`` needs to fold it away.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def eq(a: str | Column, b) -> Column:
    """a == b; a list means membership."""
    return isin(a, b) if isinstance(b, (list, tuple, set)) else _col(a) == _value(b)


def ne(a: str | Column, b) -> Column:
    """a != b, true where either is null; a list means no membership."""
    if isinstance(b, (list, tuple, set)):
        return not_in(a, b)
    return (_col(a) != _value(b)) | _col(a).isNull() | _value(b).isNull()


def lt(a: str | Column, b) -> Column:
    return _col(a) < _value(b)


def le(a: str | Column, b) -> Column:
    return _col(a) <= _value(b)


def gt(a: str | Column, b) -> Column:
    return _col(a) > _value(b)


def ge(a: str | Column, b) -> Column:
    return _col(a) >= _value(b)


def isin(a: str | Column, values: Iterable) -> Column:
    """Membership in constants; null is never a member."""
    values = [v for v in values if v is not None]
    return _col(a).isin(values) if values else F.lit(False)


def not_in(a: str | Column, values: Iterable) -> Column:
    return not_(isin(a, values))


def isna(a: str | Column) -> Column:
    return _col(a).isNull()


def notna(a: str | Column) -> Column:
    return _col(a).isNotNull()


def between(a: str | Column, low, high, inclusive: str = "both") -> Column:
    """low to high; inclusive is both, neither, left or right."""
    if inclusive not in ("both", "neither", "left", "right"):
        raise ValueError(f"inclusive must be both, neither, left or right, not {inclusive!r}")
    c = _col(a)
    left = c >= low if inclusive in ("both", "left") else c > low
    return left & (c <= high if inclusive in ("both", "right") else c < high)


def _folded(a: str | Column, case: bool) -> Column:
    return _col(a) if case else F.lower(_col(a))


def _filled(test: Column, na: bool | None) -> Column:
    return test if na is None else F.coalesce(test, F.lit(na))


def contains(a: str | Column, pattern: str, case: bool = True, na: bool | None = None, regex: bool = True) -> Column:
    """Text search for alternatives parted by | that ^ and $ may anchor; other patterns are refused.

    With regex=False the pattern is one literal.
    """
    text, tests = _folded(a, case), []
    for part in pattern.split("|") if regex else [pattern]:
        start, end = regex and part.startswith("^"), regex and part.endswith("$")
        word = part[int(start) : len(part) - int(end)] if regex else part
        if regex and any(ch in r".^$*+?{}[]\()" for ch in word):
            raise ValueError(f"only literal alternatives with ^ and $ are supported, not {part!r}")
        word = word if case else word.lower()
        if start and end:
            tests.append(text == word)
        elif start:
            tests.append(text.startswith(word))
        elif end:
            tests.append(text.endswith(word))
        else:
            tests.append(text.contains(word))
    return _filled(reduce(Column.__or__, tests), na)


def startswith(a: str | Column, prefix: str, na: bool | None = None) -> Column:
    return _filled(_col(a).startswith(prefix), na)


def endswith(a: str | Column, suffix: str, na: bool | None = None) -> Column:
    return _filled(_col(a).endswith(suffix), na)


def and_(*tests: Column) -> Column:
    return reduce(Column.__and__, tests)


def or_(*tests: Column) -> Column:
    return reduce(Column.__or__, tests)


def not_(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def floordiv(a: str | Column, b) -> Column:
    """a // b rounded down; null for a divisor of zero."""
    return F.floor(F.try_divide(_col(a), _value(b)))


def mod(a: str | Column, b) -> Column:
    """Remainder with the divisor's sign; null for a divisor of zero."""
    return _col(a) - _value(b) * floordiv(a, b)


def power(a: str | Column, b) -> Column:
    return F.pow(_col(a), _value(b))
