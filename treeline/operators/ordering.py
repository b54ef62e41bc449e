"""Sorting with explicit places for nulls, and keyset paging in any mix of directions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.operators.predicates import Typed, literal
from treeline.plans.wire import Sort


def sorted_by(order: list[Sort], column: Callable[[str], Typed]) -> list[Column]:
    out = []
    for s in order:
        c, _ = column(s.field)
        if s.descending:
            out.append(c.desc_nulls_first() if s.nulls_first else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_first() if s.nulls_first else c.asc_nulls_last())
    return out


def follows(order: list[Sort], values: list[Any], column: Callable[[str], Typed]) -> Column:
    """True for rows after the row that has ``values``: for some key later, for all keys before it the same.

    Where the first key alone can rule rows out, that is said as well, in a form that scans can use.
    """
    out, same = F.lit(False), F.lit(True)
    for s, v in zip(order, values, strict=True):
        c, kind = column(s.field)
        if v is None:
            later = c.isNotNull() if s.nulls_first else F.lit(False)
            equal = c.isNull()
        else:
            other = literal(v, kind)
            later = c < other if s.descending else c > other
            if not s.nulls_first:
                later = later | c.isNull()
            equal = c.eqNullSafe(other)
        out = out | (same & later)
        same = same & equal
    first, v = order[0], values[0]
    if v is not None:
        c, kind = column(first.field)
        bound = c <= literal(v, kind) if first.descending else c >= literal(v, kind)
        out = out & (bound if first.nulls_first else bound | c.isNull())
    return out
