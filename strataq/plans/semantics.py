"""Choices where engines differ: null logic, null order, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_valued(cond: Column) -> Column:
    """A comparison with null is false, so its negation is true."""
    return F.coalesce(cond, F.lit(False))


def not_two_valued(cond: Column) -> Column:
    return ~two_valued(cond)


def null_safe(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Join condition under which null matches null."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def order(keys: list, tie: list[str]) -> list[Column]:
    """Sort columns from names or (name, "asc"|"desc"[, "first"|"last"]); nulls are smallest unless said; ties by `tie`."""
    out = []
    for k in keys:
        name, way, nulls = (*((k,) if isinstance(k, str) else tuple(k)), None, None)[:3]
        c = F.col(name)
        if way == "desc":
            out.append(c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_last() if nulls == "last" else c.asc_nulls_first())
    return out + [F.col(t).asc() for t in tie]
