"""Metadata filters: one dictionary becomes one predicate, which Catalyst pushes to the scan."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an operator dictionary may hold.
OPERATORS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def condition(key: str, value: Any) -> Column | None:
    """The predicate of one entry; None where the entry says nothing (null, '' or only empties in a list).

    A list is any of its members; a dictionary holds operators; ``tags`` matches a
    part of the comma-joined list, as in a store that keeps tags as one string.
    """
    column = F.col(key)
    if value is None or value == "":
        return None
    if isinstance(value, Mapping):
        unknown = set(value) - set(OPERATORS)
        if unknown:
            raise ValueError(f"unknown operators for {key}: {sorted(unknown)}")
        return functools.reduce(Column.__and__, [OPERATORS[op](column, v) for op, v in value.items()]) if value else None
    if isinstance(value, (list, tuple, set)):
        kept = [v for v in value if v is not None and v != ""]
        return column.isin(kept) if kept else None
    if key == "tags":
        return F.array_join(column, ",").contains(str(value))
    return column == value


def compile_filters(filters: Mapping[str, Any] | None) -> Column | None:
    """The conjunction of all entries; None if there is nothing to filter by."""
    parts = [c for c in (condition(k, v) for k, v in (filters or {}).items()) if c is not None]
    return functools.reduce(Column.__and__, parts) if parts else None


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    where = compile_filters(filters)
    return df if where is None else df.filter(where)


def above(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows that score at least ``threshold``; commutes with a top-k by the same score and is best applied before it."""
    return df.filter(F.col(score) >= threshold)
