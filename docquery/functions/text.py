"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def counts(items: Column) -> Column:
    """Distinct items with their numbers, sorted: array<struct<w, n>>. Sorted once and cut at changes, so n log n for long texts."""
    ordered = F.sort_array(items)

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i - 1) == x, F.lit(False)), None).otherwise(i)), lambda i: i.isNotNull())
        return let(starts, lambda p: F.transform(p, lambda i, j: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(p, j + 1), F.size(s)) - i).alias("n"))))

    return let(ordered, of)
