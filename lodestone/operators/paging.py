"""Pages: rows in a total order, and how many there are before the cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

MAX_LIMIT = 2000


class UsageError(ValueError):
    """A parameter that can't be meant."""


def limit_of(text: str | int | None, default: int = 25) -> int | None:
    """A limit: a number, clamped to MAX_LIMIT; all, none, 0 and -1 take everything (None)."""
    if text is None:
        return default
    low = str(text).strip().lower()
    if low in ("all", "none", "0", "-1"):
        return None
    try:
        n = int(low)
    except ValueError:
        raise UsageError(f"limit: {text!r} is no number") from None
    if n < 0:
        raise UsageError(f"limit: {n} is negative")
    return min(n, MAX_LIMIT)


def offset_of(text: str | int | None) -> int:
    try:
        n = int(text or 0)
    except ValueError:
        raise UsageError(f"offset: {text!r} is no number") from None
    if n < 0:
        raise UsageError(f"offset: {n} is negative")
    return n


@dataclass
class Page:
    """A query's rows, all of them in no order, and the order that pages are cut in."""

    rows: DataFrame
    order: list[Column]

    def take(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        out = self.rows.orderBy(*self.order)
        if offset:
            out = out.offset(offset)
        return out if limit is None else out.limit(limit)

    def total(self) -> int:
        """Rows before any cut; limits and offsets don't move it."""
        return self.rows.count()
