"""Predicates over records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

INACTIVE = ("rejection", "archived")


def in_scopes(scopes: Sequence[str] | None, column: str = "project_scope") -> Column:
    """Rows of the given scopes; without scopes, all rows."""
    return F.lit(True) if scopes is None else F.col(column).isin(*scopes)


def read_scopes(scope: str, everything: bool = False) -> list[str] | None:
    """The scopes a reader in `scope` sees: its own and the shared one."""
    return None if everything else list(dict.fromkeys([scope, "global"]))


def active(column: str = "type") -> Column:
    return ~F.col(column).isin(*INACTIVE)


def not_rejected(column: str = "type") -> Column:
    """Search hides rejections only; archived rows stay visible."""
    return F.col(column) != "rejection"


def overlaps(column: str, values: Sequence[str] | None) -> Column:
    """Any of the values stands in the array; a null array never matches."""
    if values is None:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])), F.lit(False))


def within(column: str, since: datetime | str | None = None, until: datetime | str | None = None) -> Column:
    """Both ends included."""
    out = F.lit(True)
    if since is not None:
        out = out & (F.col(column) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out & (F.col(column) <= F.lit(until).cast("timestamp"))
    return out


def older_than(column: str, days: int, as_of: Column) -> Column:
    return F.col(column) < as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def matches_all(lexemes: Column, query: Column) -> Column:
    """Every lexeme of the query occurs; an empty query matches nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, lexemes)) == 0)
