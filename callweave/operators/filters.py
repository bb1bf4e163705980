"""Filters and predicates: facets, overlap, periods, search, tenancy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null and white-space-only texts count alike."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def facets(df: DataFrame, picks: Mapping[str, Sequence]) -> DataFrame:
    """Conjunction of membership facets; an empty facet filters nothing. Plain isin() reaches the scan."""
    for name, values in picks.items():
        if values:
            df = df.where(F.col(name).isin(list(values)))
    return df


def overlaps(c: Column, picks: Sequence[str]) -> Column:
    """Whether an array column shares an element with the picks; no picks: all rows."""
    return F.lit(True) if not picks else F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, picks))), F.lit(False))


def between_or_null(c: Column, low: str, high: str) -> Column:
    return c.isNull() | c.between(F.to_date(F.lit(low)), F.to_date(F.lit(high)))


def within_days(c: Column, first: str, last: str) -> Column:
    """Timestamps from the start of `first` to the end of `last`, half-open, so that the range reaches the scan."""
    return (c >= F.lit(first).cast("timestamp")) & (c < F.date_add(F.to_date(F.lit(last)), 1).cast("timestamp"))


def contains_any(columns: Sequence[str], term: str) -> Column:
    """Literal, case-insensitive search in any of some columns; terms under two characters match nothing."""
    term = term.strip().lower()
    if len(term) < 2:
        return F.lit(False)
    return reduce(or_, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term)) for c in columns))


def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(or_, (F.contains(low, F.lit(k.lower())) for k in keywords), F.lit(False))


#: Decisions that end a submission, and progress that ends it.
AWAITED, ENDED = ("", "not submitted"), ("completed", "discontinued")
DECIDED = ("approved", "declined", "awaiting")


def submitted(progress: Column, decision: Column) -> Column:
    return F.coalesce((progress == "completed") | decision.isin(*DECIDED), F.lit(False))


def still_open(progress: Column, decision: Column) -> Column:
    return F.lower(F.trim(F.coalesce(decision, F.lit("")))).isin(*AWAITED) & ~F.coalesce(progress.isin(*ENDED), F.lit(False))


def inconsistency(progress: Column, decision: Column) -> Column:
    decided = F.coalesce(decision.isin("approved", "declined"), F.lit(False))
    return F.when(decided & ~progress.eqNullSafe("completed"), "decided_not_completed").when(progress.eqNullSafe("completed") & blank(decision), "completed_not_sent")


def tenant_rows(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; without a tenant nothing matches (fail closed)."""
    return df.where(F.col(column) == tenant) if tenant else df.where(F.lit(False))


PERIODS = ("all", "this year", "year to date", "this month", "90 days", "12 months")


def period(c: Column, name: str, as_of: str) -> Column:
    """Rows of a named period; an unknown date belongs to "all" only."""
    day = F.to_date(F.lit(as_of))
    date = F.to_date(c)
    bounds = {
        "this year": (F.trunc(day, "year"), F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1)),
        "year to date": (F.trunc(day, "year"), day),
        "this month": (F.trunc(day, "month"), F.last_day(day)),
        "90 days": (F.date_sub(day, 90), day),
        "12 months": (F.add_months(day, -12), day),
    }
    if name == "all":
        return F.lit(True)
    low, high = bounds[name]
    return F.coalesce(date.between(low, high), F.lit(False))
