"""Date columns: buckets, spans, deadlines. Every "today" is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = ("week", "month", "quarter", "semester", "year")
#: Months between bucket starts; weeks are seven days.
_MONTHS = {"month": 1, "quarter": 3, "semester": 6, "year": 12}


def bucket_start(date: Column, kind: str) -> Column:
    """Start of the Monday week, month, quarter, half-year or year."""
    if kind == "semester":
        first = F.trunc(date, "year")
        return F.when(F.month(date) > 6, F.add_months(first, 6)).otherwise(first)
    return F.trunc(date, kind)


def bucket_range(low: Column, high: Column, kind: str) -> Column:
    """All bucket starts between two, as an array."""
    step = "interval 7 days" if kind == "week" else f"interval {_MONTHS[kind]} months"
    return F.sequence(low, high, F.expr(step))


def days_until(date: Column, as_of: str) -> Column:
    return F.date_diff(F.to_date(date), F.to_date(F.lit(as_of)))


def deadline_status(date: Column, submitted: Column, as_of: str, soon: int = 14) -> Column:
    days = days_until(date, as_of)
    return F.when(submitted, F.when(days < 0, "Submitted (closed)").otherwise("Submitted")).when(days.isNull(), "No deadline").when(days < 0, "Overdue").when(days <= soon, "Due Soon").otherwise("On Track")


def review_week(date: Column) -> Column:
    """'Week N (d Mon - d Mon)'; from Friday on, a date belongs to the next week."""
    monday = F.trunc(F.when(F.weekday(date) >= 4, F.date_add(date, 3)).otherwise(date), "week")
    return F.concat(F.lit("Week "), F.weekofyear(monday).cast("string"), F.lit(" ("), F.date_format(monday, "d MMM"), F.lit(" - "), F.date_format(F.date_add(monday, 6), "d MMM"), F.lit(")"))


def relative_time(seconds: Column) -> Column:
    """'in 3d', '2h ago', 'now' for a signed number of seconds from now."""
    size = F.abs(seconds)
    text = F.when(size >= 86400, F.concat(F.floor(size / 86400).cast("string"), F.lit("d"))).when(size >= 3600, F.concat(F.floor(size / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(size / 60).cast("string"), F.lit("m")))
    return F.when(size < 60, "now").when(seconds > 0, F.concat(F.lit("in "), text)).otherwise(F.concat(text, F.lit(" ago")))


def coerce_date(c: Column) -> Column:
    """ISO dates and timestamps of any precision, d/M/y, d MMM y and MMM d, y; anything else is null."""
    text = F.trim(c.cast("string"))
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    return F.coalesce(F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd"), F.try_to_date(text, "d/M/yyyy"), F.try_to_date(text, "d MMM yyyy"), F.try_to_date(text, "d MMMM yyyy"), F.try_to_date(text, "MMM d, yyyy"), F.try_to_date(text, "MMMM d, yyyy"))


def duration_months(text: Column) -> Column:
    """(low, high) months from '12-18 months', '2 years', '90 days'; null without one."""
    found = F.regexp_extract(F.lower(text), r"(\d+)\s*(?:-|–|to)?\s*(\d+)?\s*(day|week|month|year)s?", 0)
    part = lambda i: F.regexp_extract(found, r"(\d+)\s*(?:-|–|to)?\s*(\d+)?\s*(day|week|month|year)", i)
    unit = part(3)
    factor = F.when(unit == "year", 12.0).when(unit == "month", 1.0).when(unit == "week", 12 / 52).when(unit == "day", 12 / 365)
    months = lambda x: F.ceil(x.try_cast("double") * factor - 1e-9).cast("int")
    return F.when(found != "", F.struct(months(part(1)).alias("low"), months(F.when(part(2) != "", part(2)).otherwise(part(1))).alias("high")))
