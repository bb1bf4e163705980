"""Deadlines and publication dates read from text, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a date that make it a deadline, and those that make it something else.
SUBMIT = ("submission deadline", "application deadline", "closing date", "deadline", "due date", "due by", "apply by", "submit by", "open until", "closes on", "closes", "date limite", "jusqu'au")
OTHER = ("posted", "published", "issued", "release date", "opening date", "opens", "start date", "updated", "last modified", "webinar", "award date")
ROLLING = r"(?i)\b(rolling basis|open until filled|no (?:fixed )?deadline|ongoing|year[- ]round|accepted at any time)\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: A month's word is any beginning of its name from three letters on. A worded date is a month and a year with up to one
#: day on either side of the month; what else is a date is digits and signs. read_date tells the parts by their kinds.
_MONTH = "(?:" + "|".join(sorted((m[:n] for m in MONTHS for n in (3, 4, len(m)) if n <= len(m)), key=len, reverse=True)) + ")"
_GAP, _DAY = "[\\s.,]{1,3}", "[0-9]{1,2}(?:[a-z]{2})?"
_DATE = rf"(?:{_DAY}{_GAP})?{_MONTH}{_GAP}(?:{_DAY}{_GAP})?[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}"
WINDOW = 70


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Every beginning of a month's name from three letters on, and the month's number; the first month has it if two do.
_MONTH_OF = {m[:n]: i + 1 for i, m in reversed(list(enumerate(MONTHS))) for n in range(3, len(m) + 1)}


def read_date(text: Column) -> Column:
    """(date, precise): the parts of a date by their kinds, whatever their order; a month without a day is its last day.

    A word gives the month, four digits the year, other digits the day. Without a word, digits that start with the year are
    year, month, day; others are day and month, the other way round if only that can be.
    """
    months = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in _MONTH_OF.items()) + ")")
    digits = lambda parts: F.filter(parts, lambda w: w.rlike("^[0-9]+$"))
    kinds = lambda parts: _let(digits(parts), lambda d: F.struct(
        F.get(F.array_compact(F.transform(parts, lambda w: F.try_element_at(months, w))), F.lit(0)).alias("named"),
        F.get(F.filter(d, lambda w: F.length(w) == 4), F.lit(0)).try_cast("int").alias("year"),
        F.transform(F.filter(d, lambda w: F.length(w) <= 2), lambda w: w.try_cast("int")).alias("short"),
        (F.length(F.get(d, F.lit(0))) == 4).alias("year_first"),
    ))

    def read(k: Column) -> Column:
        one, two = F.get(k["short"], F.lit(0)), F.get(k["short"], F.lit(1))
        turned = k["year_first"] | ((two > 12) & (one <= 12))
        day = F.when(k["named"].isNotNull(), one).when(turned, two).otherwise(one)
        month = F.coalesce(k["named"], F.when(turned, one).otherwise(two))
        at = lambda d: F.try_to_date(F.concat_ws("-", k["year"].cast("string"), month.cast("string"), d.cast("string")), "yyyy-M-d")
        alone = k["named"].isNotNull() & one.isNull()
        return F.struct(F.when(alone, F.last_day(at(F.lit(1)))).when(day.isNotNull() & month.isNotNull(), at(day)).alias("date"), (~alone).alias("precise"))

    return _let(_let(F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[a-z]+"), 0), kinds), read)


def dated(text: Column) -> Column:
    """Every date of a text with the kind of the nearest label in the characters before it: submit, other or none.

    Dates are found alone and the text is split at them, so that it is read once from end to end; a text without four digits
    in a row has none and isn't read.
    """
    date = F.lit(rf"(?i)(?<![\w/.-])(?=[0-9jfmasond])(?:{_DATE})(?![\w/])")
    none = F.array().cast("array<string>")
    # split leaves one piece more than there are dates, the one after the last
    parts = lambda dates: F.zip_with(F.slice(F.split(text, date, -1), F.lit(1), F.size(dates)), dates, lambda b, d: F.concat(F.right(b, F.lit(WINDOW)), d))
    pieces = F.when(~text.rlike("[0-9]{4}"), none).otherwise(_let(F.regexp_extract_all(text, date, 0), parts))

    def label(low: Column, back: Column) -> Column:
        last = lambda words: F.greatest(*[F.length(low) - F.coalesce(F.nullif(F.instr(back, F.lit(w[::-1])), F.lit(0)), F.length(low) + 1) for w in words])
        found = F.struct(last(SUBMIT).alias("submit"), last(OTHER).alias("other"))
        return _let(found, lambda x: F.when((x["submit"] < 0) & (x["other"] < 0), "none").when(x["submit"] >= x["other"], "submit").otherwise("other"))

    kind = lambda piece: _let(F.lower(piece), lambda low: _let(F.reverse(low), lambda back: label(low, back)))
    return F.transform(pieces, lambda x: F.struct(kind(x).alias("kind"), read_date(F.regexp_extract(x, rf"(?is)({_DATE})\s*$", 1)).alias("at"), F.trim(x).alias("evidence")))


def deadline(text: Column, year: int) -> Column:
    """(deadline, method, confidence): the latest labelled date, precise ones first; 31 December for rolling calls; else the latest unlabelled one."""
    pick = lambda rows, kind: F.array_max(F.transform(F.filter(rows, lambda x: x["kind"] == kind), lambda x: F.struct(x["at"]["precise"].alias("precise"), x["at"]["date"].alias("date"))))
    out = lambda date, method, level: F.struct(date.alias("deadline"), F.lit(method).alias("method"), F.lit(level).alias("confidence"))

    def choose(found: Column) -> Column:
        submit, plain = found["submit"], found["plain"]
        return F.when(submit.isNotNull() & submit["precise"], out(submit["date"], "labelled", "high")).when(submit.isNotNull(), out(submit["date"], "labelled month", "medium")).when(text.rlike(ROLLING), out(F.to_date(F.lit(f"{year}-12-31")), "rolling", "medium")).when(plain.isNotNull(), out(plain["date"], "unlabelled", "low"))

    both = lambda rows: F.struct(pick(rows, "submit").alias("submit"), pick(rows, "none").alias("plain"))
    return _let(_let(F.filter(dated(text), lambda x: x["at"]["date"].isNotNull()), both), choose)


def posted(text: Column, as_of: str, head: int = 600) -> Column:
    """The latest past date with a publication label, else the first past date of the opening; never a future one."""
    past = lambda x: x["at"]["date"] < F.to_date(F.lit(as_of))
    labelled = F.array_max(F.transform(F.filter(dated(text), lambda x: (x["kind"] == "other") & past(x)), lambda x: x["at"]["date"]))
    opening = F.filter(dated(F.left(text, F.lit(head))), lambda x: (x["kind"] == "none") & past(x) & x["at"]["precise"])
    return F.coalesce(labelled, F.get(opening, F.lit(0))["at"]["date"])
