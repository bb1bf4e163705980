"""Text columns: titles, names, labels, lists."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that name the kind of paper rather than the call.
OPENINGS = (
    r"call for (?:letters? of interest|expressions? of interest|proposals?|applications?|concept notes?|tenders?)", r"requests? for (?:proposals?|applications?|expressions? of interest|information|quotations?)",
    "expressions? of interest", "letters? of interest", "notice of funding opportunity", "funding opportunity announcement", "invitation to (?:tender|bid)", "eoi", "loi", "nofo", "rfp", "rfa", "rfq", "cfp", "cfa",
)
SOLICITATION = r"(?i)^\s*(?:" + "|".join(OPENINGS).replace(" ", r"\s+") + r")\b\s*[:–—-]*\s*"
#: Words of titles that tell nothing apart.
GENERIC = tuple("call calls proposal proposals for the of a an and to in on is are now open until grant grants fund funds funding rfp rfa cfp eoi rfq application applications apply round programme program project projects award awards scheme new research".split())
#: Words without an initial in a funder's acronym.
SMALL_WORDS = tuple("of the and for de du des la le et".split())


def normal_title(title: Column) -> Column:
    """Lower-case words; a solicitation prefix goes unless fewer than eight characters would stay."""
    bare = F.regexp_replace(title, SOLICITATION, "")
    kept = F.when(F.length(F.trim(bare)) < 8, title).otherwise(bare)
    return F.trim(F.regexp_replace(F.lower(kept), r"[^\p{L}\p{N}]+", " "))


def distinctive_tokens(title: Column) -> Column:
    """Distinct words of three characters or more that are neither generic nor a bare year."""
    words = F.array_distinct(F.split(normal_title(title), " "))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC) & ~w.rlike(r"^\d{4}$"))


def _after_prefix(name: Column) -> Column:
    """What follows a leading "ACRONYM - "."""
    at = F.instr(name, " - ")
    return F.when(at > 0, F.substr(name, at + 3)).otherwise(name)


def funder_core(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_after_prefix(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}_]+", " "))


def funder_letters(name: Column) -> Column:
    """The letters of a name, as an acronym would have them."""
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z]", ""))


def funder_initials(name: Column) -> Column:
    words = F.regexp_extract_all(_after_prefix(F.coalesce(name, F.lit(""))), F.lit(r"([A-Za-z][A-Za-z'&\-]*)"), 1)
    return F.upper(F.array_join(F.transform(F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS)), lambda w: F.left(w, F.lit(1))), ""))


def same_funder(a: Column, b: Column) -> Column:
    """Equal cores, one within the other from five characters on, or an acronym and its initials."""
    x, y = funder_core(a), funder_core(b)
    within = (F.length(x) >= 5) & (F.length(y) >= 5) & (F.contains(x, y) | F.contains(y, x))
    short = lambda p, q: F.length(funder_letters(p)).between(2, 6) & (funder_letters(p) == funder_initials(q))
    return (x != "") & (y != "") & ((x == y) | within | short(a, b) | short(b, a))


def funder_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(tidy_name(name)), "[^a-z0-9]", "")


def tidy_name(name: Column) -> Column:
    """One kind of dash, no soft hyphens or full-width forms, single blanks."""
    dashes = F.regexp_replace(name, "[‐-―−－]", "-")
    narrow = F.translate(dashes, "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " ")
    return F.trim(F.regexp_replace(F.regexp_replace(narrow, "[­​-‍﻿]", ""), r"[\s ]+", " "))


def acronym(name: Column) -> Column:
    """First letters of the words of three letters or more."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(name, r"[^\p{L}]+"), lambda w: F.length(w) >= 3), lambda w: F.left(w, F.lit(1))), ""))


def opportunity_id(c: Column) -> Column:
    bare = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return F.when(F.length(bare) >= 4, bare).otherwise("")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "required"), F.lit(False))


def as_list(c: Column) -> Column:
    """JSON text of a list, or comma text, as an array of trimmed non-blank strings."""
    parsed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    parts = F.coalesce(parsed, F.split(F.coalesce(c, F.lit("")), ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def label_score(label: Column, scores: Mapping[str, float], hints: Sequence[tuple[str, float]] = ()) -> Column:
    """Score of a label by dictionary, then by the first hint it contains; "not sure" and unknown ones are null."""
    low = F.lower(F.trim(label))
    out = F.when(low.isin("not sure", "unsure", "not_sure", ""), F.lit(None).cast("double"))
    for name, value in scores.items():
        out = out.when(low == name.lower(), F.lit(float(value)))
    for hint, value in hints:
        out = out.when(F.contains(low, F.lit(hint.lower())), F.lit(float(value)))
    return out


def quiet_case(c: Column) -> Column:
    """Shouted text of several words in title case; words of two to five capitals amid lower case stay."""
    return F.when(c.rlike(r"^[^a-z]*\s[^a-z]*$") & c.rlike("[A-Z]"), F.initcap(F.lower(c))).otherwise(c)


#: Forms of address.
HONORIFICS = r"(?i)^(?:dr|mr|mrs|ms|prof|eng|hon)\.?\s+"


def person(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(F.regexp_replace(F.regexp_replace(tidy_name(c), HONORIFICS, ""), HONORIFICS, ""))))


#: Legal forms that belong to the name before a comma.
LEGAL = r"(?i)^(?:inc|ltd|llc|co|corp|gmbh|plc|sa|nv)\.?$|^\([A-Z]{2,8}\)$"


def partners(c: Column) -> Column:
    """Names of a cell split at ; and , - legal forms and acronyms in brackets stay with the name before them."""
    pieces = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))
        return F.when((F.size(acc) > 0) & x.rlike(LEGAL), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, empty, step)


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; no built-in function has it, so it runs in Arrow batches, on candidates only."""
    return F.pandas_udf(_ratios, "double")(a, b)
