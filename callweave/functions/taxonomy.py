"""Rule lists compiled to columns: classes of calls by first or by every match."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_pattern(words: Sequence[str]) -> str:
    """Short and all-capital keywords as whole words, longer ones as word beginnings."""
    parts = [re.escape(w) + (r"\b" if len(w) <= 5 or w.isupper() else "") for w in sorted(words, key=len, reverse=True)]
    return r"\b(?:" + "|".join(parts) + ")"


def first_class(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The class of the first (class, pattern) that the text matches."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def all_classes(text: Column, areas: Mapping[str, Sequence[str]]) -> Column:
    """Every area with a keyword in the text; one alternation an area."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){keyword_pattern(ws)}"), F.lit(a)) for a, ws in areas.items()]))


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """How many different keywords the text holds."""
    total = F.lit(0)
    for w in words:
        total = total + F.coalesce(text.rlike(f"(?i){keyword_pattern([w])}"), F.lit(False)).cast("int")
    return total


def theme_verdict(title: Column, body: Column, wanted: Sequence[str], excluded: Sequence[str]) -> Column:
    """off-theme, excluded, ambiguous or on-theme. An excluded word rejects in the title, or where nothing wanted is met."""
    text = F.concat_ws(" ", title, body)
    hits, bad = keyword_hits(text, wanted), keyword_hits(text, excluded)
    in_title = keyword_hits(title, excluded) > 0
    return F.when(in_title | ((bad > 0) & (hits == 0)), "excluded").when(hits == 0, "off-theme").when((hits <= 2) | (bad > 0) | (keyword_hits(title, wanted) == 0), "ambiguous").otherwise("on-theme")


#: Kinds of solicitation, in order of precedence.
SOLICITATIONS = (
    ("Request for applications", r"\b(?:rfa|request for applications?)\b"),
    ("Request for proposals", r"\b(?:rfp|request for proposals?)\b"),
    ("Expression of interest", r"\b(?:eoi|expressions? of interest)\b"),
    ("Concept note", r"\bconcept (?:note|paper)s?\b"),
    ("Call for proposals", r"\bcalls? for (?:proposals?|applications?)\b"),
    ("Notice of funding", r"\b(?:nofo|notice of funding)\b"),
)
#: Synonyms of solicitation kinds.
SAME_KIND = (("Request for applications", "Call for proposals", "Notice of funding"), ("Request for proposals",), ("Expression of interest", "Concept note"))


def same_kinds(kind: Column) -> Column:
    out = F.when(F.lit(False), F.array(F.lit("")))
    for group in SAME_KIND:
        out = out.when(kind.isin(*group), F.array(*map(F.lit, group)))
    return out.otherwise(F.array(kind))


def applicant_role(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\b(?:sub-?(?:recipient|grantee|awardee|contractor)|consortium (?:member|partner) only)\b"), "Sub").otherwise("Prime")


def tier_bounds(tiers: Column) -> Column:
    """(low, high) over an array of (low, high) amounts; an open end is filled from the other."""
    low = F.array_min(F.transform(tiers, lambda t: F.coalesce(t["low"], t["high"])))
    return F.struct(low.alias("low"), F.array_max(F.transform(tiers, lambda t: F.coalesce(t["high"], t["low"]))).alias("high"))


def per_award(total: Column, floor: Column, ceiling: Column, awards: Column) -> Column:
    """What one award is worth: the ceiling, else the total over the number of awards, else the floor."""
    return F.coalesce(ceiling, F.when(awards > 0, total / awards), floor, total)
