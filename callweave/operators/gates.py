"""The eligibility gate: an ordered chain of named rejections as one column; null means eligible."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo, taxonomy
from ..functions.urls import host, host_in
from .scoring import first_reason


class Policy(NamedTuple):
    """What a tenant screens for; without themes nothing is screened in."""

    countries: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()
    themes: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    infeasible: tuple[str, ...] = ()
    aggregators: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    geography: bool = True
    theme: bool = True
    stale_days: int = 90
    home: str = ""
    types: tuple[str, ...] = ()
    match_types: bool = False


#: Shapes of addresses, titles and texts that are no open call.
SEARCH_URL = r"(?i)[?&](?:q|query|search|keyword|filter|page)=|/search(?:/|\?|$)"
LISTING_URL = r"(?i)/(?:calls|grants|opportunities|funding|tenders)/?$"
NEWS_URL = r"(?i)/(?:news|press|blog|stories|events)/"
ARCHIVE_URL = r"(?i)/(?:archive|past|closed)[-/]"
LISTING_TITLE = r"(?i)^(?:all |current |open |latest )?(?:calls|grants|funding opportunities|opportunities|tenders)\s*$"
ARROW_TITLE = r"[»›→≫]\s*$"
FUTURE_TITLE = r"(?i)\b(?:upcoming|forthcoming|future) (?:calls?|opportunit|topics)"
ERROR_TEXT = r"(?i)\b(?:page not found|404 error|access denied|service unavailable|enable javascript)\b"
STRONG = r"(?i)\b(?:request for (?:proposals|applications)|call for (?:proposals|applications)|notice of funding|expression of interest)\b|\b(?-i:RFP|RFA|NOFO|EOI)\b"
WEAK = r"(?i)\b(?:grant|funding|award|applicants?|eligib|proposal)"
DETAILS = r"(?i)\b(?:deadline|closing date|apply|eligib|budget|award (?:amount|ceiling)|how to apply)"
PROCUREMENT = r"(?i)\b(?:invitation to bid|request for quotations?|supply of (?:goods|equipment)|purchase of)\b"
PERSONAL = r"(?i)\b(?:fellowships?|scholarships?|travel award|phd position)\b"
JOB = r"(?i)\b(?:vacancy|job opening|terms of employment|curriculum vitae required)\b"
CLOSED_TEXT = r"(?i)\b(?:this call (?:is|has) (?:now )?closed|applications are (?:now )?closed|no longer accepting)\b"
DOMESTIC = r"(?i)\b(?:only (?:u\.?s\.?|domestic) (?:organi[sz]ations|entities)|must be located in the united states)\b"
FOREIGN_OK = r"(?i)\b(?:foreign (?:organi[sz]ations|entities) (?:are|may)|non-u\.?s\.? entities are eligible)"
NAMED_ONLY = r"(?i)\b(?:only (?:current )?(?:members|alumni|grantees) of|restricted to (?:members|grantees)|open only to (?:members|staff|employees) of)\b"
DONOR_INVEST = r"(?i)\b(?:donate (?:now|today)|make a donation|invest(?:ment)? opportunities for investors)\b"
LOANS = r"(?i)\b(?:loans? (?:of|up to)|concessional loan|micro-?credit)\b"
TRAINING = r"(?i)\b(?:training (?:course|workshop)|webinar series|summer school)\b"
ROLLING = r"(?i)\brolling basis\b|\bopen until filled\b"
#: Share of letters beyond Latin that makes a text unreadable to the screeners, and the least text to judge by.
FOREIGN_SHARE, FOREIGN_LEAST = 0.3, 80


def foreign_script(text: Column) -> Column:
    head = F.regexp_replace(F.left(text, F.lit(2500)), r"\s+", "")
    share = F.length(F.regexp_replace(head, r"[\x{0}-\x{24F}]", "")) / F.greatest(F.length(head), F.lit(1))
    return (F.length(head) >= FOREIGN_LEAST) & (share > FOREIGN_SHARE)


def any_of(words: Sequence[str]) -> str:
    return taxonomy.keyword_pattern(words) if words else r"(?!)"


def other_country(found: Column, eligible: Sequence[str], broad: Sequence[str] = ()) -> Column:
    """A named country governs over a broad region: countries are named, none of them is ours, though a region of ours may be."""
    named = F.filter(found, lambda x: ~x.isin(*geo.REGIONS))
    return (F.size(named) > 0) & ~F.arrays_overlap(named, F.array(*map(F.lit, eligible)) if eligible else F.array().cast("array<string>"))


def applicant_country_mismatch(countries: Column, home: str) -> Column:
    """A published list of applicants' countries, regions with their members, that does not hold the applicant's."""
    listed = geo.expand(F.transform(countries, geo.canonical_of(geo.REGIONS)))
    return F.coalesce((F.size(countries) > 0) & ~F.array_contains(listed, home), F.lit(False)) if home else F.lit(False)


def applicant_type_mismatch(types: Column, text: Column, ours: Sequence[str]) -> Column:
    """Closed to named applicants by wording; or published groups that are neither open nor ours."""
    groups = F.transform(types, lambda x: F.lower(F.trim(x)))
    other = (F.size(groups) > 0) & ~F.array_contains(groups, "open") & ~F.arrays_overlap(groups, F.array(*map(F.lit, ours)) if ours else F.array().cast("array<string>"))
    return F.coalesce(text.rlike(NAMED_ONLY), F.lit(False)) | F.coalesce(other, F.lit(False))


def gate(title: Column, body: Column, url: Column, deadline: Column, posted: Column, policy: Policy, as_of: str, types: Column | None = None, countries: Column | None = None) -> Column:
    """The first reason, 'group: detail', in the chain's order. The page's own text counts if it is held, else the brief.

    types and countries: what the call publishes of its applicants' groups and countries, where it is known.
    """
    text = F.concat_ws(" ", title, body)
    day = F.to_date(F.lit(as_of))
    found = geo.places(text)
    fit = geo.strength(found, text, policy.countries, policy.broad)
    strong = title.rlike(STRONG)
    signal = strong | ((text.rlike(STRONG) | text.rlike(WEAK)) & text.rlike(DETAILS))
    undated = deadline.isNull() & ~text.rlike(ROLLING)
    rules: list[tuple[str, Column]] = [
        ("source: blacklisted", url.rlike(f"(?i){'|'.join(policy.blacklist)}") if policy.blacklist else F.lit(False)),
        ("shape: search results", url.rlike(SEARCH_URL)),
        ("shape: listing", url.rlike(LISTING_URL) | title.rlike(LISTING_TITLE)),
        ("shape: news", url.rlike(NEWS_URL)),
        ("shape: archive", url.rlike(ARCHIVE_URL)),
        ("shape: navigation", title.rlike(ARROW_TITLE)),
        ("shape: future call", title.rlike(FUTURE_TITLE)),
        ("shape: donation", title.rlike(DONOR_INVEST)),
        ("source: not primary", host_in(host(url), policy.aggregators)),
        ("signal: error page", text.rlike(ERROR_TEXT) & ~strong),
        ("signal: none", ~signal),
        ("type: individual award", title.rlike(PERSONAL)),
        ("type: job", text.rlike(JOB) & ~strong),
        ("type: procurement", text.rlike(PROCUREMENT) & ~strong),
        ("type: loan", title.rlike(LOANS)),
        ("type: training", title.rlike(TRAINING) & ~strong),
        ("language: not readable", foreign_script(text)),
        ("closed: wording", text.rlike(CLOSED_TEXT) & ~F.coalesce(deadline >= day, F.lit(False))),
    ]
    if policy.geography:
        rules += [
            ("feasibility: keyword", text.rlike(f"(?i){any_of(policy.infeasible)}")),
            ("geography: domestic only", text.rlike(DOMESTIC) & ~text.rlike(FOREIGN_OK) & ~F.lit("United States" in policy.countries)),
            ("geography: foreign", fit == "foreign"),
            ("geography: another country", (fit == "regional") & other_country(found, policy.countries, policy.broad)),
        ]
    if countries is not None:
        rules.append(("applicant: country", applicant_country_mismatch(countries, policy.home)))
    if policy.match_types and types is not None:
        rules.append(("applicant: type", applicant_type_mismatch(types, text, policy.types)))
    if policy.theme:
        verdict = taxonomy.theme_verdict(title, body, policy.themes, policy.excluded)
        rules += [("theme: none set", F.lit(not policy.themes)), ("theme: excluded", verdict == "excluded"), ("theme: off", verdict == "off-theme")]
    rules += [
        ("deadline: passed", deadline < day),
        ("deadline: stale", undated & (posted < F.date_sub(day, policy.stale_days))),
        ("data: stub", F.length(F.trim(F.coalesce(text, F.lit("")))) < 40),
    ]
    return first_reason(rules)
