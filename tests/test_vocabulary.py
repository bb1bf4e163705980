"""Areas by an automaton against a search term by term."""

import re

from callweave.operators import vocabulary as op

TERMS = [("IDs - HIV", "HIV/AIDS", 2), ("IDs - HIV", "hiv", 3), ("WCH - SRH", "HPV", 1), ("WCH - Vaccines", "HPV vaccine", 0), ("Mind", "mental health", 5), ("Mind", "Mental Health", 5), ("TB", "drug-resistant TB", 4), ("Odd", "%", 6), ("Odd", " ", 7), ("Odd", None, 8), ("C", "C++", 9), ("E", "été", 10)]
TEXTS = [(1, "HIV-positive; shiver"), (2, "environmental health"), (3, "An HPV VACCINE and hiv/aids, mental  health"), (4, None), (5, ""), (6, "drug-resistant TB2"), (7, "drug-resistant TB."), (8, "C++x and C++ y"), (9, "ÉTÉ, étés"), (3, "mental health"), (10, "nothing _hiv_ hivé"), (None, "hiv")]


def plain(text):
    return {(a, t) for a, t, _ in TERMS if t and re.search(r"\w", t) and re.search(rf"\b{re.escape(t)}\b", text or "", re.IGNORECASE)}


def test_both_ways_equal_a_search_term_by_term(spark):
    terms = spark.createDataFrame(TERMS, "area string, term string, place int")
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in TEXTS], "k long, body string, area string, low int")
    want = sorted(((k, a, t) for k, text in TEXTS for a, t in plain(text)), key=str)
    for most in (op.MOST_CHARS, 0):
        assert sorted((tuple(r) for r in op.term_hits(docs, "k", "body", terms, most).collect()), key=str) == want
    found = {r.k: r.areas for r in op.areas(docs, "k", "body", terms).collect()}
    assert found[3] == ["WCH - Vaccines", "WCH - SRH", "IDs - HIV", "Mind"] and found[2] == found[4] == [op.UNSPECIFIED] and found[None] == ["IDs - HIV"]
    counts = {r.area: r.rows for r in op.area_counts(op.areas(docs, "k", "body", terms)).collect()}
    assert counts["Vaccines"] == 1 and counts["Mind"] == 1
    assert op.term_hits(docs.limit(0), "k", "body", terms).count() == 0 and op.term_hits(docs, "k", "body", terms.limit(0)).count() == 0
