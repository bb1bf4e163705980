"""Golden rows for column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from callweave.functions import dates, deadlines, geo, money, taxonomy, text, urls
from callweave.operators import criteria


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("$0.150M", 150_000.0), ("150k", 150_000.0), ("1,200", 1200.0), ("2.5 bn", 2.5e9), ("n/a", None), (None, None), ("USD 3 million", 3e6)],
)
def test_money_text(spark, value, wanted):
    assert one(spark, money.money_text, value) == (pytest.approx(wanted) if wanted else wanted)


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("up to USD 2.5 million in all", (2.5e6, "USD")), ("€10k or 20,000 GBP", (20_000.0, "GBP")), ("no money", None), ("in 2024 there were 500", None), ("£5bn", (5e9, "GBP"))],
)
def test_largest_amount(spark, value, wanted):
    got = one(spark, money.largest, value)
    assert (tuple(got) if got else None) == wanted


def test_amounts_are_grounded(spark):
    rows = spark.createDataFrame([(100_500.0, "USD 100,000"), (102_000.0, "USD 100,000"), (5.0, None)], "v double, t string")
    assert [r.x for r in rows.select(money.grounded(F.col("v"), F.col("t")).alias("x")).collect()] == [True, False, None]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("2024-02-30", None), ("2024-02-29T10:00:00Z", "2024-02-29"), ("3/4/2024", "2024-04-03"), ("5 Mar 2024", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("soon", None), (None, None), ("", None), ("2024-01-02 10:11", "2024-01-02")],
)
def test_dates(spark, value, wanted):
    got = one(spark, dates.coerce_date, value)
    assert (got.isoformat() if got else None) == wanted


@pytest.mark.parametrize(
    ("value", "day", "method"),
    [
        ("Posted 1 Mar 2024. Submission deadline: 16 August 2024.", "2024-08-16", "labelled"),
        ("Closing date 3rd of stage one 1 May 2024; full proposals due by June 30, 2024", "2024-06-30", "labelled"),
        ("Applications are accepted on a rolling basis", "2025-12-31", "rolling"),
        ("The deadline is in September 2024", "2024-09-30", "labelled month"),
        ("Meeting 2024-05-06 in Rome", "2024-05-06", "unlabelled"),
        ("Published 2024-05-06", None, None),
        ("deadline 25/12/2024", "2024-12-25", "labelled"),
        ("deadline 12/25/2024", "2024-12-25", "labelled"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_deadlines(spark, value, day, method):
    got = one(spark, lambda c: deadlines.deadline(c, 2025), value)
    assert ((got.deadline.isoformat(), got.method) if got else (None, None)) == (day, method)


def test_posted_is_never_in_the_future(spark):
    assert one(spark, lambda c: deadlines.posted(c, "2024-06-01"), "Published 2025-01-01") is None
    assert one(spark, lambda c: deadlines.posted(c, "2024-06-01"), "Updated 2 Feb 2024, posted 1 Jan 2024") == datetime.date(2024, 2, 2)


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("https://WWW.Ex.org/Path/?q=1#f", "ex.org/Path"), ("ex.org", "ex.org"), ("HTTP://a.b/", "a.b"), (None, None)],
)
def test_comparable_urls(spark, value, wanted):
    assert one(spark, urls.comparable, value) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("x.org/a", "https://x.org/a"), ("http://x.org", "http://x.org"), ("mailto:a@b.c", None), ("none", None), (None, None)])
def test_links(spark, value, wanted):
    assert one(spark, urls.valid_link, value) == wanted


def test_html_strip(spark):
    assert one(spark, urls.strip_html, "<p>a&amp;b<script>x</script> <b>c</b>\n</p><!-- d -->") == "a&b c"


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (text.normal_title, "Call for Proposals: Clean-Water  Systems!", "clean water systems"),
        (text.normal_title, "RFP: Wash", "rfp wash"),
        (text.funder_key, "The  Fund—for ­Good", "thefundforgood"),
        (text.tidy_name, " Ｆund ‒ A ", "Fund - A"),
        (text.acronym, "Save the Children Fund", "STCF"),
        (text.opportunity_id, " ab 12 ", "AB12"),
        (text.opportunity_id, "a1", ""),
        (text.person, "Prof. Dr. ANN lee", "Ann Lee"),
        (text.quiet_case, "GRANTS FOR ALL", "Grants For All"),
        (text.quiet_case, "WHO grants", "WHO grants"),
        (text.slug, " A & B / c", "a-b-c"),
        (text.truthy, " Yes ", True),
        (text.truthy, None, False),
        (text.as_list, '["a", " b "]', ["a", "b"]),
        (text.as_list, "a, ,b", ["a", "b"]),
        (text.as_list, None, []),
        (text.partners, "Name; (ABC), Beta, Inc.", ["Name (ABC)", "Beta Inc."]),
        (geo.canonical, "usa", "United States"),
        (geo.canonical, "Gambia, The", "Gambia"),
        (geo.canonical, "Korea, Republic of", "South Korea"),
        (geo.canonical, "COTE D'IVOIRE", "Cote D'ivoire"),
        (lambda c: geo.canonical_of(geo.REGIONS)(c), "COTE D'IVOIRE", "Cote d'Ivoire"),
        (lambda c: geo.canonical_of(geo.REGIONS)(c), " viet nam", "Viet Nam"),
        (taxonomy.applicant_role, "as a subrecipient", "Sub"),
        (dates.relative_time, None, None),
    ],
)
def test_text(spark, f, value, wanted):
    assert one(spark, f, value) == wanted


def test_sequence_ratio(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a"), ("same", "same")], "a string, b string")
    assert [r.x for r in rows.select(text.sequence_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [0.75, 1.0, None, 1.0]


def test_tiers_and_awards(spark):
    t = one(spark, taxonomy.tier_bounds, [(5.0, 10.0), (None, 3.0), (20.0, None)], "array<struct<low:double,high:double>>")
    assert tuple(t) == (3.0, 20.0)
    rows = spark.createDataFrame([(100.0, None, None, 4), (100.0, 5.0, 30.0, 4), (100.0, 5.0, None, None)], "t double, f double, c double, n int")
    assert [r.x for r in rows.select(taxonomy.per_award(*map(F.col, "tfcn")).alias("x")).collect()] == [25.0, 30.0, 5.0]


def test_expansion_and_worldwide(spark):
    got = one(spark, geo.expand, ["South Asia", "Chile"], "array<string>")
    assert set(got) == {"South Asia", "Chile", *geo.REGIONS["South Asia"]}
    fit = lambda c: geo.strength(geo.places(c), c, ("Kenya",), ("East Africa",))
    assert [one(spark, fit, v) for v in ("Open to any country", "in Kenya", "across East Africa", "in Atlantis", "in Mali")] == ["strong", "strong", "regional", "silent", "foreign"]


def test_themes(spark):
    verdict = lambda title, body: one(spark, lambda _: taxonomy.theme_verdict(F.lit(title), F.lit(body), ("health", "water", "clinic"), ("mining",)))
    assert verdict("Water health", "clinics") == "on-theme"
    assert verdict("Water", "x") == "ambiguous" and verdict("Poetry", "x") == "off-theme"
    assert verdict("Mining water health", "clinics") == "excluded" and verdict("Poetry", "mining") == "excluded"
    assert verdict("Water health clinics", "mining nearby") == "ambiguous"


@pytest.mark.parametrize(("value", "wanted"), [("5 years", 5), ("10+ yrs", 10), ("3", 3), ("12y", 12), ("3 +", 3), ("five years", None), ("5 years old", None), ("0", None), ("99 years", None), ("5 years +", None), ("", None), (None, None), ("2 months", None)])
def test_stated_years(spark, value, wanted):
    assert one(spark, criteria.stated_years, value) == wanted


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ("3 June 2025", (2025, 6, 3)), ("June 3rd, 2025", (2025, 6, 3)), ("3rd Sept. 2025", (2025, 9, 3)), ("Sep 2025", (2025, 9, 30)), ("2025-02-09", (2025, 2, 9)), ("03/04/2025", (2025, 4, 3)), ("04.13.2025", (2025, 4, 13)),
        ("31 February 2025", None), ("February 2024", (2024, 2, 29)), ("13/13/2025", None), ("", None), (None, None),
    ],
)
def test_parts_of_dates_by_kind(spark, value, wanted):
    got = one(spark, deadlines.read_date, value)
    assert (got.date if got else None) == (datetime.date(*wanted) if wanted else None)


@pytest.mark.parametrize(("value", "wanted"), [("1,200", 1200), ("12,34", 12), ("1,200,000.50", 1200000.5), ("1234,567", 1234), ("7.5", 7.5), ("1.2.3", 1.2), ("0.150M", 150000), ("about 3 bn", 3e9), ("none", None), (None, None)])
def test_groups_of_digits(spark, value, wanted):
    assert one(spark, money.money_text, value) == wanted
