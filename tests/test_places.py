import pytest
from pyspark.sql import functions as F

from callweave.functions import geo, places


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_every_name_comes_back(spark):
    rows = spark.createDataFrame([(k, v) for k, v in places.names().items()], "name string, place string")
    wrong = rows.where(places.canonical(F.upper("name")) != F.col("place")).collect()
    assert wrong == [] or {r.name for r in wrong} == set(), wrong
    there = spark.createDataFrame([(c,) for c in (*places.countries(), *places.members())], "place string")
    lost = there.where(~F.array_contains(places.found(F.concat(F.lit("A call for "), "place", F.lit(", open now."))), F.col("place"))).collect()
    assert lost == []


def test_names_of_the_flat_gazetteer_come_back(spark):
    every = sorted({*geo.REGIONS, *(c for cs in geo.REGIONS.values() for c in cs)})
    rows = spark.createDataFrame([(n,) for n in every], "place string")
    assert rows.where(~F.array_contains(geo.places(F.concat(F.lit("NGOs in "), "place")), F.col("place"))).collect() == []
    assert one(spark, geo.places(F.lit("NGOs in Côte d'Ivoire"))) == ["Cote d'Ivoire"]
    assert one(spark, geo.strength(geo.places(F.lit("NGOs in Guinea-Bissau")), F.lit("NGOs in Guinea-Bissau"), ("Guinea-Bissau",), ())) == "strong"


@pytest.mark.parametrize(
    ("term", "place"),
    [
        ("Congo, The Democratic Republic of the", "Congo (DRC)"), ("Congo, Republic of the", "Congo (Brazzaville)"), ("Korea, Republic of", "South Korea"), ("Tanzania, United Republic of", "Tanzania"),
        ("Iran (Islamic Republic of)", "Iran"), ("Kenya, Uganda", "Kenya, Uganda"), ("ROU", "Romania"), ("sub-saharan", "Sub-Saharan Africa"), ("lmics", "Low- and middle-income countries (LMICs)"), (" viet  nam ", "Vietnam"), ("Atlantis", "Atlantis"), ("", ""), (None, None),
    ],
)
def test_canonical_names(spark, term, place):
    assert one(spark, places.canonical(F.lit(term).cast("string"))) == place


def test_groups_overlap_and_hold_their_parts():
    m = places.members()
    assert {"Kenya", "Uganda", "Zambia", "Zimbabwe", "Egypt", "Ethiopia"} <= m["COMESA"] and not {"Cameroon", "Mali", "Nigeria", "Senegal"} & m["COMESA"]
    assert {"Mali", "Nigeria"} <= m["ECOWAS"] and "Cameroon" not in m["ECOWAS"] and "Cameroon" in m["CEMAC"] & m["ECCAS"]
    assert m["UEMOA"] == m["WAEMU"] and m["Sub-Saharan Africa"] < m["Africa"] == m["Global South"] and "Sudan" in m["Sub-Saharan Africa"]
    with pytest.raises(ValueError):
        places.closure({"a": ["b"], "b": ["c", "a"]})
    assert places.closure({"a": ["b", "c"], "b": ["c", "d"]}) == {"a": frozenset("cd"), "b": frozenset("cd")}


TENANT = ["Cameroon", "Mali"]


@pytest.mark.parametrize(
    ("title", "body", "verdict", "reason"),
    [
        ("Health call", "Grants in the COMESA region", "reject", "region: COMESA"), ("Health call", "Scope: SADC, EAC", "reject", "region: EAC, SADC"), ("Health call", "Scope: ECOWAS", "keep", "region"), ("Health call", "Scope: CEMAC", "keep", "region"),
        ("Health call", "the Southern African Development Community", "reject", "region: SADC"), ("Health call", "Sub-Saharan Africa", "keep", "region"), ("Health call", "open to LMICs", "keep", "open or tier"), ("Health call", "COMESA, Cameroon", "keep", "region"),
        ("Health call", "LMICs in Asia", "reject", "region: Asia"), ("Health call", "Canada, open to developing countries", "keep", "open or tier"), ("Modern Slavery Fund Viet Nam Programme", "open to LMICs", "reject", "title: Vietnam"), ("Mali health fund", "Asia", "keep", "title"),
        ("Health call", "Congo (DRC)", "reject", "country: Congo (DRC)"), ("Health call", "South Africa", "reject", "country: South Africa"), ("Health call", "South Sudan or Mali", "keep", "country"), ("Health call", "Health in Georgia", "reject", "country: Georgia"),
        ("Health call", "India-based researchers only; South Africa and Mali", "reject", "restricted to: India"), ("Health call", "restricted to Canadian institutions, worldwide", "reject", "restricted to: Canada"), ("Health call", "open only to applicants in Mali", "keep", "country"),
        ("Health call", "open to all applicants; Fiji", "keep", "open or tier"), ("Health call", "Funding for clinics", "silent", "no geography"), (None, None, "silent", "no geography"), ("", "", "silent", "no geography"), ("Health call", "African Development Bank", "silent", "no geography"),
        ("Health call", "Côte d'Ivoire and Türkiye", "reject", "country: Côte d'Ivoire, Türkiye"), ("Health call", "Guinea-Bissau", "reject", "country: Guinea-Bissau"), ("Health call", "Guinea - Mali", "keep", "country"), ("Health call", "send it to us; they are open", "silent", "no geography"),
    ],
)
def test_the_five_steps(spark, title, body, verdict, reason):
    text = F.concat_ws(" ", F.lit(title).cast("string"), F.lit(body).cast("string"))
    got = one(spark, places.scope(F.lit(title).cast("string"), text, F.array(*map(F.lit, TENANT))))
    assert (got.verdict, got.reason) == (verdict, reason)


def test_no_countries_configured(spark):
    assert one(spark, places.scope(F.lit("Mali"), F.lit("Mali"), F.array().cast("array<string>"))).verdict == "silent"
