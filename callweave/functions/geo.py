"""Places: detection in text, canonical names, expansion and fit."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that mean the same place.
SYNONYMS = {"usa": "United States", "us": "United States", "u.s.": "United States", "united states of america": "United States", "uk": "United Kingdom", "drc": "DR Congo", "congo, democratic republic of the": "DR Congo", "tanzania, united republic of": "Tanzania", "ivory coast": "Cote d'Ivoire", "democratic republic of the congo": "DR Congo", "vietnam": "Viet Nam", "turkey": "Turkiye", "swaziland": "Eswatini", "burma": "Myanmar", "cape verde": "Cabo Verde", "czech republic": "Czechia", "macedonia": "North Macedonia", "south-korea": "South Korea", "republic of korea": "South Korea", "holland": "Netherlands", "uae": "United Arab Emirates", "côte d'ivoire": "Cote d'Ivoire", "türkiye": "Turkiye", "são tomé and príncipe": "Sao Tome and Principe"}
#: Countries by region. Further or other regions are a parameter.
REGIONS = {
    "East Africa": ("Burundi", "Comoros", "Djibouti", "Eritrea", "Ethiopia", "Kenya", "Madagascar", "Mauritius", "Rwanda", "Seychelles", "Somalia", "South Sudan", "Sudan", "Tanzania", "Uganda"),
    "West Africa": ("Benin", "Burkina Faso", "Cabo Verde", "Cote d'Ivoire", "Gambia", "Ghana", "Guinea", "Guinea-Bissau", "Liberia", "Mali", "Mauritania", "Niger", "Nigeria", "Senegal", "Sierra Leone", "Togo"),
    "Central Africa": ("Cameroon", "Central African Republic", "Chad", "Congo", "DR Congo", "Equatorial Guinea", "Gabon", "Sao Tome and Principe"),
    "Southern Africa": ("Angola", "Botswana", "Eswatini", "Lesotho", "Malawi", "Mozambique", "Namibia", "South Africa", "Zambia", "Zimbabwe"),
    "Middle East and North Africa": ("Algeria", "Bahrain", "Egypt", "Iran", "Iraq", "Israel", "Jordan", "Kuwait", "Lebanon", "Libya", "Morocco", "Oman", "Palestine", "Qatar", "Saudi Arabia", "Syria", "Tunisia", "United Arab Emirates", "Yemen"),
    "South Asia": ("Afghanistan", "Bangladesh", "Bhutan", "India", "Maldives", "Nepal", "Pakistan", "Sri Lanka"),
    "South-East Asia": ("Brunei", "Cambodia", "Indonesia", "Laos", "Malaysia", "Myanmar", "Philippines", "Singapore", "Thailand", "Timor-Leste", "Viet Nam"),
    "East Asia": ("China", "Japan", "Mongolia", "North Korea", "South Korea"),
    "Central Asia": ("Kazakhstan", "Kyrgyzstan", "Tajikistan", "Turkmenistan", "Uzbekistan"),
    "Pacific": ("Australia", "Fiji", "Kiribati", "New Zealand", "Papua New Guinea", "Samoa", "Solomon Islands", "Tonga", "Tuvalu", "Vanuatu"),
    "North America": ("Canada", "Mexico", "United States"),
    "Central America": ("Belize", "Costa Rica", "El Salvador", "Guatemala", "Honduras", "Nicaragua", "Panama"),
    "Caribbean": ("Bahamas", "Barbados", "Cuba", "Dominica", "Dominican Republic", "Grenada", "Haiti", "Jamaica", "Saint Lucia", "Trinidad and Tobago"),
    "South America": ("Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Ecuador", "Guyana", "Paraguay", "Peru", "Suriname", "Uruguay", "Venezuela"),
    "Europe": ("Albania", "Austria", "Belgium", "Bosnia and Herzegovina", "Bulgaria", "Croatia", "Cyprus", "Czechia", "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Iceland", "Ireland", "Italy", "Kosovo", "Latvia", "Lithuania", "Luxembourg", "Malta", "Moldova", "Montenegro", "Netherlands", "North Macedonia", "Norway", "Poland", "Portugal", "Romania", "Serbia", "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland", "Turkiye", "Ukraine", "United Kingdom"),
}
WORLDWIDE = r"(?i)\b(world[- ]?wide|any country|all countries|global(?:ly)? eligible|open to applicants (?:from )?(?:anywhere|around the world))\b"


def places(text: Column, regions: Mapping[str, Sequence[str]] = REGIONS) -> Column:
    """Distinct canonical places of a text, in order; longer names are tried first, on word boundaries."""
    names = sorted({*regions, *(c for cs in regions.values() for c in cs), *(s for s in SYNONYMS if len(s) > 3)}, key=lambda x: (-len(x), x))
    found = F.regexp_extract_all(text, F.lit(r"(?iu)(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)"), 0)
    return F.array_distinct(F.transform(found, canonical_of(regions)))


def canonical(name: Column) -> Column:
    """A synonym's name, an inverted official name turned round ('Gambia, The'), else the name in title case."""
    return canonical_of({})(name)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def canonical_of(regions: Mapping[str, Sequence[str]]) -> Callable[[Column], Column]:
    """canonical(), with names of these regions and their members kept as they are written there, whatever their case."""
    known = SYNONYMS | {n.lower(): n for n in (*regions, *(c for cs in regions.values() for c in cs))}
    # one constant map, given as text: a column a name would cost a call a name
    names = F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in known.items()) + ")")
    return lambda name: F.coalesce(F.try_element_at(names, F.lower(F.trim(name))), F.try_element_at(names, F.regexp_replace(F.lower(F.trim(name)), r"^([^,]+),\s*(.+)$", "$2 $1")), F.initcap(F.lower(_turned(name))))


def _turned(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?i)^([^,]+),\s*(the|republic of|kingdom of|state of)$", "$1")


def expand(labels: Column, regions: Mapping[str, Sequence[str]] = REGIONS) -> Column:
    """The labels with the members of those that are regions."""
    members = F.expr("map(" + ", ".join(f"{_quoted(r)}, array({', '.join(_quoted(x) for x in (r, *cs))})" for r, cs in regions.items()) + ")")
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: F.coalesce(F.try_element_at(members, x), F.array(x)))))


def strength(found: Column, text: Column, eligible: Sequence[str], broad: Sequence[str]) -> Column:
    """strong, regional, foreign or silent: how a call's places meet an applicant's."""
    own, wide = F.array(*map(F.lit, eligible)), F.array(*map(F.lit, broad))
    return F.when(text.rlike(WORLDWIDE) | F.arrays_overlap(found, own), "strong").when(F.arrays_overlap(found, wide), "regional").when(F.size(found) > 0, "foreign").otherwise("silent")


def presence(registered: Column, operating: Column, scope: Column) -> Column:
    """1 if the registered country is in scope, a half if an operating one is, else 0; null without a scope or any country."""
    inside = expand(scope)
    known = registered.isNotNull() | (F.size(operating) > 0)
    return F.when((F.size(scope) <= 0) | scope.isNull() | ~known, F.lit(None).cast("double")).when(F.coalesce(F.array_contains(inside, registered), F.lit(False)), 1.0).when(F.arrays_overlap(inside, operating), 0.5).otherwise(0.0)
