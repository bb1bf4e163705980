"""The hierarchy of places: countries in overlapping groups (sub-regions, continents, blocs, income tiers), and the gate that reads a call's scope.

A group's members are the closure over the groups it is made of, so a country is in as many groups as name it, and a
group of groups needs no list of its own. Names, synonyms, official and inverted names and codes lead to one canonical
name each. The gate decides in five steps: an exclusive restriction, the title's country, named regions, inclusive
wording or a tier, named countries; a call without any is silent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Countries by sub-region.
SUBREGIONS = """
Northern Africa: Algeria, Egypt, Libya, Morocco, Tunisia
Western Africa: Benin, Burkina Faso, Cabo Verde, Côte d'Ivoire, Gambia, Ghana, Guinea, Guinea-Bissau, Liberia, Mali, Mauritania, Niger, Nigeria, Senegal, Sierra Leone, Togo
Middle Africa: Angola, Cameroon, Central African Republic, Chad, Congo (Brazzaville), Congo (DRC), Equatorial Guinea, Gabon, Sao Tome and Principe
Eastern Africa: Burundi, Comoros, Djibouti, Eritrea, Ethiopia, Kenya, Madagascar, Malawi, Mauritius, Mozambique, Rwanda, Seychelles, Somalia, South Sudan, Tanzania, Uganda, Zambia, Zimbabwe
Southern Africa: Botswana, Eswatini, Lesotho, Namibia, South Africa
Northern America: Canada, United States
Central America: Belize, Costa Rica, El Salvador, Guatemala, Honduras, Mexico, Nicaragua, Panama
South America: Argentina, Bolivia, Brazil, Chile, Colombia, Ecuador, Guyana, Paraguay, Peru, Suriname, Uruguay, Venezuela
Caribbean: Antigua and Barbuda, Bahamas, Barbados, Cuba, Dominica, Dominican Republic, Grenada, Haiti, Jamaica, Saint Kitts and Nevis, Saint Lucia, Saint Vincent and the Grenadines, Trinidad and Tobago
Eastern Asia: China, Japan, Mongolia, North Korea, South Korea, Taiwan
South-eastern Asia: Brunei, Cambodia, Indonesia, Laos, Malaysia, Myanmar, Philippines, Singapore, Thailand, Timor-Leste, Vietnam
Southern Asia: Afghanistan, Bangladesh, Bhutan, India, Iran, Maldives, Nepal, Pakistan, Sri Lanka
Central Asia: Kazakhstan, Kyrgyzstan, Tajikistan, Turkmenistan, Uzbekistan
Western Asia: Armenia, Azerbaijan, Bahrain, Cyprus, Georgia, Iraq, Israel, Jordan, Kuwait, Lebanon, Oman, Palestine, Qatar, Saudi Arabia, Syria, Türkiye, United Arab Emirates, Yemen
Northern Europe: Denmark, Estonia, Finland, Iceland, Ireland, Latvia, Lithuania, Norway, Sweden, United Kingdom
Western Europe: Austria, Belgium, France, Germany, Liechtenstein, Luxembourg, Monaco, Netherlands, Switzerland
Southern Europe: Albania, Andorra, Bosnia and Herzegovina, Croatia, Greece, Italy, Malta, Montenegro, North Macedonia, Portugal, San Marino, Serbia, Slovenia, Spain
Eastern Europe: Belarus, Bulgaria, Czechia, Hungary, Moldova, Poland, Romania, Russia, Slovakia, Ukraine
Oceania: Australia, Fiji, Kiribati, Marshall Islands, Micronesia, Nauru, New Zealand, Palau, Papua New Guinea, Samoa, Solomon Islands, Tonga, Tuvalu, Vanuatu
"""
# Groups of groups, with single countries where they add some.
UNIONS = """
Sub-Saharan Africa: Western Africa, Middle Africa, Eastern Africa, Southern Africa, Sudan
Africa: Sub-Saharan Africa, Northern Africa
Latin America and the Caribbean: Central America, South America, Caribbean
North America: Northern America, Central America, Caribbean
Americas: Northern America, Latin America and the Caribbean
Asia: Eastern Asia, South-eastern Asia, Southern Asia, Central Asia, Western Asia
Europe: Northern Europe, Western Europe, Southern Europe, Eastern Europe, Cyprus, Kosovo
"""
# Members of economic blocs, the European Union and the Mediterranean.
BLOCS = """
COMESA: Burundi, Comoros, Congo (DRC), Djibouti, Egypt, Eritrea, Eswatini, Ethiopia, Kenya, Libya, Madagascar, Malawi, Mauritius, Rwanda, Seychelles, Somalia, Sudan, Tunisia, Uganda, Zambia, Zimbabwe
ECOWAS: Benin, Burkina Faso, Cabo Verde, Côte d'Ivoire, Gambia, Ghana, Guinea, Guinea-Bissau, Liberia, Mali, Niger, Nigeria, Senegal, Sierra Leone, Togo
CEMAC: Cameroon, Central African Republic, Chad, Congo (Brazzaville), Equatorial Guinea, Gabon
ECCAS: Angola, Burundi, Cameroon, Central African Republic, Chad, Congo (DRC), Congo (Brazzaville), Equatorial Guinea, Gabon, Rwanda, Sao Tome and Principe
EAC: Burundi, Congo (DRC), Kenya, Rwanda, Somalia, South Sudan, Tanzania, Uganda
SADC: Angola, Botswana, Comoros, Congo (DRC), Eswatini, Lesotho, Madagascar, Malawi, Mauritius, Mozambique, Namibia, Seychelles, South Africa, Tanzania, Zambia, Zimbabwe
UEMOA: Benin, Burkina Faso, Côte d'Ivoire, Guinea-Bissau, Mali, Niger, Senegal, Togo
WAEMU: UEMOA
IGAD: Djibouti, Eritrea, Ethiopia, Kenya, Somalia, South Sudan, Sudan, Uganda
AMU: Algeria, Libya, Mauritania, Morocco, Tunisia
European Union: Austria, Belgium, Bulgaria, Croatia, Cyprus, Czechia, Denmark, Estonia, Finland, France, Germany, Greece, Hungary, Ireland, Italy, Latvia, Lithuania, Luxembourg, Malta, Netherlands, Poland, Portugal, Romania, Slovakia, Slovenia, Spain, Sweden
Mediterranean: Albania, Algeria, Bosnia and Herzegovina, Croatia, Cyprus, Egypt, France, Greece, Israel, Italy, Lebanon, Libya, Malta, Monaco, Montenegro, Morocco, Palestine, Slovenia, Spain, Syria, Tunisia, Türkiye
"""
# Income and development tiers; those without members are named in texts only.
TIERS = """
Global South: Africa
Low- and middle-income countries (LMICs): Africa
Least Developed Countries (LDCs): Sub-Saharan Africa
Low-income countries:
Lower-middle-income countries:
Upper-middle-income countries:
Fragile & conflict-affected states:
Small Island Developing States (SIDS):
"""
# What else groups are called in texts.
GROUP_NAMES = """
COMESA: common market for eastern and southern africa
ECOWAS: economic community of west african states, economic community of west africa
CEMAC: economic and monetary community of central africa
ECCAS: economic community of central african states
SADC: southern african development community
EAC: east african community
UEMOA: west african economic and monetary union
IGAD: intergovernmental authority on development
AMU: arab maghreb union
Africa: african continent, pan-african, pan african
Sub-Saharan Africa: sub saharan africa, subsaharan africa, sub-saharan, ssa
Northern Africa: north africa, maghreb
Eastern Africa: east africa, horn of africa
Western Africa: west africa, sahel
Middle Africa: central africa
Latin America and the Caribbean: latin america, the caribbean
South America: south american
Southern Asia: south asia
South-eastern Asia: southeast asia, south-east asia, asean
Eastern Asia: east asia
Western Asia: west asia, middle east
Europe: european
European Union: eu, eu member states, eu member state, horizon europe
Americas: the americas
North America: north american
Asia: asian
Oceania: pacific islands
Mediterranean: mediterranean region, mediterranean basin
Global South: global-south, developing world, majority world
Low- and middle-income countries (LMICs): lmic, lmics, lmi countries, low- and middle-income, low and middle income, developing country, developing countries, developing nation, developing nations, developing economies, developing regions, resource-limited, resource-poor, low-resource
Low-income countries: low-income country, low income countries, poorest countries, poorest nations
Lower-middle-income countries: lower-middle-income, lower middle income
Upper-middle-income countries: upper-middle-income, upper middle income
Least Developed Countries (LDCs): least developed countries, least developed country, ldc, ldcs, third world
Fragile & conflict-affected states: fragile state, fragile states, conflict-affected
Small Island Developing States (SIDS): small island developing states, sids, small island states
"""
# Official, former and short names of countries, and codes that sources give instead.
COUNTRY_NAMES = """
Laos: lao people's democratic republic, lao pdr, lao
Tanzania: united republic of tanzania, tza
South Korea: republic of korea, kor
North Korea: democratic people's republic of korea
Vietnam: viet nam, vnm
Syria: syrian arab republic, syr
Iran: islamic republic of iran, irn
Bolivia: plurinational state of bolivia, bol
Venezuela: bolivarian republic of venezuela, ven
Moldova: republic of moldova, mda
Congo (Brazzaville): republic of the congo, congo-brazzaville, congo brazzaville, cog
Congo (DRC): democratic republic of congo, democratic republic of the congo, drc, dr congo, congo-kinshasa, congo kinshasa, cod
Brunei: brunei darussalam
Kyrgyzstan: kyrgyz republic
Palestine: state of palestine
Türkiye: republic of türkiye, turkey, turkiye, tur
United States: us, u.s., usa, u.s.a., united states of america
United Kingdom: uk, u.k., great britain, united kingdom of great britain and northern ireland, gbr
United Arab Emirates: uae, are
Côte d'Ivoire: ivory coast, cote d'ivoire, cote divoire, civ
Cabo Verde: cape verde
Eswatini: swaziland
Myanmar: burma, mmr
Timor-Leste: east timor
North Macedonia: macedonia
Czechia: czech republic, cze
Netherlands: holland, nld
Kenya: ken
Cameroon: cmr
Mali: mli
Nigeria: nga
Ethiopia: eth
Ghana: gha
Romania: rou
"""
# Peoples whose name stands for a place beside an exclusive restriction.
PEOPLES = "indian: India, canadian: Canada, chinese: China, american: United States, british: United Kingdom, australian: Australia, japanese: Japan, german: Germany, french: France, spanish: Spain, italian: Italy, korean: South Korea, swiss: Switzerland"
# Phrases that keep a call to a place, and nouns that '-based ... only' restricts.
EXCLUSIVE = "only to, only open to, only available to, open only to, restricted to, limited to, reserved for, exclusively for, exclusively to, exclusively open, specific to, must be based in, must be located in, must be registered in, must be headquartered in, must be incorporated in, must be established in, applicants must be from, applicant must be from"
BASED = "researchers, researcher, institutions, institution, organisations, organizations, organisation, organization, applicants, applicant, entities, companies, teams"
# Phrases that open a call to all.
INCLUSIVE = "globally, worldwide, world wide, world-wide, any country, all countries, across the globe, across the world, open to all, all eligible countries, regardless of country, regardless of location, international applicants, international applicant, foreign applicants are eligible, foreign organisations are eligible, foreign organizations are eligible"
#: Codes and words too short or too common to be sought in running text.
NOT_IN_TEXT = {"us", "are", "lao", "ken", "cog", "cod", "bol", "ven", "eth", "tur", "civ"}


def _lines(block: str) -> dict[str, list[str]]:
    return {name: [x.strip() for x in rest.split(",") if x.strip()] for name, rest in (line.split(":", 1) for line in block.strip().splitlines())}


def closure(groups: Mapping[str, Sequence[str]]) -> dict[str, frozenset[str]]:
    """Each group's countries through all groups that it is made of; a group within itself raises."""
    done: dict[str, frozenset[str]] = {}

    def members(name: str, above: tuple[str, ...]) -> frozenset[str]:
        if name in above:
            raise ValueError(f"{name} is a part of itself")
        if name not in groups:
            return frozenset([name])
        if name not in done:
            done[name] = frozenset().union(*(members(part, (*above, name)) for part in groups[name]))
        return done[name]

    return {name: members(name, ()) for name in groups}


@cache
def members() -> dict[str, frozenset[str]]:
    return closure(_lines(SUBREGIONS) | _lines(UNIONS) | _lines(BLOCS) | _lines(TIERS))


@cache
def countries() -> tuple[str, ...]:
    return tuple(sorted(frozenset().union(*members().values())))


def regions() -> list[str]:
    """Groups that bound a call's scope; tiers only describe it."""
    return [g for g in members() if g not in _lines(TIERS)]


@cache
def names() -> dict[str, str]:
    """Every lower-case name of a place and its canonical name."""
    out = {n.lower(): n for n in (*countries(), *members())}
    for block in (GROUP_NAMES, COUNTRY_NAMES):
        for place, others in _lines(block).items():
            for other in others:
                out.setdefault(other, place)
    for name, place in list(out.items()):  # without accents as well
        out.setdefault(unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode(), place)
    return out


def hierarchy(spark: SparkSession) -> DataFrame:
    """(place, country): every group with each of its countries, and every country with itself."""
    rows = [(g, c) for g, cs in members().items() for c in cs] + [(c, c) for c in countries()]
    return spark.createDataFrame(rows, "place string, country string")


# ---------------------------------------------------------------- columns


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def _names_map() -> str:
    return "map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in names().items()) + ")"


@cache
def _members_map() -> str:
    return "map(" + ", ".join(f"{_text(g)}, array({', '.join(_text(c) for c in sorted(cs))})" for g, cs in members().items() if cs) + ")"


def canonical(term: Column) -> Column:
    """A place's name from any of its names, also turned round ('Korea, Republic of', 'Iran (Islamic Republic of)'); other terms as they are."""
    known = F.expr(_names_map())
    low = F.lower(F.regexp_replace(F.trim(term), r"\s+", " "))
    head, rest = F.regexp_extract(low, r"^([^,(]+?)\s*[,(]\s*([^,()]+)\)?$", 1), F.regexp_extract(low, r"^([^,(]+?)\s*[,(]\s*([^,()]+)\)?$", 2)
    turned = F.regexp_replace(F.concat_ws(" ", rest, head), r"^the ", "")
    return F.coalesce(F.try_element_at(known, low), F.when(head != "", F.try_element_at(known, turned)), F.trim(term))


def expand(places: Column) -> Column:
    """The places with all countries of those that are groups."""
    groups = F.expr(_members_map())
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.concat(F.array(p), F.coalesce(F.try_element_at(groups, p), F.array().cast("array<string>"))))))


def _branches(tree: dict) -> str:
    """What may follow, longer before shorter."""
    ways = [atom + _branches(below) for atom, below in sorted(tree.items()) if atom]
    one = ways[0] if len(ways) == 1 and "" not in tree else f"(?:{'|'.join(ways)})"
    return "" if not ways else one + ("?" if "" in tree else "")


def _pattern(options: Sequence[str]) -> str:
    """Any of the options as whole words, the longest first: by common beginnings, so that a text is not held against each option at each place."""
    tree: dict = {}
    for option in options:
        at = tree
        for c in option.lower():
            at = at.setdefault(r"\s+" if c == " " else re.escape(c), {})
        at[""] = {}
    return r"(?iu)(?<!\w)(?:" + _branches(tree) + r")(?!\w)"


@cache
def _place_pattern() -> str:
    return _pattern([n for n in names() if n not in NOT_IN_TEXT])


def found(text: Column) -> Column:
    """The canonical places of a text in order, longer names first where names overlap; 'south africa' names no continent."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_place_pattern()), 0), canonical))


def scope(title: Column, text: Column, eligible: Column) -> Column:
    """struct(verdict, reason): does the scope of a call take in any of the eligible countries? 'keep', 'reject' or 'silent'.

    title: the call's title; text: title, brief and scope together, without the funder's name; eligible: canonical countries.
    """
    empty = F.array().cast("array<string>")
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    near = _pattern(EXCLUSIVE.split(", ")).removeprefix("(?iu)")
    based = r"-based\s+(?:" + "|".join(BASED.split(", ")) + r")[^.]{0,25}\bonly"
    windows = F.regexp_extract_all(text, F.lit(r"(?iu)[^\n]{0,30}(?:" + near + "|" + based + r")[^\n]{0,50}"), 0)
    peoples = dict(x.split(": ") for x in PEOPLES.split(", "))
    beside = _pattern([*(n for n in names() if n not in NOT_IN_TEXT or n == "us"), *peoples])
    people = F.expr("map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in peoples.items()) + ")")
    first = lambda w: F.regexp_extract(w, beside.replace("(?:", "(", 1), 1)
    kept_to = F.filter(F.transform(windows, first), lambda p: p != "")
    kept_to = F.transform(kept_to, lambda p: F.coalesce(F.try_element_at(people, F.lower(p)), canonical(p)))
    outside = F.filter(kept_to, lambda p: ~F.arrays_overlap(expand(F.array(p)), eligible))
    here = found(text)
    is_group, is_tier = (lambda p: p.isin(*regions())), (lambda p: p.isin(*_lines(TIERS)))
    named, wide = F.filter(here, lambda p: ~is_group(p) & ~is_tier(p)), F.filter(here, is_group)
    in_title = F.filter(found(title), lambda p: ~is_group(p) & ~is_tier(p))
    open_ = text.rlike(_pattern(INCLUSIVE.split(", "))) | F.exists(here, is_tier)
    meets = lambda x: F.coalesce(F.arrays_overlap(x, eligible), F.lit(False))
    say = lambda verdict, why, places=empty: F.struct(F.lit(verdict).alias("verdict"), F.concat_ws(": ", F.lit(why), F.when(F.size(places) > 0, F.concat_ws(", ", F.slice(F.array_sort(places), 1, 3)))).alias("reason"))
    return (
        F.when(F.size(eligible) <= 0, say("silent", "no countries configured"))
        .when(F.size(outside) > 0, say("reject", "restricted to", outside))
        .when((F.size(in_title) > 0) & meets(in_title), say("keep", "title"))
        .when(F.size(in_title) > 0, say("reject", "title", in_title))
        .when((F.size(wide) > 0) & meets(F.concat(expand(wide), named)), say("keep", "region"))
        .when(F.size(wide) > 0, say("reject", "region", wide))
        .when(open_, say("keep", "open or tier"))
        .when((F.size(named) > 0) & meets(named), say("keep", "country"))
        .when(F.size(named) > 0, say("reject", "country", named))
        .otherwise(say("silent", "no geography"))
    )
