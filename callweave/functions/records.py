"""Columns of records: blanks, notes, rights, money as text, ids, categories, briefs and wording."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

#: Texts that stand for no value, and for no note.
BLANK = ("", "nan", "none", "null", "nat", "<na>")
NO_NOTE = ("", "-", "--", "n/a", "na", "none", "nil", "no notes", "tbd")
#: Signs of currencies.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹"}
#: Legal and attachment wording that makes a brief raw.
LEGALESE = r"(?i)\b(?:pursuant to|hereinafter|notwithstanding|shall be deemed|in accordance with section)\b"
ATTACHMENT = r"(?i)\[?(?:attachment|attached file|download)s?\s*:\s*[^\]\n]{0,120}\.(?:pdf|docx?|xlsx?|zip)\]?"
#: Channels of submission, the first that a text names.
CHANNELS = (("portal", r"(?i)\b(?:online (?:portal|form|application)|submission portal|apply online)\b"), ("e-mail", r"(?i)\b(?:by|via) e-?mail\b|[\w.+-]+@[\w-]+\.[\w.]+"), ("post", r"(?i)\b(?:by post|by mail|hard cop(?:y|ies))\b"))
#: Labels before a published list of countries.
COUNTRY_LABELS = r"(?:eligible countries|countries eligible|open to applicants from|applicants from|list of countries)"
#: Which kinds of opportunity go with which instruments.
PAIRS = {"research": ("grant", "fellowship"), "programme": ("grant", "contract", "cooperative agreement"), "procurement": ("contract",), "prize": ("award",)}


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in numbers; in texts what stands for no value."""
    fixed = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType | FloatType):
            fixed[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, StringType):
            fixed[f.name] = F.when(~F.lower(F.trim(c)).isin(*BLANK), c)
    return df.withColumns(fixed)


def has_note(fields: Sequence[Column]) -> Column:
    """Whether one of the fields says something."""
    out = F.lit(False)
    for c in fields:
        out = out | ~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*NO_NOTE)
    return out


def access(role: Column, surface: Column, overrides: Column, matrix: Mapping[str, Mapping[str, str]]) -> Column:
    """A user's right on a surface: their own override, else the role's, else none."""
    rows = [x for r, rights in matrix.items() for s, right in rights.items() for x in (F.lit(f"{r}/{s}"), F.lit(right))]
    return F.coalesce(F.try_element_at(overrides, surface), F.try_element_at(F.create_map(*rows), F.concat_ws("/", role, surface)), F.lit("none"))


def requested_currency(secured: Column, asked: Column) -> Column:
    """The secured currency if there is one, else the asked one; blanks are null."""
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.coalesce(clean(secured), clean(asked))


def money(value: Column, code: Column) -> Column:
    """'$1,234,567', 'KES 1,200', a dash for nothing; whole units, half to even."""
    sign = F.when(F.lit(False), F.lit(""))
    for c, s in SIGNS.items():
        sign = sign.when(F.upper(code) == c, F.lit(s))
    whole = F.format_number(F.bround(F.abs(value)), 0)
    shown = F.concat(F.when(F.bround(value) < 0, "-").otherwise(""), F.coalesce(sign, F.concat(F.upper(code), F.lit(" ")), F.lit("")), whole)
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(shown)


def uid(name: Column, at: Column) -> Column:
    """Initials of a name (XX for none) and a time stamp."""
    initials = F.upper(F.array_join(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([A-Za-z])[A-Za-z]*"), 1), lambda x: x), ""))
    return F.concat(F.coalesce(F.nullif(F.left(initials, F.lit(3)), F.lit("")), F.lit("XX")), F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"))


def category(raw: Column, known: Mapping[str, Sequence[str]], otherwise: str = "Other") -> Column:
    """The canonical category whose name or spelling it is, blank as null."""
    low = F.regexp_replace(F.lower(F.trim(raw)), r"[\s_-]+", " ")
    out = F.when(F.coalesce(low, F.lit("")) == "", F.lit(None).cast("string"))
    for name, spellings in known.items():
        out = out.when(low.isin(name.lower(), *spellings), F.lit(name))
    return out.otherwise(otherwise)


def is_raw_brief(brief: Column, raw: Column, share: float = 0.8) -> Column:
    """An attachment's tag, legal wording, or a brief whose words are nearly all the raw text's opening."""
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\W+"))
    own = words(brief)
    copied = F.size(F.array_intersect(own, words(F.left(raw, F.length(brief) + 40)))) >= share * F.size(own)
    return F.coalesce(brief.rlike(ATTACHMENT) | brief.rlike(LEGALESE) | (copied & (F.length(brief) >= 80)), F.lit(False))


def clean_brief(brief: Column, raw: Column) -> Column:
    """Without attachment tags; null if what is left is raw or short."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(brief, ATTACHMENT, " "), r"\s+", " "))
    return F.when(~is_raw_brief(bare, raw) & (F.length(bare) >= 20), bare)


def submission(text: Column) -> Column:
    """(channel, email): the first channel that the text names, and the first address."""
    channel = F.when(F.lit(False), F.lit(""))
    for name, pattern in CHANNELS:
        channel = channel.when(text.rlike(pattern), F.lit(name))
    return F.struct(channel.alias("channel"), F.nullif(F.lower(F.regexp_extract(text, r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)", 1)), F.lit("")).alias("email"))


def listed_countries(text: Column, countries: Sequence[str]) -> Column:
    """Countries of the unbroken list after a label: names parted by commas, semicolons, 'and' or bullets; it ends at the first other word."""
    name = "|".join(sorted((c.replace("'", ".").replace("(", ".").replace(")", ".") for c in countries), key=len, reverse=True))
    run = F.regexp_extract(text, rf"(?i){COUNTRY_LABELS}\s*(?:are|include)?\s*:?\s*((?:(?:{name})(?:\s*(?:[,;•·]|\band\b|&)\s*)*)+)", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(run, F.lit(f"(?i)({name})"), 1), lambda x: F.initcap(F.lower(x))))


def pairing(opportunity: Column, instrument: Column) -> Column:
    """(opportunity, instrument, verdict): a missing side is inferred where only one fits; consistent, unclassified, unknown or unusual."""
    o, i = F.lower(F.trim(F.coalesce(opportunity, F.lit("")))), F.lower(F.trim(F.coalesce(instrument, F.lit(""))))
    fits = F.create_map(*[x for k, v in PAIRS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    mine = F.try_element_at(fits, o)
    only = {x: [k for k, v in PAIRS.items() if x in v] for x in {y for v in PAIRS.values() for y in v}}
    back = F.create_map(*[x for k, v in sorted(only.items()) if len(v) == 1 for x in (F.lit(k), F.lit(v[0]))])
    o2 = F.when((o == "") & (i != ""), F.coalesce(F.try_element_at(back, i), F.lit(""))).otherwise(o)
    i2 = F.when((i == "") & (F.size(mine) == 1), mine[0]).otherwise(i)
    verdict = F.when((o2 == "") | (i2 == ""), "unclassified").when(F.try_element_at(fits, o2).isNull() | ~i2.isin(*only), "unknown").when(F.array_contains(F.try_element_at(fits, o2), i2), "consistent").otherwise("unusual")
    return F.struct(F.nullif(o2, F.lit("")).alias("opportunity"), F.nullif(i2, F.lit("")).alias("instrument"), verdict.alias("verdict"))


def reject_key(link: Column, title: Column, funder: Column) -> Column:
    """What a rejected row is logged by: its link, else title and funder."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean(link) != "", F.concat(F.lit("l:"), clean(link))).otherwise(F.concat(F.lit("t:"), clean(title), F.lit("|"), clean(funder)))
