"""Money and currency columns, natively."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units per dollar's worth, for want of a live rate.
RATES = {"USD": 1.0, "EUR": 1.1, "GBP": 1.25, "CHF": 1.1, "CAD": 0.75, "KES": 0.0078}
_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP"}
_CODE = "|".join([*RATES, *(re.escape(s) for s in _SIGNS)])
#: Words and letters after a number, and what they multiply it by.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "k": 1e3, "mn": 1e6, "m": 1e6, "bn": 1e9, "b": 1e9}
_SCALE = "|".join(SCALES)
#: A run of digits with commas and points inside; number() tells by its groups what of it is the number.
_RUN = "[0-9](?:[0-9,.]*[0-9])?"
MONEY = rf"(?i)(?:({_CODE})\s*({_RUN})\s*({_SCALE})?\b|({_RUN})\s*({_SCALE})?\s*({_CODE}))"


def number(run: Column, scale: Column) -> Column:
    """The value of a run of digits: groups after commas count if each has three digits and the first at most three, else the first group alone."""
    parts = F.split(run, "[.]")
    groups = F.split(F.get(parts, F.lit(0)), ",")
    later = F.slice(groups, 2, F.greatest(F.size(groups), F.lit(1)))
    whole = (F.size(later) == 0) | ((F.length(F.get(groups, F.lit(0))) <= 3) & F.forall(later, lambda g: F.length(g) == 3))
    after = F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "^[0-9]*", 0)
    value = F.when(whole, F.concat(F.array_join(groups, ""), F.lit("."), after, F.lit("0"))).otherwise(F.get(groups, F.lit(0)))
    factor = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return value.try_cast("double") * F.coalesce(F.try_element_at(factor, F.lower(scale)), F.lit(1.0))


def amounts(text: Column) -> Column:
    """All (amount, currency) of a text, the code before or after the number."""
    part = lambda x, i: F.regexp_extract(x, f"^{MONEY}$", i)

    def read(x: Column) -> Column:
        value = F.when(part(x, 2) != "", number(part(x, 2), part(x, 3))).otherwise(number(part(x, 4), part(x, 5)))
        code = F.upper(F.when(part(x, 1) != "", part(x, 1)).otherwise(part(x, 6)))
        for sign, name in _SIGNS.items():
            code = F.when(code == sign, name).otherwise(code)
        return F.struct(value.alias("amount"), code.alias("currency"))

    return F.transform(F.regexp_extract_all(text, F.lit(MONEY), 0), lambda x: read(F.trim(x)))


def largest(text: Column) -> Column:
    return F.array_max(amounts(text))


def money_text(text: Column) -> Column:
    """'$0.150M', '150k', '1,200' as a number."""
    bare = F.regexp_replace(F.trim(text), r"^[^\d]*", "")
    return number(F.nullif(F.regexp_extract(bare, rf"^({_RUN})", 1), F.lit("")), F.regexp_extract(bare, rf"(?i)^{_RUN}\s*({_SCALE})?", 1))


def rate(currency: Column, rates: Mapping[str, float] = RATES) -> Column:
    """Dollars per unit; null where unknown."""
    out = F.when(F.lit(False), F.lit(0.0))
    for code, value in rates.items():
        out = out.when(currency == code, F.lit(float(value)))
    return out


def in_dollars(amount: Column, currency: Column, unknown_as_dollars: bool = False) -> Column:
    """Extraction leaves unknown currencies null; reports take them as dollars and count them."""
    r = rate(currency)
    return amount * (F.coalesce(r, F.lit(1.0)) if unknown_as_dollars else r)


def grounded(value: Column, text: Column, tolerance: float = 0.01) -> Column:
    """Whether the text states the value within the tolerance."""
    return F.exists(amounts(text), lambda x: F.abs(x["amount"] - value) <= tolerance * F.abs(value))
