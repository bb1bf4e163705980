"""Scores: criteria, gates, recommendations, capacity, fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def alignment(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of criteria in per cent, one decimal, half to even; an unscored criterion counts a half."""
    total = sum(weights.values())
    parts = [F.lit(w) * F.coalesce(scores[k], F.lit(0.5)) for k, w in weights.items()]
    summed = parts[0]
    for p in parts[1:]:
        summed = summed + p
    return F.bround(100 * summed / total, 1)


def recommend(score: Column, fatal: Column, proceed: float = 90, park: float = 70, floor: Column | None = None) -> Column:
    """Fatal declines; a row below the floor parks where it would proceed."""
    high = score >= proceed
    go = F.when(high & ~F.coalesce(floor, F.lit(True)), "Park").when(high, "Proceed") if floor is not None else F.when(high, "Proceed")
    return F.when(F.coalesce(fatal, F.lit(False)), "Decline").otherwise(F.coalesce(go, F.when(score >= park, "Park"), F.lit("Decline")))


def legacy_recommend(score: Column, decline: Column) -> Column:
    return F.when(F.coalesce(decline, F.lit(False)), "Decline").when(score >= 70, "Proceed").when(score >= 45, "Park").otherwise("Decline")


def decline_flag(must: Sequence[Column], prefer: Sequence[Column]) -> Column:
    """Any missed MUST, or two missed PREFER; nulls never decline."""
    missed = lambda cs: F.size(F.filter(F.array(*cs), lambda x: x == 0))
    return (missed(must) > 0) | (missed(prefer) >= 2)


def overridden(name: str, computed: Column, overrides: Column) -> Column:
    """An override wins, even a null one, which clears; a name without one keeps its score."""
    return F.when(F.coalesce(F.map_contains_key(overrides, F.lit(name)), F.lit(False)), F.element_at(overrides, F.lit(name))).otherwise(computed)


def bid_effort(days: Column, team: Column) -> Column:
    """Six labels from time left and team size; unknown counts as ample."""
    long, short = F.coalesce(days >= 14, F.lit(True)), F.coalesce(days >= 7, F.lit(True))
    big = F.coalesce(team >= 3, F.lit(True))
    return F.when(long & big, "Ample").when(long, "Comfortable").when(short & big, "Tight").when(short, "Very tight").when(big, "Rushed").otherwise("Not feasible")


def capacity(ask: Column, anchor: Column, factor: Column) -> Column:
    """1 within the anchor, a half within the anchor times the factor, else 0; null if either is unknown."""
    return F.when(ask.isNull() | anchor.isNull(), F.lit(None).cast("double")).when(ask <= anchor, 1.0).when(ask <= anchor * factor, 0.5).otherwise(0.0)


def geometric_bands(value: Column, low: Column, mid: Column, high: Column) -> Column:
    """0, a half or 1 by the geometric midpoints between low, mid and high."""
    return F.when(value < F.sqrt(low * mid), 0.0).when(value < F.sqrt(mid * high), 0.5).when(value.isNotNull(), 1.0)


def qualification(factors: Sequence[Column]) -> Column:
    """No if any factor is 0, Mostly if any is a half, Yes if all are 1; no active factor: Not sure."""
    active = F.array_compact(F.array(*factors))
    return F.when(F.size(active) == 0, "Not sure").when(F.exists(active, lambda x: x == 0), "No").when(F.exists(active, lambda x: x == 0.5), "Mostly").otherwise("Yes")


def confidence(call: Column, donor: Column) -> tuple[Column, Column]:
    """(score, band) of how much is known."""
    score = F.bround(0.6 * call + 0.4 * donor, 0)
    return score, F.when(score >= 75, "High").when(score >= 45, "Medium").otherwise("Low")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The reason of the first rule that rejects, in order; null if none does. CASE stops at the first."""
    out = F.when(F.lit(False), F.lit(""))
    for reason, condition in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(reason))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def decision_tree(must: Sequence[Column], prefer: Sequence[Column]) -> Column:
    """From counts of met criteria: any missed MUST declines; all MUST and half of the PREFER met proceeds; else park."""
    count = lambda cs, v: F.size(F.filter(F.array(*cs), lambda x: x == v))
    met = (count(must, 1.0) == len(must)) & (2 * count(prefer, 1.0) >= len(prefer))
    return F.when(count(must, 0.0) > 0, "Decline").when(met, "Proceed").otherwise("Park")


def band(level: Column) -> Column:
    """Priorities 0 to 5 in three bands: 0-1, 2-3, 4-5."""
    return F.when(level.isNull(), F.lit(None).cast("double")).when(level >= 4, 1.0).when(level >= 2, 0.5).otherwise(0.0)


def strategic_fit(ours: Column, theirs: Column) -> Column:
    """Best theme of the funder: the lower of both bands on it; null without themes. Maps of theme to priority."""
    fits = F.transform(F.map_entries(theirs), lambda e: F.least(band(F.coalesce(F.try_element_at(ours, e["key"]), F.lit(0))), band(e["value"])))
    return F.when((F.size(theirs) > 0), F.array_max(fits))


def compliance(factors: Sequence[Column]) -> Column:
    """Not met if any factor is 0, Partial if any is a half, Met if all are 1; none known: Not sure."""
    active = F.array_compact(F.array(*factors))
    return F.when(F.size(active) == 0, "Not sure").when(F.exists(active, lambda x: x == 0), "Not met").when(F.exists(active, lambda x: x == 0.5), "Partial").otherwise("Met")


def relationship(grantee: Column, contact: Column, known: Column) -> Column:
    return F.when(F.coalesce(grantee, F.lit(False)), "Current/past grantee").when(F.coalesce(contact, F.lit(False)), "Some contact").when(F.coalesce(known, F.lit(False)), "None")


def competitiveness(signals: Sequence[Column]) -> Column:
    """Signed signals summed: from 1 Strong, to -0.5 Weak, else Moderate; none known: Not sure."""
    return competitiveness_of(F.array_compact(F.array(*signals)))


def competitiveness_of(active: Column) -> Column:
    """competitiveness() of an array without nulls."""
    total = F.aggregate(active, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(active) == 0, "Not sure").when(total >= 1, "Strong").when(total <= -0.5, "Weak").otherwise("Moderate")


def won(scores: Sequence[Column]) -> Column:
    """(won, total) over active factors; nothing determined counts 1 of 2."""
    active = F.array_compact(F.array(*scores))
    return F.when(F.size(active) == 0, F.struct(F.lit(1.0).alias("won"), F.lit(2).alias("total"))).otherwise(F.struct(F.aggregate(active, F.lit(0.0), lambda s, x: s + x).alias("won"), F.size(active).alias("total")))


def overlay(base: Column, top: Column) -> Column:
    """Entries of both maps; the upper one wins."""
    return F.map_from_entries(F.concat(F.map_entries(top), F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(top, e["key"]))))


def stated(call: Column, donor: Column, cleared: str = "not imposed") -> Column:
    """What the call states wins, "not imposed" clears, a silent call leaves the donor's."""
    return F.when(F.lower(F.trim(call)) == cleared, F.lit(None).cast("string")).when(F.trim(F.coalesce(call, F.lit(""))) != "", call).otherwise(donor)
