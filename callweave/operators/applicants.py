"""The applicant graph of a call: whose standing may back it, and the factors that are read over it.

An applicant is backed by itself, by its parent (ownership, no consent asked), by the call's lead applicant and by its
co-applicants, if these are active tenants that share their standing. Consulting another can only raise a score. Each
criterion belongs to a transfer class, the relations that it may consult: what makes an applicant eligible is its own.

Parents are followed along ownership edges, one step for scoring and all the way for `owners`; a cycle raises. Names are
resolved once for each distinct spelling; an applicant is never its own co-applicant. A null or empty cell names nobody.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import partners
from .catalogue import named_tenants
from .criteria import factor
from .joins import chain
from .ranking import top_per_group

SALTS = 16
SELF, PARENT, PRIME, CO = "self", "parent", "prime", "co-applicant"
#: Relations that a class of criteria may consult, the strongest first.
CLASSES: dict[str, tuple[str, ...]] = {
    "eligibility": (SELF,),
    "competitiveness": (SELF, PARENT),
    "relationship": (SELF, PARENT, PRIME, CO),
    "signatory": (SELF, PARENT, PRIME, CO),
}


def named_applicants(calls: DataFrame, tenants: DataFrame) -> DataFrame:
    """calls: (uid, tenant, lead, sub); tenants: (tenant, name, status, shares). (uid, cell, place, piece, named, standing) of each name in a cell.

    standing: ok, no consent, inactive or unresolved. The name stands for the first tenant by kind of match, then by number, that is not the applicant.
    """
    cell = lambda c, name: calls.select("uid", F.col("tenant").alias("own"), F.lit(name).alias("cell"), F.posexplode(partners(F.col(c))).alias("place", "piece"))
    pieces = cell("lead", "lead").union(cell("sub", "sub"))
    # a piece may stand in a share of all cells: only its best two tenants are met, by a small table of distinct spellings
    known = tenants.select(F.col("tenant").alias("named"), "status", "shares")
    active = F.lower(F.trim(F.coalesce(F.nullif("status", F.lit("")), F.lit("active")))) == "active"
    standing = F.when(~active, "inactive").when(~F.coalesce("shares", F.lit(False)), "no consent").otherwise("ok")
    names = pieces.select("piece").distinct().persist(StorageLevel.MEMORY_AND_DISK)  # read five times
    may = named_tenants(names, tenants).groupBy("piece", F.col("tenant").alias("named")).agg(F.min("rank").alias("rank"))
    best = top_per_group(may, ["piece"], [F.asc("rank"), F.asc("named")], 2).join(known, "named").select("piece", F.struct("place", "named", standing.alias("standing")).alias("m"))
    best = best.groupBy("piece").agg(F.array_sort(F.collect_list("m")).alias("best"))
    first = F.get(F.filter(F.col("best"), lambda m: ~m["named"].eqNullSafe(F.col("own"))), F.lit(0))
    # a frequent piece is dealt to SALTS tasks, and only the small side is held: pieces are not sorted
    dealt = best.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("shuffle_hash")
    met = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(dealt, ["piece", "salt"], "left").select("uid", "cell", "place", "piece", first.alias("m"))
    return met.select("uid", "cell", "place", "piece", F.col("m.named").alias("named"), F.coalesce("m.standing", F.lit("unresolved")).alias("standing"))


def backers(calls: DataFrame, tenants: DataFrame) -> DataFrame:
    """calls: (uid, tenant, role, lead, sub); tenants: (tenant, name, status, parent, shares). (uid, relation, place, tenant) of all whose standing may be read."""
    names = named_applicants(calls, tenants).where("standing = 'ok'")
    own = calls.select("uid", F.lit(SELF).alias("relation"), F.lit(0).alias("place"), "tenant")
    parents = tenants.select(F.col("tenant").alias("_t"), F.col("parent")).join(tenants.select(F.col("tenant").alias("parent")), "parent")
    above = calls.join(parents, F.col("tenant") == F.col("_t")).select("uid", F.lit(PARENT), F.lit(0), "parent")
    # dealt by call first: counted before the shuffle, a task would hold all calls that it reads
    leads = names.where("cell = 'lead'").select("uid", "place", "named").repartition("uid").groupBy("uid")
    first = leads.agg(F.min("place").alias("p"), F.min_by("named", "place").alias("n")).select("uid", F.lit(PRIME), "p", "n")
    others = names.where("cell = 'sub'").select("uid", F.lit(CO), "place", "named")
    return own.union(above).union(first).union(others)


def unresolved_primes(calls: DataFrame, tenants: DataFrame) -> DataFrame:
    """(uid) of calls in which the applicant is a sub and no named lead is a tenant that may be read."""
    leads = named_applicants(calls, tenants).where("cell = 'lead'").groupBy("uid").agg(F.max(F.col("standing") == "ok").alias("ok"))
    return calls.where(F.lower(F.trim("role")) == "sub").join(leads.where("not ok"), "uid", "left_semi").select("uid")


def owners(tenants: DataFrame) -> DataFrame:
    """tenants: (tenant, parent). Each tenant with all its owners up to the top; an owner above itself raises."""
    return chain(tenants.select("tenant", "parent"), "tenant", "parent")


def best_backed(calls: DataFrame, tenants: DataFrame, profiles: DataFrame, facts: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(uid, <fact>, <fact>_by): the best score of each fact over its class, and the first relation in order that has it.

    facts: name -> (class, score of a call's row (`call`) and a profile (`profile`), null where it says nothing). A score of
    0 is by nobody. One pass over the backers of all calls: no pair of calls or tenants is made.
    """
    order = {r: i for i, r in enumerate((SELF, PARENT, PRIME, CO))}
    rows = backers(calls, tenants).join(profiles.select(F.col("tenant").alias("_p"), F.struct(*profiles.columns).alias("profile")), F.col("tenant") == F.col("_p"), "left")
    rows = rows.join(calls.select(F.col("uid").alias("_u"), F.struct(*calls.columns).alias("call")), F.col("uid") == F.col("_u"))
    step = F.coalesce(*[F.when(F.col("relation") == r, F.lit(i)) for r, i in order.items()])
    cells = []
    for name, (kind, score) in facts.items():
        mine = F.when(F.col("relation").isin(*CLASSES[kind]), score)
        cells.append(F.max(F.when(mine.isNotNull(), F.struct(mine.alias("score"), (-step).alias("o"), (-F.col("place")).alias("p"), F.col("relation")))).alias(name))
    best = rows.groupBy("uid").agg(*cells)
    return best.select("uid", *[c for n in facts for c in (F.col(f"{n}.score").alias(n), F.when(F.col(f"{n}.score") > 0, F.col(f"{n}.relation")).alias(f"{n}_by"))])


# ---------------------------------------------------------------- factors


def share(part: Column, whole: Column) -> Column:
    """A rating against what the funder asks for: 1 from all of it, a half from half of it, else 0; null if either is missing."""
    return F.when(part.isNotNull() & (whole > 0), F.when(part / whole >= 1, 1.0).when(part / whole >= 0.5, 0.5).otherwise(0.0))


def holds(name: Column, names: Column) -> Column:
    """1 if the name, whatever its case and blanks, is among the names, 0 if not; null without a name."""
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    there = F.array_contains(F.transform(F.coalesce(names, F.array().cast("array<string>")), plain), plain(name))
    return F.when(plain(name) != "", there.cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """1 if the lists share a name, 0 if not, null if the first is missing or empty."""
    return F.when(F.size(a) > 0, F.coalesce(F.arrays_overlap(a, b), F.lit(False)).cast("double"))


def relationship_factors(grantee: Column, engaged: Column, contact: Column) -> Column:
    """Routes to the funder, any one of which satisfies."""
    return F.array(factor("rel_grantee", grantee.isNotNull(), grantee), factor("rel_engaged", engaged.isNotNull(), engaged), factor("rel_contact", contact.isNotNull(), contact))


def competitiveness_factors(track: Column, founded: Column, year: int, portal: Column, offered: Column, routes: Column, grassroots_asked: Column, grassroots: Column, multi_asked: Column, multi: Column, funder_home: Column, home: Column) -> Column:
    """Track record, age (five years), portal, funding route, grassroots, several countries, and a home shared with the funder, which never counts against."""
    same = (F.lower(F.trim(funder_home)) == F.lower(F.trim(home))) & (F.trim(home) != "")
    route = F.when((F.size(offered) > 0) & (F.size(routes) > 0), F.arrays_overlap(offered, routes).cast("double"))
    return F.array(
        factor("comp_track", track.isNotNull(), track),
        factor("comp_age", founded.isNotNull(), (F.lit(year) - founded >= 5).cast("double")),
        factor("comp_portal", F.lit(True), F.coalesce(portal, F.lit(0.0))),
        factor("comp_route", F.size(offered) > 0, route),
        factor("comp_grassroots", grassroots_asked, grassroots.cast("double")),
        factor("comp_multi", multi_asked, multi.cast("double")),
        factor("comp_hq", same, F.lit(1.0)),
    )


def bid_factors(days: Column, team: Column) -> Column:
    """Time left: more than two weeks 1, one to two a half, less 0; and a team for bids."""
    time = F.when(days > 14, 1.0).when(days >= 7, 0.5).when(days.isNotNull(), 0.0)
    return F.array(factor("bid_time", days.isNotNull(), time), factor("bid_team", team.isNotNull(), team.cast("double")))
