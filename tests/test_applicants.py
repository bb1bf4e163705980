"""Whose standing backs an applicant: small cases in the manner of a plain reading."""

import pytest
from pyspark.sql import functions as F

from callweave.operators import applicants as op

TENANTS = [
    (1, "Child Clinic", None, 2, False),
    (2, "Parent Health Trust", "active", None, False),
    (3, "Prime Research Institute", "ACTIVE", None, True),
    (4, "Shy Partner Group", "active", None, False),
    (5, "Closed Alliance", "suspended", None, True),
    (6, "Open Partner Network", "", 99, True),
]
PROFILES = [(1, [], None), (2, ["Wellcome"], 4.0), (3, ["Gates"], 5.0), (4, ["Gates"], 5.0), (5, ["Gates"], 5.0), (6, ["Novo"], 5.0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(TENANTS, "tenant long, name string, status string, parent long, shares boolean")


def calls(spark, *rows):
    return spark.createDataFrame(rows, "uid long, tenant long, role string, lead string, sub string, funder string")


def test_names_and_their_standing(spark, people):
    c = calls(spark, (10, 1, "sub", "PRIME research institute; PRI", "Shy Partner Group, Closed Alliance; the Open Partner Network Ltd", "x"), (11, 1, "sub", "Child Clinic", None, "x"), (12, 3, None, "", " ; ", "x"), (13, None, "sub", "Nobody", "OPN", None))
    got = {(r.uid, r.cell, r.place): (r.named, r.standing) for r in op.named_applicants(c, people).collect()}
    assert got == {
        (10, "lead", 0): (3, "ok"), (10, "lead", 1): (3, "ok"), (10, "sub", 0): (4, "no consent"), (10, "sub", 1): (5, "inactive"), (10, "sub", 2): (6, "ok"),
        (11, "lead", 0): (None, "unresolved"), (13, "lead", 0): (None, "unresolved"), (13, "sub", 0): (6, "ok"),
    }
    assert sorted((r.uid) for r in op.unresolved_primes(c, people).collect()) == [11, 13]
    backed = sorted((r.uid, r.relation, r.place, r.tenant) for r in op.backers(c, people).where("tenant is not null").collect())
    assert backed == [(10, "co-applicant", 2, 6), (10, "parent", 0, 2), (10, "prime", 0, 3), (10, "self", 0, 1), (11, "parent", 0, 2), (11, "self", 0, 1), (12, "self", 0, 3), (13, "co-applicant", 0, 6)]


def test_a_parents_grant_or_a_partners_decides_but_not_for_eligibility(spark, people):
    profiles = spark.createDataFrame(PROFILES, "tenant long, funders array<string>, rating double")
    c = calls(spark, (1, 1, None, None, None, "wellcome "), (2, 1, "sub", "Prime Research Institute", None, "Gates"), (3, 1, None, None, "Shy Partner Group", "Gates"), (4, 1, None, None, "Open Partner Network", "NOVO"), (5, 6, None, None, None, "Novo"), (6, 1, None, None, None, None))
    held = op.holds(F.col("call.funder"), F.col("profile.funders"))
    facts = {"grantee": ("relationship", held), "eligible": ("eligibility", held), "track": ("competitiveness", op.share(F.col("profile.rating"), F.lit(5.0)))}
    got = {r.uid: (r.grantee, r.grantee_by, r.eligible, r.track, r.track_by) for r in op.best_backed(c, people, profiles, facts).collect()}
    assert got == {
        1: (1.0, "parent", 0.0, 0.5, "parent"), 2: (1.0, "prime", 0.0, 0.5, "parent"), 3: (0.0, None, 0.0, 0.5, "parent"), 4: (1.0, "co-applicant", 0.0, 0.5, "parent"),
        5: (1.0, "self", 1.0, 1.0, "self"), 6: (None, None, None, 0.5, "parent"),
    }


def test_consulting_another_never_lowers(spark, people):
    profiles = spark.createDataFrame([(1, ["Gates"], 5.0), (2, [], 1.0)], "tenant long, funders array<string>, rating double")
    c = calls(spark, (1, 1, None, None, None, "Gates"))
    got = op.best_backed(c, people, profiles, {"track": ("competitiveness", op.share(F.col("profile.rating"), F.lit(5.0)))}).first()
    assert (got.track, got.track_by) == (1.0, "self")


def test_owners_to_the_top_and_cycles(spark, people):
    more = people.select("tenant", "parent").where("tenant <> 6").union(spark.createDataFrame([(7, 1)], "tenant long, parent long"))
    assert {(r.node, r.ancestor, r.hops) for r in op.owners(more).where("hops > 0").collect()} == {(1, 2, 1), (7, 1, 1), (7, 2, 2)}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "tenant long, parent long")
    with pytest.raises(ValueError):
        op.owners(cycle).collect()


def test_factors(spark):
    empty = F.array().cast("array<string>")
    edge = op.competitiveness_factors(F.lit(0.5), F.lit(2022), 2026, F.lit(None).cast("double"), F.array(F.lit("grant")), empty, F.lit(False), F.lit(True), F.lit(True), F.lit(False), F.lit(" Kenya"), F.lit("kenya"))
    got = {x.key: (x.active, x.score) for x in spark.range(1).select(F.concat(edge, op.bid_factors(F.lit(7), F.lit(None).cast("boolean"))).alias("x")).first().x}
    assert got == {"comp_track": (True, 0.5), "comp_age": (True, 0.0), "comp_portal": (True, 0.0), "comp_route": (True, None), "comp_grassroots": (False, None), "comp_multi": (True, 0.0), "comp_hq": (True, 1.0), "bid_time": (True, 0.5), "bid_team": (False, None)}


def test_frequent_names_are_not_gathered(spark, people):
    """Names meet tenants without a sort of all cells, each spelling is read once, and no aggregate holds a scan's calls."""
    rows = [(i, 1, "sub", "Nobody Known; Prime Research Institute", "Nobody Known", "x") for i in range(200)]
    names = op.named_applicants(calls(spark, *rows), people)
    plan = names._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "salt" in plan and "InMemoryRelation" in names._jdf.queryExecution().withCachedData().toString()
    assert {(r.cell, r.place, r.named, r.standing, r["count"]) for r in names.groupBy("cell", "place", "named", "standing").count().collect()} == {("lead", 0, None, "unresolved", 200), ("lead", 1, 3, "ok", 200), ("sub", 0, None, "unresolved", 200)}
    assert "partial_min(struct" not in op.backers(calls(spark, *rows[:1]), people)._jdf.queryExecution().sparkPlan().toString()
