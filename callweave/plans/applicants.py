"""The applicant graph over the carriers: suppliers are tenants and applicants, orders are calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import applicants as op
from ..registry import query
from .carriers import read

YEAR = 2026
# a name that is no part of another: eight digits of a checksum of the number
_NAME = "concat('Institute ', substr(md5(cast({} as varchar(20))), 1, 8))"
_TENANT = f"""SELECT s_suppkey AS tenant, {_NAME.format('s_suppkey')} AS name, CASE WHEN s_suppkey % 11 = 0 THEN 'suspended' WHEN s_suppkey % 4 = 1 THEN 'Active ' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN cast(floor(s_suppkey / 4) as bigint) END AS parent, s_suppkey % 3 <> 0 AS shares FROM supplier"""
_CALL = f"""SELECT o_orderkey AS uid, o_custkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier) AS tenant, CASE o_orderkey % 3 WHEN 0 THEN ' Sub' WHEN 1 THEN 'lead' END AS role,
 CASE o_custkey % 4 WHEN 0 THEN concat({_NAME.format('o_custkey % 37 + 1')}, '; Nobody Known') WHEN 1 THEN upper({_NAME.format('o_custkey % 37 + 1')}) WHEN 2 THEN concat('Nobody Known, The ', {_NAME.format('o_custkey % 37 + 1')}, ' of Health') END AS lead,
 CASE WHEN o_orderkey % 5 < 2 THEN concat({_NAME.format('o_custkey % 23 + 5')}, '; ', {_NAME.format('o_custkey % 41 + 2')}) END AS sub FROM orders"""


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "supplier").createOrReplaceTempView("applicant_suppliers")
    return spark.sql(_TENANT.replace("FROM supplier", "FROM applicant_suppliers").replace("varchar(20)", "string"))


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "supplier").createOrReplaceTempView("applicant_suppliers")
    read(spark, sf_dir, "orders").createOrReplaceTempView("applicant_orders")
    return spark.sql(_CALL.replace("FROM supplier", "FROM applicant_suppliers").replace("FROM orders", "FROM applicant_orders").replace("varchar(20)", "string"))


#: What the SQL knows without reading names: which numbers stand in the cells.
_KNOWN = f"""t AS ({_TENANT}), c AS (SELECT x.*, o_custkey FROM ({_CALL}) x JOIN orders ON o_orderkey = uid),
 n AS (SELECT uid, tenant, 'lead' AS cell, CASE WHEN o_custkey % 4 = 2 THEN 1 ELSE 0 END AS place, o_custkey % 37 + 1 AS k FROM c WHERE o_custkey % 4 < 3
  UNION ALL SELECT uid, tenant, 'lead', CASE WHEN o_custkey % 4 = 2 THEN 0 ELSE 1 END, NULL FROM c WHERE o_custkey % 4 IN (0, 2)
  UNION ALL SELECT uid, tenant, 'sub', 0, o_custkey % 23 + 5 FROM c WHERE sub IS NOT NULL UNION ALL SELECT uid, tenant, 'sub', 1, o_custkey % 41 + 2 FROM c WHERE sub IS NOT NULL),
 a AS (SELECT n.uid, n.cell, n.place, t.tenant AS named, CASE WHEN t.tenant IS NULL THEN 'unresolved' WHEN status = 'suspended' THEN 'inactive' WHEN NOT shares THEN 'no consent' ELSE 'ok' END AS standing FROM n LEFT JOIN t ON t.tenant = k AND t.tenant <> n.tenant),
 b AS (SELECT uid, 'self' AS relation, 0 AS place, tenant FROM c UNION ALL SELECT uid, 'parent', 0, p.tenant FROM c JOIN t USING (tenant) JOIN t p ON p.tenant = t.parent
  UNION ALL SELECT uid, 'prime', min(place), arg_min(named, place) FROM a WHERE cell = 'lead' AND standing = 'ok' GROUP BY uid UNION ALL SELECT uid, 'co-applicant', place, named FROM a WHERE cell = 'sub' AND standing = 'ok')"""


@query(f"WITH {_KNOWN} SELECT uid, relation, CAST(place AS INTEGER) AS place, tenant FROM b")
def applicant_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose standing may be read for each call: the applicant, its parent, the first lead and all co-applicants that consent."""
    return op.backers(calls_of(spark, sf_dir), tenants(spark, sf_dir))


@query(f"WITH {_KNOWN} SELECT uid, cell, CAST(place AS INTEGER) AS place, named, standing FROM a")
def named_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.named_applicants(calls_of(spark, sf_dir), tenants(spark, sf_dir)).select("uid", "cell", "place", "named", "standing")


@query(f"WITH {_KNOWN} SELECT c.uid FROM c WHERE lower(trim(role)) = 'sub' AND EXISTS (SELECT 1 FROM a WHERE a.uid = c.uid AND cell = 'lead') AND NOT EXISTS (SELECT 1 FROM a WHERE a.uid = c.uid AND cell = 'lead' AND standing = 'ok')")
def unresolved_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unresolved_primes(calls_of(spark, sf_dir), tenants(spark, sf_dir))


_DAYS = "uid % 23"
_BEST = lambda score, cls: f"max(CASE WHEN relation IN ({', '.join(repr(r) for r in op.CLASSES[cls])}) THEN {score} END)"
_BY = lambda score, cls: f"arg_min(relation, CASE relation WHEN 'self' THEN 0 WHEN 'parent' THEN 1 WHEN 'prime' THEN 2 ELSE 3 END) FILTER (relation IN ({', '.join(repr(r) for r in op.CLASSES[cls])}) AND {score} > 0)"
_GRANTEE, _CONTACT, _ENGAGED, _SIGNS = "CAST(uid % 9 IN (b.tenant % 9, b.tenant % 7) AS DOUBLE)", "CAST(b.tenant % 11 IN (uid % 11, uid * 3 % 11) AS DOUBLE)", "CAST(uid % 9 = b.tenant % 13 AS DOUBLE)", "CAST(b.tenant % 17 = uid % 9 AS DOUBLE)"
_TRACK = "CASE WHEN uid % 6 > 0 THEN CASE WHEN (b.tenant % 6) * 1.0 / (uid % 6) >= 1 THEN 1.0 WHEN (b.tenant % 6) * 1.0 / (uid % 6) >= 0.5 THEN 0.5 ELSE 0.0 END END"


@query(f"""WITH {_KNOWN}, s AS (SELECT b.*, c.tenant AS own FROM b JOIN c USING (uid)),
 f AS (SELECT uid, any_value(own) AS own, {_BEST(_GRANTEE, 'relationship')} AS grantee, {_BY(_GRANTEE, 'relationship')} AS grantee_by, {_BEST(_ENGAGED, 'relationship')} AS engaged, {_BEST(_CONTACT, 'relationship')} AS contact, {_BY(_CONTACT, 'relationship')} AS contact_by,
  {_BEST(_SIGNS, 'signatory')} AS signs, {_BY(_SIGNS, 'signatory')} AS signs_by, CAST({_BEST(_TRACK, 'competitiveness')} AS DOUBLE) AS track FROM s b GROUP BY uid),
 r AS (SELECT f.*, unnest([
  {{'key': 'rel_grantee', 'active': true, 'score': grantee, 'by': grantee_by}}, {{'key': 'rel_engaged', 'active': true, 'score': CASE uid % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE engaged END, 'by': NULL}}, {{'key': 'rel_contact', 'active': true, 'score': contact, 'by': contact_by}},
  {{'key': 'signatory', 'active': true, 'score': signs, 'by': signs_by}}, {{'key': 'comp_track', 'active': track IS NOT NULL, 'score': track, 'by': NULL}},
  {{'key': 'comp_age', 'active': own % 8 > 0, 'score': CASE WHEN own % 8 > 0 THEN CAST({YEAR} - (2012 + own % 14) >= 5 AS DOUBLE) END, 'by': NULL}}, {{'key': 'comp_portal', 'active': true, 'score': CAST(own % 5 = uid % 5 AS DOUBLE), 'by': NULL}},
  {{'key': 'comp_route', 'active': uid % 4 > 0, 'score': CASE WHEN uid % 4 > 0 AND own % 3 > 0 THEN CAST(own % 3 = uid % 4 AS DOUBLE) END, 'by': NULL}}, {{'key': 'comp_grassroots', 'active': uid % 7 = 1, 'score': CASE WHEN uid % 7 = 1 THEN CAST(own % 2 = 0 AS DOUBLE) END, 'by': NULL}},
  {{'key': 'comp_multi', 'active': uid % 7 = 2, 'score': CASE WHEN uid % 7 = 2 THEN CAST(own % 5 = 0 AS DOUBLE) END, 'by': NULL}}, {{'key': 'comp_hq', 'active': own % 6 = uid % 6, 'score': CASE WHEN own % 6 = uid % 6 THEN 1.0 END, 'by': NULL}},
  {{'key': 'bid_time', 'active': uid % 23 > 0, 'score': CASE WHEN {_DAYS} > 14 THEN 1.0 WHEN {_DAYS} >= 7 THEN 0.5 WHEN {_DAYS} > 0 THEN 0.0 END, 'by': NULL}}, {{'key': 'bid_team', 'active': true, 'score': CAST(own % 4 = 0 AS DOUBLE), 'by': NULL}}]) AS x FROM f)
 SELECT x.key AS key, x.by AS by, CAST(count(*) FILTER (x.active) AS BIGINT) AS active, CAST(sum(x.score) AS DOUBLE) AS total, CAST(sum(CASE WHEN x.score > 0 THEN uid END) AS BIGINT) AS of_uids, CAST(sum(CASE WHEN x.score > 0 THEN uid * uid % 1009 END) AS BIGINT) AS mixed FROM r GROUP BY 1, 2""")
def applicant_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship, competitiveness and bid factors of all calls, by factor and by whose standing decides."""
    calls, people = calls_of(spark, sf_dir), tenants(spark, sf_dir)
    u, k = F.col("call.uid"), F.col("profile.tenant")
    names = lambda *xs: F.array(*[F.concat(F.lit("Fund "), x.cast("string")) for x in xs])
    funder = F.concat(F.lit(" fund  "), (u % 9).cast("string"))
    facts = {
        "grantee": ("relationship", op.holds(funder, names(k % 9, k % 7))),
        "engaged": ("relationship", op.holds(funder, names(k % 13))),
        "contact": ("relationship", op.overlap(F.array(u % 11, u * 3 % 11), F.array(k % 11))),
        "signs": ("signatory", op.holds(funder, names(k % 17))),
        "track": ("competitiveness", op.share((k % 6).cast("double"), (u % 6).cast("double"))),
    }
    best = op.best_backed(calls, people, people.select("tenant"), facts).join(calls.select("uid", F.col("tenant").alias("own")), "uid")
    u, k = F.col("uid"), F.col("own")
    said = F.when(u % 10 == 0, 1.0).when(u % 10 == 1, 0.5).when(u % 10 == 2, 0.0)
    relation = op.relationship_factors(F.col("grantee"), F.coalesce(said, F.col("engaged")), F.col("contact"))
    edge = op.competitiveness_factors(
        F.col("track"), F.when(k % 8 > 0, 2012 + k % 14), YEAR, (k % 5 == u % 5).cast("double"), F.when(u % 4 > 0, F.array(u % 4)).otherwise(F.array().cast("array<bigint>")),
        F.when(k % 3 > 0, F.array(k % 3)).otherwise(F.array().cast("array<bigint>")), u % 7 == 1, k % 2 == 0, u % 7 == 2, k % 5 == 0, (u % 6).cast("string"), (k % 6).cast("string"),
    )
    bid = op.bid_factors(F.when(u % 23 > 0, u % 23), k % 4 == 0)
    signs = F.array(op.factor("signatory", F.col("signs").isNotNull(), F.col("signs")))
    rows = best.select("uid", "grantee_by", "contact_by", "signs_by", F.explode(F.concat(relation, signs, edge, bid)).alias("x"))
    by = F.when(F.col("x.key") == "rel_grantee", F.col("grantee_by")).when(F.col("x.key") == "rel_contact", F.col("contact_by")).when(F.col("x.key") == "signatory", F.col("signs_by"))
    hit = F.col("x.score") > 0
    return rows.groupBy(F.col("x.key").alias("key"), by.alias("by")).agg(F.count_if("x.active").alias("active"), F.sum("x.score").alias("total"), F.sum(F.when(hit, F.col("uid"))).alias("of_uids"), F.sum(F.when(hit, F.col("uid") * F.col("uid") % 1009)).alias("mixed"))
