"""Criteria of calls for applicants: orders are calls, customers their funders, suppliers the applicants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import criteria as op
from ..registry import query
from .carriers import AS_OF, read, spread

_KEYS = "o_orderkey AS uid, o_totalprice AS total, c_custkey AS ck, c_acctbal AS cb, c_mktsegment AS seg, cn.n_name AS cn, cr.r_name AS cr, s_suppkey AS sk, s_acctbal AS sb, sn.n_name AS sn, sr.r_name AS sr"

#: Each side's scalar fields over the base columns, in SQL that both engines read alike.
ORG = {
    "legal_type": "CASE sk % 5 WHEN 0 THEN 'NonProfit' WHEN 1 THEN 'for-profit' WHEN 2 THEN 'University' WHEN 3 THEN ' charity' END",
    "entity_type": "CASE sk % 3 WHEN 0 THEN 'Local' WHEN 1 THEN 'international' END",
    "hq_country": "CASE WHEN sk % 4 <> 3 THEN sn END",
    "annual_budget": "CASE WHEN sk % 4 <> 0 THEN sb * 30 END",
    "largest_grant": "CASE WHEN uid % 3 <> 0 THEN cb * 12 END",
    "grants_count": "uid % 25",
    "founding_year": "CASE WHEN sk % 6 <> 0 THEN 1998 - (uid % 30) END",
    "stage": "CASE sk % 4 WHEN 0 THEN 'Mature' WHEN 1 THEN 'start-up' WHEN 2 THEN 'unknown' END",
    "min_target": "CASE WHEN sk % 5 <> 0 THEN 20000 + sk * 1000 END",
    "mid_target": "60000",
    "max_target": "CASE WHEN sk % 7 <> 0 THEN 120000 + sk * 5000 END",
    "cofinancing_capacity": "CASE uid % 5 WHEN 0 THEN 'Strong' WHEN 1 THEN 'limited' WHEN 2 THEN 'none' WHEN 3 THEN 'moderate' END",
    "prefinance_capacity": "CASE sk % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'limited' ELSE '' END",
    "indirect_cost_rate": "CASE sk % 3 WHEN 0 THEN '12 %' WHEN 1 THEN '7' END",
    "has_invitation": "uid % 3 = 0",
    "has_established_pi": "sk % 2 = 0",
    "has_audit_report": "sk % 2 = 1",
    "has_sam_uei": "sk % 3 = 0",
    "has_local_board": "CASE sk % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END",
    "is_grassroot": "sk % 2 = 0",
    "is_multi_country": "sk % 3 = 1",
    "has_team": "sk % 2 = 1",
    "track_record": "CASE WHEN sk % 4 <> 1 THEN uid % 6 END",
}
CALL = {
    "title": "CASE WHEN uid % 23 = 0 THEN 'Award for early-career investigators' WHEN uid % 29 = 0 THEN 'Round by invitation only' ELSE 'Call for proposals' END",
    "value_usd": "CASE WHEN uid % 11 <> 0 THEN total END",
    "award_ceiling": "CASE WHEN uid % 9 = 0 THEN total * 2 END",
    "duration_months": "CASE WHEN uid % 6 <> 5 THEN uid % 20 END",
    "currency": "CASE uid % 4 WHEN 0 THEN 'CAD' WHEN 1 THEN 'inr' WHEN 2 THEN 'USD' END",
    "us_federal": "uid % 31 = 0",
    "deadline": f"date_add(DATE '{AS_OF}', CAST(uid % 40 - 10 AS INT))",
    "progress": "CASE WHEN uid % 10 = 0 THEN 'Completed' END",
}
DONOR = {
    "name": "seg",
    "ngo_eligible": "CASE ck % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'not_sure' END",
    "for_profit_eligible": "CASE ck % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'not_sure' END",
    "entity_type_required": "CASE WHEN ck % 6 = 0 THEN 'local' END",
    "requires_pi": "ck % 10 = 0",
    "prior_beneficiary_rule": "CASE ck % 9 WHEN 0 THEN 'ineligible_current' WHEN 1 THEN 'ineligible_previous' WHEN 2 THEN 'ineligible_any' END",
    "invitation_only": "ck % 11 = 0",
    "max_annual_budget": "CASE WHEN ck % 5 = 0 THEN 150000.0 END",
    "max_prior_grant": "CASE WHEN ck % 6 = 0 THEN 60000.0 END",
    "experience_required": "CASE ck % 7 WHEN 0 THEN '5+' WHEN 1 THEN 'significant' WHEN 2 THEN '10 years' WHEN 3 THEN 'Some' WHEN 4 THEN 'n/a' END",
    "stage_required": "CASE ck % 12 WHEN 0 THEN 'early' WHEN 1 THEN 'established' END",
    "cofinancing_required": "CASE ck % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END",
    "cost_sharing_required": "ck % 3 = 0",
    "prefinance_required": "CASE WHEN ck % 5 = 1 THEN 'yes' END",
    "audit_report_required": "ck % 6 = 2",
    "sam_uei_required": "ck % 13 = 0",
    "indirect_cost_max_pct": "CASE WHEN ck % 3 = 0 THEN '10%' END",
    "indirect_cost_disallowed": "ck % 17 = 1",
    "local_board_required": "ck % 7 = 3",
    "partnership_mandatory": "ck % 9 = 4",
    "grassroots_preferred": "ck % 5 = 2",
    "multi_country_required": "ck % 8 = 5",
    "area_priority": "CASE WHEN ck % 3 = 1 THEN ck % 6 END",
    "hq_country": "CASE WHEN ck % 2 = 0 THEN cn END",
}
#: Lists of at most two values each, null ones left out.
LISTS = {
    "org": {"registered_countries": ("sn",), "operating_countries": ("CASE WHEN sk % 2 = 0 THEN cn END",), "active_donors": ("CASE WHEN sk % 3 = 0 THEN 'BUILDING' END", "CASE WHEN sk % 2 = 0 THEN 'Machinery' END"), "funder_history": ("CASE WHEN sk % 3 = 1 THEN 'household' END", "CASE WHEN sk % 5 = 0 THEN 'AUTO' END"), "engaged_donors": ("CASE WHEN sk % 4 = 0 THEN 'furniture' END",), "donor_registrations": ("CASE WHEN sk % 7 = 0 THEN 'Building' END",), "partners": ("CASE WHEN sk % 4 = 2 THEN 'X' END",)},
    "call": {"scope": ("CASE uid % 4 WHEN 0 THEN cr WHEN 1 THEN cn WHEN 2 THEN sn END",), "eligibility_countries": ("CASE uid % 5 WHEN 0 THEN cr WHEN 1 THEN 'the moon' WHEN 2 THEN sn END",)},
    "donor": {"hq_country_required": ("CASE ck % 7 WHEN 0 THEN cr WHEN 1 THEN 'Any' END",), "registration_region": ("CASE ck % 8 WHEN 0 THEN 'Worldwide' WHEN 1 THEN cr END",)},
}


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, org, call, donor): every call with its funder and one applicant. Fixed dimensions of 25 and 5 rows are broadcast."""
    o, c, s, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "nation", "region"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    people = c.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS ck", "c_acctbal AS cb", "c_mktsegment AS seg", "n_name AS cn", "r_name AS cr")
    # ten applicants, whatever the scale
    ours = s.where("s_suppkey <= 10").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS sk", "s_acctbal AS sb", "n_name AS sn", "r_name AS sr")
    base = o.selectExpr("o_orderkey AS uid", "o_totalprice AS total", "o_custkey").join(people, F.col("o_custkey") == F.col("ck")).join(F.broadcast(ours), F.col("uid") % 10 + 1 == F.col("sk"))
    themes = {
        "org": {"priorities": F.create_map(F.lit("health"), (F.col("sk") % 6).cast("int"), F.lit("water"), (F.col("uid") % 6).cast("int"))},
        "call": {"themes": F.when(F.col("uid") % 3 == 0, F.create_map(F.lit("water"), (F.col("ck") % 6).cast("int"), F.lit("art"), F.lit(5)))},
        "donor": {"themes": F.when(F.col("ck") % 4 != 0, F.create_map(F.lit("health"), (F.col("ck") % 6).cast("int")))},
    }
    side = lambda name, fields: F.struct(
        *[F.expr(e).alias(k) for k, e in fields.items()], *[F.array_compact(F.array(*map(F.expr, es))).alias(k) for k, es in LISTS[name].items()], *[m.alias(k) for k, m in themes[name].items()]
    ).alias(name)
    # few bytes a row, but long to derive: dealt after the joins, whose tasks are planned by bytes
    return spread(base).select("uid", side("org", ORG), side("call", CALL), side("donor", DONOR))


def regions(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The gazetteer of the tables: 5 regions, 25 nations."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).collect()
    return {r.r_name: r.names for r in rows}


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.derived(sides(spark, sf_dir), AS_OF, regions(spark, sf_dir))


_FLAT = ", ".join(f"{e.replace('date_add(', '(').replace(', CAST(uid', ' + CAST(uid')} AS {side}_{k}" for side, fields in (("o", ORG), ("c", CALL), ("d", DONOR)) for k, e in fields.items())
_LISTED = ", ".join(f"list_filter([{', '.join(es)}], lambda x: x IS NOT NULL) AS {side[0]}_{k}" for side, fields in LISTS.items() for k, es in fields.items())
_BASE = f"""b AS (SELECT {_KEYS} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN supplier ON s_suppkey = o_orderkey % 10 + 1 JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey),
 t AS (SELECT *, {_FLAT}, {_LISTED} FROM b)"""
_HAS = "(len(list_filter({names}, lambda x: lower(x) = lower(seg) OR (length(x) >= 4 AND length(seg) >= 4 AND (contains(lower(x), lower(seg)) OR contains(lower(seg), lower(x)))))) > 0)"
_NOW, _PAST, _ENGAGED, _SIGNED = (_HAS.format(names=f"o_{k}") for k in ("active_donors", "funder_history", "engaged_donors", "donor_registrations"))
_WITHIN = "(len(list_filter({places}, lambda x: x IN ({names}))) > 0)"
_LEGAL = "lower(trim(o_legal_type))"

_Q = f"""q AS (SELECT *,
  CASE WHEN own <> '' THEN CASE WHEN own = 'yes' THEN 1.0 WHEN own = 'no' THEN 0.0 WHEN d_ngo_eligible = 'yes' OR d_for_profit_eligible = 'yes' THEN 0.0 ELSE 1.0 END END AS applicant_type,
  CASE WHEN d_entity_type_required <> '' AND o_entity_type <> '' THEN CAST(lower(o_entity_type) = d_entity_type_required AS DOUBLE) END AS entity_type,
  CASE WHEN ck % 7 = 0 THEN CAST(coalesce(o_hq_country IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = cr), false) AS DOUBLE) END AS donor_hq_country,
  CASE ck % 8 WHEN 0 THEN 1.0 WHEN 1 THEN CAST(sr = cr AS DOUBLE) END AS local_registration,
  CASE WHEN d_requires_pi OR uid % 23 = 0 THEN CAST(o_has_established_pi AS DOUBLE) END AS individual_pi,
  CASE d_prior_beneficiary_rule WHEN 'ineligible_current' THEN 1.0 - CAST({_NOW} AS DOUBLE) WHEN 'ineligible_previous' THEN 1.0 - CAST({_PAST} AS DOUBLE) WHEN 'ineligible_any' THEN 1.0 - CAST({_NOW} OR {_PAST} AS DOUBLE) END AS prior_beneficiary,
  CASE uid % 5 WHEN 0 THEN CAST(sr = cr OR sk % 2 = 0 AS DOUBLE) WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS applicant_countries,
  CASE WHEN d_invitation_only OR (uid % 29 = 0 AND uid % 23 <> 0) THEN CAST(o_has_invitation AS DOUBLE) END AS invitation_only
  FROM (SELECT *, lower(CASE WHEN {_LEGAL} IN ('nonprofit', 'charity') THEN d_ngo_eligible WHEN {_LEGAL} = 'for-profit' THEN d_for_profit_eligible END) AS own FROM t)),
 ql AS (SELECT *, [applicant_type, entity_type, donor_hq_country, local_registration, individual_pi, prior_beneficiary, applicant_countries, invitation_only] AS fs FROM q)"""
_QUALIFICATION = "CASE WHEN len(list_filter(fs, lambda x: x IS NOT NULL)) = 0 THEN 'Not sure' WHEN len(list_filter(fs, lambda x: x <= 0)) > 0 THEN 'No, not eligible' ELSE 'Yes, fully' END"
_QKEYS = ("applicant_type", "entity_type", "donor_hq_country", "local_registration", "individual_pi", "prior_beneficiary", "applicant_countries", "invitation_only")


def _scores(column: str, keys: tuple[str, ...]) -> list:
    return [F.element_at(F.filter(column, _named(k)), 1)["score"].alias(k) for k in keys]


def _named(key: str):
    return lambda f: f["key"] == key


@query(f"WITH {_BASE}, {_Q} SELECT uid, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in _QKEYS)}, {_QUALIFICATION} AS qualification FROM ql")
def criteria_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("uid", *_scores("f_qualification", _QKEYS), "qualification")


_C = """c AS (SELECT *, CASE WHEN o_annual_budget > 0 THEN o_annual_budget END AS annual, CASE WHEN o_largest_grant > 0 THEN o_largest_grant END AS largest, 1998 - o_founding_year AS years FROM ql),
 c1 AS (SELECT *, least(CASE WHEN c_award_ceiling > 0 THEN c_award_ceiling ELSE c_value_usd END, o_max_target) AS ask, greatest(annual, largest) AS anchor,
   CASE WHEN years >= 10 OR sk % 4 = 0 THEN 5.0 WHEN years >= 5 THEN 3.0 ELSE 2.0 END + CASE WHEN o_grants_count >= 20 THEN 2.0 WHEN o_grants_count >= 5 THEN 1.0 ELSE 0.0 END AS times,
   CASE WHEN d_max_annual_budget IS NOT NULL AND annual IS NOT NULL THEN CAST(annual <= d_max_annual_budget AS DOUBLE) END AS top1, CASE WHEN d_max_prior_grant IS NOT NULL AND largest IS NOT NULL THEN CAST(largest <= d_max_prior_grant AS DOUBLE) END AS top2,
   CASE ck % 7 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 5 END AS asked, CASE sk % 4 WHEN 0 THEN 'established' WHEN 1 THEN 'early' END AS own_stage FROM c),
 c2 AS (SELECT *, CASE WHEN coalesce(c_award_ceiling, c_value_usd) IS NULL OR anchor IS NULL THEN NULL WHEN ask <= anchor * times THEN 1.0 WHEN ask <= anchor * times * 1.5 THEN 0.5 ELSE 0.0 END AS absorb,
   CASE WHEN asked IS NULL THEN NULL WHEN years >= asked THEN 1.0 WHEN years >= asked - 2 THEN 0.5 WHEN years IS NOT NULL THEN 0.0 WHEN own_stage = 'established' THEN CASE WHEN asked <= 10 THEN 1.0 ELSE 0.5 END WHEN own_stage = 'early' THEN CASE WHEN asked >= 5 THEN 0.0 ELSE 1.0 END ELSE 0.5 END AS by_years,
   CASE WHEN d_stage_required IS NOT NULL THEN CASE WHEN own_stage IS NULL THEN 0.5 ELSE CAST(own_stage = d_stage_required AS DOUBLE) END END AS by_stage FROM c1),
 c3 AS (SELECT *, list_avg(list_filter([top1, top2, absorb], lambda x: x IS NOT NULL)) AS financial, coalesce(least(by_years, by_stage), 1.0) AS experience FROM c2),
 cl AS (SELECT *, CASE WHEN top1 = 0 OR top2 = 0 OR financial <= 0 OR experience <= 0 THEN 'No, beyond us' WHEN financial < 1 OR experience < 1 THEN 'Yes, but a stretch' ELSE 'Yes, comfortably' END AS capacity FROM c3)"""


@query(f"WITH {_BASE}, {_Q}, {_C} SELECT uid, round(CAST(financial AS DOUBLE), 6) AS financial_capacity, CAST(experience AS DOUBLE) AS experience, capacity FROM cl")
def criteria_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    financial, experience = _scores("f_capacity", ("financial_capacity", "experience"))
    return derived(spark, sf_dir).select("uid", F.round(financial, 6).alias("financial_capacity"), experience, "capacity")


_K = """k AS (SELECT *, CASE WHEN (ck % 4 = 0 OR (ck % 4 IN (2, 3) AND ck % 3 = 0)) AND uid % 5 <> 4 THEN CASE uid % 5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END END AS cofinance,
   CASE WHEN ck % 5 = 1 AND sk % 3 <> 2 THEN CASE sk % 3 WHEN 0 THEN 0.0 ELSE 0.5 END END AS prefinance, CASE WHEN ck % 6 = 2 THEN CAST(sk % 2 = 1 AS DOUBLE) END AS audit_report,
   CASE WHEN ck % 7 = 3 AND sk % 3 <> 2 THEN CAST(sk % 3 = 0 AS DOUBLE) END AS local_board, CASE WHEN ck % 13 = 0 OR uid % 31 = 0 THEN CAST(sk % 3 = 0 AS DOUBLE) END AS sam_uei,
   CASE WHEN sk % 3 <> 2 AND (ck % 3 = 0 OR ck % 17 = 1) THEN CAST(CASE sk % 3 WHEN 0 THEN 12 ELSE 7 END <= CASE WHEN ck % 3 = 0 THEN 10 ELSE 0 END AS DOUBLE) END AS indirect_cost,
   CASE WHEN ck % 9 = 4 THEN CAST(sk % 4 = 2 AS DOUBLE) END AS partnership FROM cl),
 kl AS (SELECT *, CASE WHEN coalesce(cofinance, prefinance, audit_report, local_board, sam_uei, indirect_cost, partnership) IS NULL THEN 1.0 END AS compliance_all_clear,
   CASE WHEN 0 IN (cofinance, prefinance, audit_report, local_board, sam_uei, indirect_cost, partnership) THEN 'Not met' WHEN 0.5 IN (cofinance, prefinance) THEN 'Partial' ELSE 'Met' END AS cofinancing FROM k)"""
_KKEYS = ("cofinance", "prefinance", "audit_report", "local_board", "sam_uei", "indirect_cost", "partnership", "compliance_all_clear")


@query(f"WITH {_BASE}, {_Q}, {_C}, {_K} SELECT uid, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in _KKEYS)}, cofinancing FROM kl")
def criteria_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("uid", *_scores("f_cofinancing", _KKEYS), "cofinancing")


_R = f"""g AS (SELECT *, CASE WHEN uid % 4 = 3 AND uid % 31 <> 0 THEN 'Not sure' WHEN (uid % 4 = 0 AND sr = cr) OR (uid % 4 = 1 AND sn = cn) OR uid % 4 = 2 OR (uid % 4 = 3 AND sn = 'UNITED STATES') THEN 'Our own presence'
   WHEN sk % 2 = 0 AND (uid % 4 IN (0, 1) OR (uid % 4 = 3 AND cn = 'UNITED STATES')) THEN 'Via a partner' ELSE 'No presence there' END AS geographic_fit,
  CASE WHEN uid % 3 = 0 THEN greatest(least(CASE WHEN uid % 6 >= 4 THEN 1.0 WHEN uid % 6 >= 2 THEN 0.5 ELSE 0.0 END, CASE WHEN ck % 6 >= 4 THEN 1.0 WHEN ck % 6 >= 2 THEN 0.5 ELSE 0.0 END), 0.0)
   WHEN ck % 4 <> 0 THEN least(CASE WHEN sk % 6 >= 4 THEN 1.0 WHEN sk % 6 >= 2 THEN 0.5 ELSE 0.0 END, CASE WHEN ck % 6 >= 4 THEN 1.0 WHEN ck % 6 >= 2 THEN 0.5 ELSE 0.0 END) END AS theme,
  list_filter([CASE WHEN o_min_target IS NOT NULL AND c_value_usd IS NOT NULL THEN CAST(c_value_usd >= o_min_target AS DOUBLE) END, CASE WHEN o_max_target IS NOT NULL AND c_value_usd IS NOT NULL THEN CAST(c_value_usd <= o_max_target AS DOUBLE) END, CASE WHEN c_value_usd IS NOT NULL THEN 1.0 END,
   CASE WHEN c_duration_months <= 6 AND c_duration_months > 0 THEN 0.0 WHEN c_duration_months < 12 AND c_duration_months > 0 THEN 0.5 WHEN c_duration_months >= 12 THEN 1.0 END], lambda x: x IS NOT NULL) AS fq,
  CASE WHEN c_duration_months <= 6 AND c_duration_months > 0 THEN 0.0 WHEN c_duration_months < 12 AND c_duration_months > 0 THEN 0.5 WHEN c_duration_months >= 12 THEN 1.0 END AS months,
  CASE WHEN c_value_usd >= 2000000 THEN 1.0 WHEN c_value_usd >= 500000 THEN 0.5 ELSE 0.0 END AS award FROM kl),
 g1 AS (SELECT *, CASE WHEN theme IS NULL THEN 'Not sure' WHEN theme >= 1 THEN 'High' WHEN theme > 0 THEN 'Moderate' ELSE 'Low' END AS strategic_fit,
  CASE WHEN c_value_usd IS NULL THEN 'Not sure' WHEN o_min_target IS NOT NULL AND o_max_target IS NOT NULL THEN CASE WHEN list_avg(fq) >= 0.75 THEN 'High' WHEN list_avg(fq) >= 0.4 THEN 'Moderate' ELSE 'Low' END
   ELSE CASE WHEN list_avg(list_filter([award, months], lambda x: x IS NOT NULL)) >= 0.75 THEN 'High' WHEN list_avg(list_filter([award, months], lambda x: x IS NOT NULL)) >= 0.4 THEN 'Moderate' ELSE 'Low' END END AS funding_quality,
  CASE WHEN {_PAST} THEN 'Current/past grantee' WHEN {_ENGAGED} OR {_SIGNED} THEN 'Some contact' WHEN len(o_funder_history) + len(o_engaged_donors) + len(o_donor_registrations) > 0 THEN 'None' END AS funder_relationship,
  list_filter([CASE WHEN sk % 4 = 1 THEN NULL WHEN least(uid % 6, CASE WHEN ck % 3 = 1 THEN ck % 6 ELSE 5 END) >= 4 THEN 1.5 WHEN least(uid % 6, CASE WHEN ck % 3 = 1 THEN ck % 6 ELSE 5 END) >= 2 THEN 0.5 ELSE -1.0 END,
   CASE WHEN years >= 20 THEN 1.0 WHEN years >= 10 THEN 0.75 WHEN years >= 5 THEN 0.5 WHEN years IS NOT NULL THEN 0.0 END, CASE WHEN {_SIGNED} THEN 0.5 END, CASE WHEN ck % 5 = 2 THEN CASE WHEN sk % 2 = 0 THEN 0.5 ELSE -1.0 END END,
   CASE WHEN ck % 7 = 3 THEN CASE WHEN sk % 3 = 0 THEN 0.5 ELSE -1.0 END END, CASE WHEN ck % 4 = 0 THEN CASE WHEN uid % 5 = 0 THEN 0.5 ELSE -0.5 END END, CASE WHEN ck % 8 = 5 THEN CASE WHEN sk % 3 = 1 THEN 1.0 ELSE -0.5 END END,
   CASE WHEN sk % 4 <> 3 AND (ck % 2 = 0 OR uid % 4 IN (0, 1)) THEN CASE WHEN sn = CASE WHEN ck % 2 = 0 THEN cn WHEN uid % 4 = 0 THEN 'CANADA' ELSE 'INDIA' END THEN 1.0 ELSE 0.0 END END], lambda x: x IS NOT NULL) AS signals,
  CASE WHEN uid % 10 = 0 OR uid % 40 - 10 > 14 THEN CASE WHEN sk % 2 = 1 THEN 'Ample time, sufficient resources' ELSE 'Ample time, but no dedicated team' END WHEN uid % 40 - 10 >= 7 THEN CASE WHEN sk % 2 = 1 THEN 'Tight but doable, with a team' ELSE 'Tight, and no dedicated team' END
   ELSE CASE WHEN sk % 2 = 1 THEN 'Not enough time, even with a team' ELSE 'Not enough time, no team' END END AS bid_effort FROM g),
 gl AS (SELECT *, {_QUALIFICATION} AS qualification, CASE WHEN len(signals) = 0 THEN 'Not sure' WHEN list_sum(signals) >= 1 THEN 'Strong' WHEN list_sum(signals) <= -0.5 THEN 'Weak' ELSE 'Moderate' END AS competitiveness FROM g1)"""


@query(f"WITH {_BASE}, {_Q}, {_C}, {_K}, {_R} SELECT uid, geographic_fit, strategic_fit, funding_quality, funder_relationship, competitiveness, bid_effort FROM gl")
def criteria_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("uid", "geographic_fit", "strategic_fit", "funding_quality", "funder_relationship", "competitiveness", "bid_effort")


_POINT = {k: f"CASE lower({k}) " + " ".join(f"WHEN '{label}' THEN {v}" for label, v in op.LABELS.items()) + " END" for k in op.WEIGHTS}
_V = f"""v AS (SELECT *, {', '.join(f'{e} AS p_{k}' for k, e in _POINT.items())} FROM gl),
 w AS (SELECT *, round_even(100 * ({' + '.join(f'{w} * coalesce(p_{k}, 0.5)' for k, w in op.WEIGHTS.items())}) / {sum(op.WEIGHTS.values())}, 1) AS alignment,
  len(list_filter([{', '.join(f'p_{k}' for k in op.MUST)}], lambda x: x = 0)) > 0 OR len(list_filter([{', '.join(f'p_{k}' for k in op.WEIGHTS if k not in op.MUST)}], lambda x: x = 0)) >= 2 AS declines,
  len(list_filter([{', '.join(f'p_{k}' for k in op.MUST)}], lambda x: x = 0)) > 0 AS misses,
  CASE {' '.join(f"WHEN {k} = 0 THEN '{k}'" for k in _QKEYS if k not in op.NOT_FATAL)} WHEN uid % 5 IN (0, 2) AND applicant_countries = 0 THEN 'applicant_countries' WHEN top1 = 0 OR top2 = 0 THEN 'ceiling' WHEN geographic_fit = 'No presence there' THEN 'geography' END AS fatal FROM v)"""


@query(f"""WITH {_BASE}, {_Q}, {_C}, {_K}, {_R}, {_V} SELECT uid, CAST(alignment AS DOUBLE) AS alignment, declines, fatal, CASE WHEN fatal IS NOT NULL THEN 'Decline' WHEN alignment >= 90 THEN 'Proceed' WHEN alignment >= 70 THEN 'Park' ELSE 'Decline' END AS recommendation,
 CASE WHEN misses THEN 'Decline' WHEN alignment >= 70 THEN 'Proceed' WHEN alignment >= 45 THEN 'Park' ELSE 'Decline' END AS composite FROM w""")
def criteria_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.verdict(derived(spark, sf_dir), regions(spark, sf_dir)).select("uid", "alignment", "declines", "fatal", "recommendation", "composite")
