"""Filters over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as op
from ..registry import query
from .carriers import AS_OF, calls, read, with_calls


@query(with_calls("SELECT uid, source, progress, category FROM calls WHERE source IN ('1-URGENT', '2-HIGH') AND progress IN ('completed', 'in progress')"))
def faceted_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.facets(calls(spark, sf_dir), {"source": ("1-URGENT", "2-HIGH"), "category": (), "progress": ("completed", "in progress")})
    return out.select("uid", "source", "progress", "category")


@query("SELECT p_partkey, p_type FROM part WHERE list_has_any(string_split(p_type, ' '), ['PROMO', 'TIN', 'TYPE'])")
def array_overlap_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(op.overlaps(F.split("p_type", " "), ("PROMO", "TIN", "TYPE"))).select("p_partkey", "p_type")


@query(with_calls("SELECT uid, deadline FROM calls WHERE deadline IS NULL OR deadline BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'"))
def date_mask_keep_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where(op.between_or_null(F.col("deadline"), "1998-01-01", "1998-06-30")).select("uid", "deadline")


@query(with_calls("SELECT uid, decision FROM calls WHERE decision <> 'approved'"))
def inequality_drops_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where(F.col("decision") != "approved").select("uid", "decision")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def timestamp_range_inclusive_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(op.within_days(F.col("ts"), "2024-01-05", "2024-01-07")).select("event_id", "ts", "event_type")


@query("SELECT min(s_suppkey) AS s_suppkey, s_name FROM supplier WHERE contains(lower(coalesce(s_name, '')), '#00000001') GROUP BY s_name")
def search_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "supplier").where(op.contains_any(("s_name",), " #00000001 "))
    return hits.groupBy("s_name").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'stupid')")
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(op.has_keyword(F.col("text"), ("License", "stupid"))).select("doc_id", "lang")


@query(with_calls(f"SELECT uid, posted FROM calls WHERE posted BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}'"))
def period_last_90_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where(op.period(F.col("posted"), "90 days", AS_OF)).select("uid", "posted")


@query(with_calls("""SELECT uid, CASE WHEN coalesce(decision IN ('approved', 'declined'), false) AND progress <> 'completed' THEN 'decided_not_completed'
 WHEN progress = 'completed' AND coalesce(decision, '') = '' THEN 'completed_not_sent' END AS problem FROM calls"""))
def inconsistent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", op.inconsistency(F.col("progress"), F.col("decision")).alias("problem"))


@query(with_calls(f"""SELECT uid, coalesce(nullif(decision, ''), CASE WHEN score >= 70 THEN 'Proceed' WHEN score >= 45 THEN 'Park' WHEN score IS NOT NULL THEN 'Decline' END, '') AS effective,
 progress = 'completed' OR coalesce(decision IN ('approved', 'declined', 'awaiting'), false) AS submitted
 FROM calls WHERE coalesce(decision, '') IN ('', 'not submitted') AND progress NOT IN ('completed', 'discontinued') AND (deadline IS NULL OR deadline >= DATE '{AS_OF}')"""))
def active_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    auto = F.when(F.col("score") >= 70, "Proceed").when(F.col("score") >= 45, "Park").when(F.col("score").isNotNull(), "Decline")
    rows = c.where(op.still_open(F.col("progress"), F.col("decision")) & (F.col("deadline").isNull() | (F.col("deadline") >= F.to_date(F.lit(AS_OF)))))
    effective = F.coalesce(F.when(~op.blank(F.col("decision")), F.col("decision")), auto, F.lit(""))
    return rows.select("uid", effective.alias("effective"), op.submitted(F.col("progress"), F.col("decision")).alias("submitted"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE role = 'user'")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tenant_rows(read(spark, sf_dir, "conversations"), "user", "role").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
