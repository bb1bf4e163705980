"""Rails, rankings, pages and set operations over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as op
from ..registry import query
from .carriers import AS_OF, calls, read, with_calls

_DAYS = f"date_diff('day', DATE '{AS_OF}', deadline)"
_RAILS = f"""r AS (SELECT uid, CASE WHEN {_DAYS} BETWEEN 0 AND 14 THEN 'closing' WHEN posted BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' THEN 'new' WHEN score >= 90 AND {_DAYS} >= 0 THEN 'best' END AS rail, score, deadline, posted FROM calls)"""


@query(with_calls(f", {_RAILS} SELECT uid, rail, row_number() OVER (PARTITION BY rail ORDER BY score DESC NULLS LAST, deadline NULLS LAST, uid) AS place FROM r WHERE rail IS NOT NULL QUALIFY place <= 5"))
def rail_exclusive_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rails; a row goes to the first that takes it, five rows a rail."""
    days, day = F.date_diff("deadline", F.to_date(F.lit(AS_OF))), F.to_date(F.lit(AS_OF))
    rail = op.first_bucket([("closing", days.between(0, 14)), ("new", F.col("posted").between(F.date_sub(day, 30), day)), ("best", (F.col("score") >= 90) & (days >= 0))])
    rows = calls(spark, sf_dir).withColumn("rail", rail).where("rail is not null")
    return op.top_per_group(rows, ["rail"], [F.desc_nulls_last("score"), F.asc_nulls_last("deadline"), F.asc("uid")], 5).select("uid", "rail", "place")


@query(with_calls(""", x AS (SELECT uid, funder, score, row_number() OVER (PARTITION BY funder ORDER BY score DESC, uid) AS k FROM calls WHERE score IS NOT NULL)
 SELECT uid, funder, row_number() OVER (ORDER BY CASE WHEN k <= 2 THEN 0 ELSE 1 END, score DESC, uid) AS place FROM x QUALIFY place <= 50"""))
def featured_cap2_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two a funder, best first; when those run out the cap is relaxed."""
    rows = calls(spark, sf_dir).where("score is not null")
    return op.capped_top(rows, "funder", [F.desc("score"), F.asc("uid")], cap=2, n=50).select("uid", "funder", "place")


@query(with_calls("SELECT uid, cents FROM calls ORDER BY cents DESC NULLS LAST, uid LIMIT 10"))
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).orderBy(F.desc_nulls_last("cents"), "uid").limit(10).select("uid", "cents")


@query(with_calls("SELECT uid, posted FROM calls ORDER BY posted DESC, uid DESC LIMIT 10 OFFSET 40"))
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page(calls(spark, sf_dir), [F.desc("posted"), F.desc("uid")], number=5, size=10).select("uid", "posted")


@query(with_calls(f"SELECT uid, {_DAYS} AS days FROM calls WHERE score >= 90 ORDER BY deadline NULLS LAST, uid LIMIT 20").replace(f"{_DAYS} AS days", f"CAST({_DAYS} AS INTEGER) AS days"))
def sort_by_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).where("score >= 90").orderBy(F.asc_nulls_last("deadline"), "uid").limit(20)
    return rows.select("uid", F.date_diff("deadline", F.to_date(F.lit(AS_OF))).alias("days"))


@query("SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT event_type, event_id, ts FROM events WHERE event_id % 100 = 0")
def union_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    b = read(spark, sf_dir, "events").where("event_id % 100 = 0").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return a.unionByName(b)


@query("SELECT user_id FROM events WHERE event_id % 2 = 0 EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30'")
def except_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.where("event_id % 2 = 0").select("user_id").subtract(e.where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp")).select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) INTERSECT SELECT o_custkey FROM orders")
def intersect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type").select("user_id").intersect(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")))  # one row


@query(with_calls("""SELECT uid, round(0.5 * log10(1 + coalesce(cents, 0)) / 10 + 0.3 * CASE WHEN region IS NOT NULL THEN 1 ELSE 0 END + 0.2 * CASE WHEN deadline IS NULL THEN 0 ELSE 1.0 / (1 + abs(date_diff('day', posted, deadline))) END, 6) AS prominence FROM calls"""))
def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgency = F.when(F.col("deadline").isNull(), 0.0).otherwise(1.0 / (1 + F.abs(F.date_diff("deadline", "posted"))))
    score = 0.5 * F.log10(1 + F.coalesce("cents", F.lit(0))) / 10 + 0.3 * F.col("region").isNotNull().cast("int") + 0.2 * urgency
    return calls(spark, sf_dir).select("uid", F.round(score, 6).alias("prominence"))


@query("SELECT conv_id, count(*) AS turns, arg_min(text, turn) AS first_text, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("first_text"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS id, s_suppkey FROM supplier")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in a global order, without one task for all rows."""
    return op.dense_ids(read(spark, sf_dir, "supplier"), ["s_acctbal", "s_suppkey"], "id").select("id", "s_suppkey")
