"""The driver's tables in the roles of calls, submissions and logs; each frame beside the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-07-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions: a small file is one task, however long each of its rows takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding calls and their submissions; NULLs, blanks and missing keys are derived from the key."""
    orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    k = F.col("o_orderkey")
    posted = F.to_date("o_orderdate")
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # fixed dimensions of 25 and 5 rows
    people = customer.join(F.broadcast(places), customer["c_nationkey"] == nation["n_nationkey"])
    return orders.join(people, orders["o_custkey"] == customer["c_custkey"]).select(
        k.alias("uid"),
        F.col("o_orderpriority").alias("source"),
        F.col("c_name").alias("funder"),
        F.col("c_mktsegment").alias("category"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.when(k % 11 != 0, F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        posted.alias("posted"),
        F.when(k % 7 != 0, F.date_add(posted, (k % 90).cast("int"))).alias("deadline"),
        F.when(k % 13 != 0, (k * 37 % 101).cast("double")).alias("score"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in progress").otherwise("discontinued").alias("progress"),
        F.when(k % 5 == 0, "approved").when(k % 5 == 1, "declined").when(k % 5 == 2, "awaiting").when(k % 5 == 3, "").alias("decision"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 3 == 0, "EUR").when(k % 3 == 1, "USD").otherwise("XXX").alias("currency"),
        (k % 4).cast("long").alias("submissions"),
    )


CALLS = """calls AS (SELECT o_orderkey AS uid, o_orderpriority AS source, c_name AS funder, c_mktsegment AS category, n_name AS country, r_name AS region,
 CASE WHEN o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, CAST(o_orderdate AS DATE) AS posted,
 CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS deadline,
 CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 37 % 101 AS DOUBLE) END AS score,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in progress' ELSE 'discontinued' END AS progress,
 CASE o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'declined' WHEN 2 THEN 'awaiting' WHEN 3 THEN '' END AS decision,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'USD' ELSE 'XXX' END AS currency,
 CAST(o_orderkey % 4 AS BIGINT) AS submissions
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def with_calls(body: str) -> str:
    return f"WITH {CALLS} {body}"


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source and run, from events: found and added counts, the latter unknown for older rows."""
    e = read(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("ts").alias("scan_date"), F.col("event_type").alias("source"), F.col("user_id"), n.alias("found"), F.when(F.col("event_id") % 3 == 0, n % 10).alias("added"), (F.col("event_id") % 29 == 0).alias("failed"), F.floor("value").cast("long").alias("duration"))


SCAN_LOG = """scan_log AS (SELECT event_id, ts AS scan_date, event_type AS source, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS found,
 CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 END AS added, event_id % 29 = 0 AS failed, CAST(floor(value) AS BIGINT) AS duration FROM events)"""
