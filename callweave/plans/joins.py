"""Joins, lookups and ledgers over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as op
from ..registry import query
from .carriers import calls, read, with_calls


@query("""WITH r AS (SELECT s_suppkey, s_name FROM supplier), k AS (
 SELECT lower(s_name) AS key, 0 AS pos, s_suppkey AS id FROM r UNION ALL SELECT 'sup-' || s_suppkey, 1, s_suppkey FROM r),
 b AS (SELECT key, arg_min(id, pos * 1000000 + id) AS match FROM k GROUP BY key)
 SELECT p_partkey, match FROM part LEFT JOIN b ON CASE WHEN p_partkey % 2 = 0 THEN 'sup-' || (p_partkey % 150) ELSE lower('Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0')) END = b.key""")
def acronym_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    n = (F.col("p_partkey") % 150).cast("string")
    wanted = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sup-"), n)).otherwise(F.lower(F.concat(F.lit("Supplier#"), F.lpad(n, 9, "0"))))
    keys = [F.lower("s_name"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string"))]
    return op.ladder_join(part.select("p_partkey"), supplier, wanted, keys, "s_suppkey").select("p_partkey", "match")


@query("""WITH t AS (SELECT DISTINCT lower(word) AS term FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) WHERE length(word) >= 5)
 SELECT p_partkey, arg_max(term, printf('%09d', length(term)) || term) AS term FROM part LEFT JOIN t ON contains(' ' || lower(p_name || ' ' || p_type) || ' ', ' ' || term || ' ') GROUP BY p_partkey""")
def longest_substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    terms = part.select(F.explode(F.split("p_type", " ")).alias("term")).distinct().withColumn("id", F.lit(0))
    texts = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("body"))
    return op.longest_contained(texts, terms, "p_partkey", "body", "term", "id").select("p_partkey", "term")


@query("""WITH t AS (SELECT DISTINCT lower(p_type) AS term FROM part UNION SELECT 'promo' UNION SELECT lower(n_name) FROM nation WHERE length(n_name) >= 5), x AS (SELECT s_suppkey, lower(CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' trade office' WHEN s_suppkey % 3 = 1 THEN left(n_name, 6) ELSE 'xyz' END) AS body FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT s_suppkey, arg_max(term, printf('%09d', length(term)) || term) AS term FROM x LEFT JOIN t ON length(body) >= 5 AND length(term) >= 5 AND (contains(body, term) OR contains(term, body)) GROUP BY s_suppkey""")
def containment_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, nation, k = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_suppkey")
    terms = part.select(F.lower("p_type").alias("term")).union(nation.select(F.lower("n_name"))).union(nation.limit(1).select(F.lit("promo"))).distinct().withColumn("id", F.lit(0))
    body = F.when(k % 3 == 0, F.concat("n_name", F.lit(" trade office"))).when(k % 3 == 1, F.left("n_name", F.lit(6))).otherwise("xyz")
    texts = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", body.alias("body"))
    return op.contained_either_way(texts, terms, "s_suppkey", "body", "term", "id").select("s_suppkey", "term")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)")
def anti_join_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = read(spark, sf_dir, "orders"), read(spark, sf_dir, "events")
    return orders.join(events, orders["o_custkey"] == events["user_id"], "left_anti").select("o_orderkey")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29') AND ts < TIMESTAMP '2024-01-03'")
def semi_join_in_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    late = events.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).select("user_id")
    return events.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp")).join(late, "user_id", "left_semi").select("event_id")


@query("""SELECT c_custkey FROM customer WHERE c_custkey <= 200 AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY)""")
def no_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = read(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).select(F.col("user_id").alias("c_custkey"))
    return read(spark, sf_dir, "customer").where("c_custkey <= 200").select("c_custkey").join(recent, "c_custkey", "left_anti")


@query("""SELECT user_id, arg_max(event_type, printf('%020d', epoch_us(ts)) || printf('%012d', event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id""")
def latest_label_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return op.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("""WITH h AS (SELECT user_id, arg_max(event_type, printf('%020d', epoch_us(ts)) || printf('%012d', event_id)) AS human FROM events WHERE event_id % 2 = 0 GROUP BY 1),
 s AS (SELECT user_id, arg_max(event_type, printf('%020d', epoch_us(ts)) || printf('%012d', event_id)) AS machine FROM events WHERE event_id % 2 = 1 GROUP BY 1)
 SELECT human, machine, count(*) AS n FROM h JOIN s USING (user_id) GROUP BY 1, 2""")
def verdict_reason_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    human = op.latest(rows.where("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("human"))
    machine = op.latest(rows.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("machine"))
    return human.join(machine, "user_id").groupBy("human", "machine").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, list_has_any([n_name, r_name], ['NATION_1', (SELECT min(r_name) FROM region)]) AS hit FROM nation JOIN region ON n_regionkey = r_regionkey""")
def region_expand_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pick may be a country or a region; both sides are expanded to members before they are compared."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    members = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")  # 5 rows
    first = region.agg(F.min("r_name").alias("pick"))
    picks = first.unionByName(spark.createDataFrame([("NATION_1",)], "pick string"))
    expanded = members.join(F.broadcast(picks), (F.col("pick") == F.col("r_name")) | (F.col("pick") == F.col("n_name")), "left_semi").select("n_nationkey", F.lit(True).alias("hit"))  # 2 rows
    return members.select("n_nationkey").join(expanded, "n_nationkey", "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(with_calls("SELECT uid, coalesce(CASE WHEN uid % 4 <> 0 THEN country END, region, 'unknown') AS place FROM calls"))
def silent_fallback_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", F.coalesce(F.when(F.col("uid") % 4 != 0, F.col("country")), F.col("region"), F.lit("unknown")).alias("place"))


@query("""SELECT o_orderkey, o_orderstatus, 'old' AS origin FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N', 'new' FROM orders WHERE o_orderkey % 3 = 0""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("old").alias("origin"))
    new = old.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("N"), "origin": F.lit("new")})
    return op.upsert(old, new, ["o_orderkey"])


@query(with_calls("""SELECT uid, CASE WHEN trim(coalesce(decision, '')) = '' THEN CASE WHEN uid % 2 = 0 THEN 'declined' END ELSE decision END AS decision, CASE WHEN uid % 2 = 0 AND cents IS NULL THEN 5 ELSE cents END AS cents,
 array_to_string(list_filter([CASE WHEN uid % 2 = 0 AND trim(coalesce(decision, '')) <> '' AND decision <> 'declined' THEN 'decision' END, CASE WHEN uid % 2 = 0 AND cents IS NOT NULL AND cents <> 5 THEN 'cents' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM calls"""))
def gap_fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = calls(spark, sf_dir).select("uid", "decision", "cents")
    new = old.where("uid % 2 = 0").select("uid", F.lit("declined").alias("decision"), F.lit(5).cast("long").alias("cents"))
    return op.gap_fill(old, new, "uid", ["decision", "cents"])


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
 w AS (SELECT child AS node, parent AS ancestor, 1 AS hops FROM e WHERE parent IS NOT NULL AND parent IN (SELECT child FROM e) UNION ALL SELECT w.node, e.parent, hops + 1 FROM w JOIN e ON w.ancestor = e.child WHERE e.parent IS NOT NULL AND hops < 100)
 SELECT node, ancestor, hops FROM w""")
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    from ..sources.tables import ensure_checkpoints

    ensure_checkpoints(spark)
    edges = read(spark, sf_dir, "customer").select(k.alias("child"), F.when(k > 1, F.floor(k / 2)).alias("parent"))
    return op.chain(edges, "child", "parent").select("node", "ancestor", "hops")


@query("""SELECT user_id, session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2""")
def session_runs_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = op.sessions(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 900)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(with_calls("""SELECT d.uid, d.source, l.uid AS lead FROM calls d LEFT JOIN calls l ON l.uid = d.uid - 1 AND l.funder = d.funder WHERE d.uid % 9 = 0"""))
def duplicate_lead_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    lead = c.select((F.col("uid") + 1).alias("uid"), F.col("uid").alias("lead"), "funder")
    return c.where("uid % 9 = 0").join(lead, ["uid", "funder"], "left").select("uid", "source", "lead")


@query("SELECT r_name, count(DISTINCT n_nationkey) AS members, count(o_orderkey) AS orders, max(CAST(o_orderdate AS DATE)) AS last FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def tenant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    # orders are counted per customer before they meet the dimensions
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).alias("last"))
    people = customer.join(per, customer["c_custkey"] == per["o_custkey"], "left").groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    places = nation.join(people, nation["n_nationkey"] == people["c_nationkey"], "left")
    return region.join(places, region["r_regionkey"] == places["n_regionkey"], "left").groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.max("last").alias("last"))
