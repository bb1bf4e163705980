"""Further reports: people, partners, outcomes, verdicts, completeness, digests, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import filters, joins, ranking, scoring, state
from ..registry import query
from ..sources.tables import changed_pages
from .carriers import AS_OF, SCAN_LOG, calls, read, scan_log, with_calls


@query(f"WITH {SCAN_LOG} SELECT CAST(sum(found) AS BIGINT) AS found, count(*) FILTER (failed) AS rejected, count(DISTINCT date_trunc('minute', scan_date)) AS runs, max(CAST(scan_date AS DATE)) AS last FROM scan_log WHERE user_id % 2 = 0")
def discovery_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_log(spark, sf_dir).where("user_id % 2 = 0")
    return rows.agg(F.sum("found").alias("found"), F.count_if("failed").alias("rejected"), F.count_distinct(F.date_trunc("minute", "scan_date")).alias("runs"), F.max(F.to_date("scan_date")).alias("last"))


@query("SELECT role, count(*) AS total, count(*) FILTER (length(text) > 100) AS active, count(*) FILTER (length(text) <= 100) AS inactive FROM conversations GROUP BY role")
def user_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.length("text") > 100
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"))


@query(with_calls("SELECT funder, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, funder LIMIT 20"))
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("funder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "funder").limit(20)


@query("SELECT count(*) AS engagements, count(DISTINCT user_id) AS donors, round(count(*) * 1.0 / greatest(count(DISTINCT user_id), 1), 2) AS depth, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS linked FROM events")
def engagement_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    per = e.groupBy("event_type").agg(F.count("*").alias("n"))  # a row a type
    whole = e.agg(F.count("*").alias("engagements"), F.count_distinct("user_id").alias("donors"))
    linked = per.agg(F.min_by("n", "event_type").alias("linked"))
    joined = whole.join(F.broadcast(linked), F.lit(True))  # one row each
    return joined.select("engagements", "donors", F.round(F.col("engagements") * 1.0 / F.greatest("donors", F.lit(1)), 2).alias("depth"), "linked")


@query(with_calls("SELECT source, count(*) FILTER (progress = 'completed') AS resolved, count(*) FILTER (progress <> 'completed') AS open, round(100.0 * count(*) FILTER (progress <> 'completed') / count(*), 1) AS unresolved FROM calls GROUP BY source"))
def action_item_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("progress") == "completed")
    return calls(spark, sf_dir).groupBy("source").agg(done.alias("resolved"), (F.count("*") - done).alias("open"), F.round(100.0 * (F.count("*") - done) / F.count("*"), 1).alias("unresolved"))


@query(with_calls(""", t AS (SELECT country FROM calls GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 15), s AS (SELECT unnest(['Submitted', 'Unsubmitted', 'Unknown']) AS status)
 SELECT country, status, count(uid) AS n FROM t CROSS JOIN s LEFT JOIN calls USING (country) WHERE uid IS NULL OR true GROUP BY 1, 2 HAVING false UNION ALL
 SELECT t.country, s.status, (SELECT count(*) FROM calls c WHERE c.country = t.country AND CASE WHEN c.progress = 'completed' THEN 'Submitted' ELSE 'Unsubmitted' END = s.status) FROM t CROSS JOIN s"""))
def stacked_status_zero_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen largest countries; every status has a row, even an empty one."""
    counts = calls(spark, sf_dir).groupBy("country").agg(F.count("*").alias("total"), F.count_if(F.col("progress") == "completed").alias("Submitted"), F.count_if(F.col("progress") != "completed").alias("Unsubmitted"))
    top = counts.orderBy(F.desc("total"), "country").limit(15).withColumn("Unknown", F.lit(0).cast("long"))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in ("Submitted", "Unsubmitted", "Unknown")]))
    return top.select("country", cells.alias("x")).select("country", "x.*")


@query(with_calls(""", p AS (SELECT uid, unnest(list_distinct(['Lead ' || (uid % 7), CASE WHEN uid % 3 = 0 THEN 'Lead ' || (uid % 5) END])) AS person FROM calls) SELECT person, count(*) AS n FROM p WHERE person IS NOT NULL GROUP BY 1"""))
def people_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead and contributors; a name counts once a row."""
    k = F.col("uid")
    names = F.array(F.concat(F.lit("LEAD "), (k % 7).cast("string")), F.when(k % 3 == 0, F.concat(F.lit("Dr lead "), (k % 5).cast("string"))))
    people = F.array_distinct(F.transform(F.array_compact(names), lambda x: text.person(x)))
    return calls(spark, sf_dir).select(F.explode(people).alias("person")).groupBy("person").agg(F.count("*").alias("n"))


@query(with_calls(""", p AS (SELECT unnest(CASE uid % 3 WHEN 0 THEN ['Acme Inc.', 'Org ' || (uid % 4)] WHEN 1 THEN ['Org ' || (uid % 6)] ELSE [] END) AS partner FROM calls) SELECT partner, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, partner LIMIT 10"""))
def partner_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uid")
    cell = F.when(k % 3 == 0, F.concat(F.lit("Acme, Inc.; Org "), (k % 4).cast("string"))).when(k % 3 == 1, F.concat(F.lit(" Org "), (k % 6).cast("string"), F.lit(" ;")))
    return calls(spark, sf_dir).select(F.explode(text.partners(cell)).alias("partner")).groupBy("partner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "partner").limit(10)


@query(with_calls("""SELECT CASE WHEN v LIKE 'proceed%' THEN 'Proceed' WHEN v LIKE 'park%' THEN 'Park' WHEN v LIKE 'decline%' THEN 'Decline' ELSE 'none' END AS decision, count(*) AS n FROM (SELECT CASE WHEN score >= 90 THEN 'proceed (strong)' WHEN score >= 70 THEN 'proceed' WHEN score >= 45 THEN 'park it' WHEN score IS NOT NULL THEN 'declined' ELSE '' END AS v FROM calls) GROUP BY 1"""))
def decision_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    v = F.when(s >= 90, "Proceed (strong)").when(s >= 70, "Proceed").when(s >= 45, "Park it").when(s.isNotNull(), "Declined").otherwise("")
    kind = F.when(v.startswith("Proceed"), "Proceed").when(v.startswith("Park"), "Park").when(v.startswith("Decline"), "Decline").otherwise("none")
    return calls(spark, sf_dir).groupBy(kind.alias("decision")).agg(F.count("*").alias("n"))


@query(with_calls("SELECT upper(left(decision, 1)) || substr(decision, 2) AS outcome, count(*) AS n FROM calls WHERE trim(coalesce(decision, '')) NOT IN ('', 'awaiting') GROUP BY 1"))
def donor_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).where(~F.trim(F.coalesce("decision", F.lit(""))).isin("", "awaiting"))
    return rows.groupBy(F.initcap("decision").alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment AS category, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS flagged, string_agg(DISTINCT left(c_name, 12), ',' ORDER BY left(c_name, 12)) AS stems FROM customer GROUP BY 1""")
def donor_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("c_acctbal") > 0, " Yes ").otherwise("not_sure")
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"), F.count_if(text.truthy(flag)).alias("flagged"), F.array_join(F.sort_array(F.collect_set(F.left("c_name", F.lit(12)))), ",").alias("stems"))


@query(with_calls("SELECT left(trim(source || ': ' || category), 48) AS reason, count(*) AS n, count(*) FILTER (decision = 'approved') AS false_reject, count(*) FILTER (decision IS NULL) AS unsure FROM calls WHERE score < 45 GROUP BY 1 ORDER BY n DESC, reason LIMIT 30"))
def reject_verdict_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.left(F.trim(F.concat_ws(": ", "source", "category")), F.lit(48))
    rows = calls(spark, sf_dir).where("score < 45").groupBy(reason.alias("reason"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "approved").alias("false_reject"), F.count_if(F.col("decision").isNull()).alias("unsure")).orderBy(F.desc("n"), "reason").limit(30)


@query(with_calls("SELECT uid, CAST(round_even(100.0 * ((CASE WHEN cents IS NOT NULL THEN 3 ELSE 0 END) + (CASE WHEN deadline IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN trim(coalesce(decision, '')) <> '' THEN 1 ELSE 0 END)) / 6, 0) AS DOUBLE) AS complete FROM calls"))
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted share of answered fields, half to even."""
    points = F.lit(0)
    for name, weight in (("cents", 3), ("deadline", 2), ("decision", 1)):
        points = points + F.when(filters.blank(F.col(name).cast("string")), 0).otherwise(weight)
    return calls(spark, sf_dir).select("uid", F.bround(100.0 * points / 6, 0).alias("complete"))


@query("SELECT DISTINCT l_shipdate::DATE AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1995-02-01").cast("timestamp")).select(F.to_date("l_shipdate").alias("value")).distinct()


@query(with_calls(f"SELECT CASE WHEN score >= 70 THEN 'Proceed' WHEN score >= 45 THEN 'Park' ELSE 'other' END AS bucket, count(*) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, min(deadline) AS next FROM calls WHERE posted > DATE '{AS_OF}' - 7 AND posted <= DATE '{AS_OF}' GROUP BY 1"))
def digest_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.lit(AS_OF))
    bucket = F.when(F.col("score") >= 70, "Proceed").when(F.col("score") >= 45, "Park").otherwise("other")
    rows = calls(spark, sf_dir).where((F.col("posted") > F.date_sub(day, 7)) & (F.col("posted") <= day))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.min("deadline").alias("next"))


@query("""SELECT doc_id, CAST((CASE WHEN contains(head, 'the') THEN 3 WHEN contains(lower(left(text, 400)), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(head, 'license') THEN 4 ELSE 0 END) + (CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END) AS INTEGER) AS relevance FROM (SELECT doc_id, text, lower(left(text, 60)) AS head FROM documents) ORDER BY relevance DESC, doc_id LIMIT 50""")
def relevance_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, snippet = F.lower(F.left("text", F.lit(60))), F.lower(F.left("text", F.lit(400)))
    has = lambda c, w: F.contains(c, F.lit(w))
    score = F.when(has(head, "the"), 3).when(has(snippet, "the"), 1).otherwise(0) + F.when(has(head, "license"), 4).otherwise(0) + F.when(F.col("doc_id") % 3 == 0, 3).when(F.col("doc_id") % 3 == 1, 1).otherwise(0)
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(50)


@query(with_calls("SELECT uid, CAST(2 * (CASE WHEN decision = 'approved' THEN 1 ELSE 0 END) + (CASE WHEN decision = 'awaiting' THEN 1 ELSE 0 END) AS INTEGER) AS priority FROM calls ORDER BY priority DESC, deadline NULLS LAST, uid LIMIT 30"))
def priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    won, waiting = F.col("decision") == "approved", F.col("decision") == "awaiting"
    priority = 2 * F.coalesce(won, F.lit(False)).cast("int") + F.coalesce(waiting, F.lit(False)).cast("int")
    return calls(spark, sf_dir).withColumn("priority", priority).orderBy(F.desc("priority"), F.asc_nulls_last("deadline"), "uid").limit(30).select("uid", "priority")


@query(with_calls("""SELECT uid, round(0.34 * CASE WHEN region IS NOT NULL THEN 1 ELSE 0 END + 0.28 * coalesce(score, 0) / 100 + 0.18 * CASE WHEN uid % 2 = 0 THEN 1 ELSE 0 END + 0.1 * least(1, coalesce(cents, 0) / 2e7) + 0.1 * CASE WHEN deadline IS NULL THEN 0 ELSE 1.0 / (1 + abs(date_diff('day', posted, deadline))) END, 6) AS featured,
 array_to_string(list_filter(['geography', CASE WHEN score >= 50 THEN 'theme' END, CASE WHEN uid % 2 = 0 THEN 'funder' END], lambda x: x IS NOT NULL), ', ') AS why FROM calls"""))
def featured_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("uid") % 2 == 0
    urgent = F.when(F.col("deadline").isNull(), 0.0).otherwise(1.0 / (1 + F.abs(F.date_diff("deadline", "posted"))))
    score = 0.34 * F.col("region").isNotNull().cast("int") + 0.28 * F.coalesce("score", F.lit(0.0)) / 100 + 0.18 * known.cast("int") + 0.1 * F.least(F.lit(1.0), F.coalesce("cents", F.lit(0)) / 2e7) + 0.1 * urgent
    why = F.array_join(F.array_compact(F.array(F.lit("geography"), F.when(F.col("score") >= 50, "theme"), F.when(known, "funder"))), ", ")
    return calls(spark, sf_dir).select("uid", F.round(score, 6).alias("featured"), why.alias("why"))


@query("""SELECT coalesce(a.n_name, b.n_name) AS name, CASE WHEN a.n_name IS NULL THEN 'UNDECLARED' WHEN b.n_name IS NULL THEN 'ABSENT' WHEN a.n_regionkey = b.n_regionkey THEN 'VERIFIED' ELSE 'INCOMPLETE' END AS status FROM (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0) a FULL JOIN (SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey % 4 <> 0) b USING (n_name)""")
def declared_vs_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    a = n.where("n_nationkey % 5 <> 0").select("n_name", F.col("n_regionkey").alias("x"))
    b = n.where("n_nationkey % 4 <> 0").select("n_name", F.when(F.col("n_nationkey") % 3 == 0, -1).otherwise(F.col("n_regionkey")).alias("y"))
    status = F.when(F.col("x").isNull(), "UNDECLARED").when(F.col("y").isNull(), "ABSENT").when(F.col("x") == F.col("y"), "VERIFIED").otherwise("INCOMPLETE")
    return a.join(b, "n_name", "full").select(F.col("n_name").alias("name"), status.alias("status"))


@query("SELECT user_id FROM events WHERE event_id % 3 = 0 UNION SELECT user_id FROM events WHERE event_id % 7 = 0")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.where("event_id % 3 = 0").select("user_id").union(e.where("event_id % 7 = 0").select("user_id")).distinct()


@query("""SELECT s_suppkey, coalesce(u.o_custkey, f.c_custkey) AS match FROM supplier LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0) u ON u.o_custkey = s_suppkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) f ON f.c_custkey = s_suppkey + 1""")
def match_either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label joins on one key, or failing that on another: two equi-joins and a coalesce, not an OR."""
    first = read(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.col("o_custkey").alias("u")).distinct()
    second = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") - 1).alias("k"), F.col("c_custkey").alias("f"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("k"))
    return rows.join(first, "k", "left").join(second, "k", "left").select("s_suppkey", F.coalesce("u", "f").alias("match"))


@query("""SELECT host, arg_min(source, place * 100000000 + id) AS source, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host, CASE page_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'table' ELSE 'seed' END AS source, page_id % 3 AS place, page_id AS id FROM pages) GROUP BY host""")
def source_union_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three catalogues in one; of a host's entries the one of the first catalogue stays."""
    k = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.when(k % 3 == 0, "file").when(k % 3 == 1, "table").otherwise("seed").alias("source"), (k % 3).alias("place"), k.alias("id"))
    return rows.groupBy("host").agg(F.min_by("source", F.struct("place", "id")).alias("source"), F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://a.org/' || (page_id % 10) END AS link, page_id % 3 = 0 AND page_id % 10 < 5 AS tracked FROM pages")
def already_in_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue links that are tracked, whatever their case, slash or scheme."""
    k = F.col("page_id")
    tracked = spark.range(5).select(F.concat(F.lit("http://www.A.org/"), F.col("id").cast("string"), F.lit("/")).alias("t")).select(urls.comparable(F.col("t")).alias("norm"), F.lit(True).alias("tracked"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, F.concat(F.lit("https://a.org/"), (k % 10).cast("string"))).alias("link")).withColumn("norm", urls.comparable(F.col("link")))
    return rows.join(F.broadcast(tracked), "norm", "left").select("page_id", "link", F.coalesce("tracked", F.lit(False)).alias("tracked"))  # five rows


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'donor' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'name' END AS from_donor FROM supplier")
def donor_blank_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", F.when(k % 2 == 0, "own").otherwise(" ").alias("name"))
    return state.blank_filled(rows, s.select("s_suppkey", F.concat(F.lit("donor"), k.cast("string")).alias("name")), "s_suppkey", ["name"])


@query(with_calls("SELECT uid, CASE WHEN uid % 5 = 0 THEN 'Current/past grantee' WHEN uid % 5 = 1 THEN 'Some contact' WHEN uid % 5 = 2 THEN 'None' END AS relation, CASE WHEN uid % 13 = 0 THEN 1.0 ELSE CAST((uid % 3) / 2.0 AS DOUBLE) END AS won, CAST(CASE WHEN uid % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS total FROM calls").replace("THEN 1.0 ELSE CAST", "THEN CAST(1.0 AS DOUBLE) ELSE CAST"))
def relationship_and_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uid")
    w = scoring.won([F.when(k % 13 != 0, (k % 3) / 2.0), F.lit(None).cast("double")])
    return calls(spark, sf_dir).select("uid", scoring.relationship(k % 5 == 0, k % 5 == 1, F.when(k % 5 == 2, F.lit(True))).alias("relation"), w["won"].alias("won"), w["total"].alias("total"))


@query(with_calls("SELECT uid, region, category, CAST(score AS DOUBLE) AS score, CAST(CASE WHEN source = '1-URGENT' THEN 1 ELSE 0 END AS INTEGER) AS is_urgent, CAST(CASE WHEN source = '2-HIGH' THEN 1 ELSE 0 END AS INTEGER) AS is_high, round(ln(1 + coalesce(cents, 0)), 6) AS log_amount, CAST(CASE WHEN deadline IS NULL THEN 1 ELSE 0 END AS INTEGER) AS undated FROM calls"))
def feature_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = lambda v: (F.col("source") == v).cast("int")
    return calls(spark, sf_dir).select("uid", "region", "category", "score", hot("1-URGENT").alias("is_urgent"), hot("2-HIGH").alias("is_high"), F.round(F.log(1 + F.coalesce("cents", F.lit(0))), 6).alias("log_amount"), F.col("deadline").isNull().cast("int").alias("undated"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS admitted, count(*) FILTER (value > 50 AND event_id % 2 = 0) AS agreed, round(100.0 * count(*) FILTER ((value > 50) = (event_id % 2 = 0)) / count(*), 2) AS accuracy FROM events GROUP BY 1")
def judge_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a judge against people's, per kind."""
    admitted, valid = F.col("value") > 50, F.col("event_id") % 2 == 0
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(admitted).alias("admitted"), F.count_if(admitted & valid).alias("agreed"), F.round(100.0 * F.count_if(admitted == valid) / F.count("*"), 2).alias("accuracy"))


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 2")
def canonical_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_per_group(read(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 2).select("p_partkey", "p_brand", "place")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'changed' ELSE 'removed' END AS change FROM nation WHERE n_nationkey < 10")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("v"))
    after = n.where("id >= 10 or id % 2 = 0").withColumn("v", F.when(F.col("id") < 10, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return changed_pages(n, after, "id", "v")


@query("SELECT a.user_id, count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) a JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) b ON a.user_id = b.user_id AND b.d = a.d + 1 GROUP BY 1")
def rows_on_following_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d")).distinct()
    return days.join(days.select("user_id", F.date_sub("d", 1).alias("d")), ["user_id", "d"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30'")
def freshness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = joins.latest(read(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], ["ts"])
    return last.where(F.col("ts") < F.lit("2024-01-30").cast("timestamp"))
