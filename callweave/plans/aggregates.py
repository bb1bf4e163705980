"""Report aggregates over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import aggregates as op
from ..operators.filters import submitted
from ..registry import query
from .carriers import AS_OF, SCAN_LOG, calls, read, scan_log, with_calls

DUPLICATE = "uid % 9 = 0"
_SUBMITTED = "(progress = 'completed' OR coalesce(decision IN ('approved', 'declined', 'awaiting'), false))"


@query(with_calls(f"SELECT source, count(*) AS total, count(*) FILTER ({DUPLICATE}) AS dups, count(*) - count(*) FILTER ({DUPLICATE}) AS unique_rows FROM calls GROUP BY source"))
def intake_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.intake(calls(spark, sf_dir), "source", F.expr(DUPLICATE)).orderBy(F.desc("total"))


_START = {k: f"CAST(date_trunc('{k}', posted) AS DATE)" for k in ("week", "month", "quarter", "year")} | {"semester": "CAST(CASE WHEN month(posted) > 6 THEN date_trunc('year', posted) + INTERVAL 6 MONTH ELSE date_trunc('year', posted) END AS DATE)"}
_STEP = {"week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "semester": "6 MONTH", "year": "1 YEAR"}


def _bucket_sql(kind: str) -> str:
    # half of the days are left out, so that there are gaps to fill
    return with_calls(f""", x AS (SELECT {_START[kind]} AS bucket, cents FROM calls WHERE day(posted) < 3 AND month(posted) % 5 <> 0),
 c AS (SELECT bucket, count(*) AS n, sum(coalesce(cents, 0)) AS total FROM x GROUP BY 1),
 r AS (SELECT CAST(unnest(generate_series(CAST(min(bucket) AS TIMESTAMP), CAST(max(bucket) AS TIMESTAMP), INTERVAL {_STEP[kind]})) AS DATE) AS bucket FROM c)
 SELECT r.bucket, coalesce(n, 0) AS n, CAST(coalesce(total, 0) AS BIGINT) AS total FROM r LEFT JOIN c USING (bucket)""")


def _bucket_query(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = calls(spark, sf_dir).where((F.dayofmonth("posted") < 3) & (F.month("posted") % 5 != 0))
        return op.bucketed(rows, "posted", kind, F.coalesce("cents", F.lit(0)))

    run.__name__ = f"bucket_count_gapfill_{kind}"
    query(_bucket_sql(kind))(run)


for _kind in dates.BUCKETS:
    _bucket_query(_kind)


@query(with_calls("""SELECT funder, CAST(date_trunc('quarter', posted) AS DATE) AS bucket, count(*) AS n FROM calls GROUP BY 1, 2"""))
def bucket_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("funder", dates.bucket_start(F.col("posted"), "quarter").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {SCAN_LOG} SELECT count(DISTINCT CAST(scan_date AS DATE)) AS days, CAST(sum(found) AS BIGINT) AS found, count(*) FILTER (failed) AS failed,
 CAST(sum(added) FILTER (source = 'none') AS BIGINT) AS added_unknown, CAST(sum(added) AS BIGINT) AS added FROM scan_log""")
def scan_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scan_log(spark, sf_dir)  # a sum over nothing but nulls stays null
    return log.agg(F.count_distinct(F.to_date("scan_date")).alias("days"), F.sum("found").alias("found"), F.count_if("failed").alias("failed"), F.sum(F.when(F.col("source") == "none", F.col("added"))).alias("added_unknown"), F.sum("added").alias("added"))


@query(f"""WITH {SCAN_LOG} SELECT source, count(*) AS runs, CAST(sum(found) AS BIGINT) AS found, CAST(coalesce(sum(added), 0) AS BIGINT) AS added,
 round(CAST(sum(duration) AS DOUBLE) / count(duration), 1) AS mean_duration, round(100.0 * CAST(coalesce(sum(added), 0) AS DOUBLE) / greatest(sum(found), 1), 1) AS yield_pct FROM scan_log GROUP BY source""")
def source_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.coalesce(F.sum("added"), F.lit(0))
    return scan_log(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("runs"), F.sum("found").alias("found"), added.alias("added"),
        F.round(F.sum("duration").cast("double") / F.count("duration"), 1).alias("mean_duration"),
        F.round(100.0 * added / F.greatest(F.sum("found"), F.lit(1)), 1).alias("yield_pct"),
    )


@query("""SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host, count(*) AS pages, string_agg(DISTINCT regexp_extract(url, '^([a-z]+)://', 1), ',' ORDER BY regexp_extract(url, '^([a-z]+)://', 1)) AS schemes FROM pages GROUP BY 1""")
def host_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^www\.", "")
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.array_join(F.sort_array(F.collect_set(F.regexp_extract("url", "^([a-z]+)://", 1))), ",").alias("schemes"))


@query(with_calls(f""", t AS (SELECT CAST(date_trunc('month', posted) AS DATE) AS bucket, sum(cents) AS cents FROM calls WHERE decision = 'approved' GROUP BY 1)
 SELECT bucket, CAST(cents AS BIGINT) AS cents, CAST(sum(coalesce(cents, 0)) OVER (ORDER BY bucket) AS BIGINT) AS running FROM t"""))
def cumulative_secured(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = calls(spark, sf_dir).where("decision = 'approved'").groupBy(dates.bucket_start(F.col("posted"), "month").alias("bucket")).agg(F.sum("cents").alias("cents"))
    return sums.withColumn("running", F.sum(F.coalesce("cents", F.lit(0))).over(Window.orderBy("bucket")))  # one row a month


@query(with_calls(f"""SELECT source, count(*) AS total, count(*) FILTER (score >= 45) AS proceed, count(*) FILTER (score >= 45 AND {_SUBMITTED}) AS submitted, count(*) FILTER (score >= 45 AND {_SUBMITTED} AND decision = 'approved') AS approved FROM calls GROUP BY source"""))
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.funnel(calls(spark, sf_dir), ["source"], _stages())


def _stages() -> dict:
    return {"total": F.lit(True), "proceed": F.col("score") >= 45, "submitted": submitted(F.col("progress"), F.col("decision")), "approved": F.col("decision") == "approved"}


@query(with_calls(f"""SELECT region, count(*) AS total, count(*) FILTER (score >= 45) AS proceed, CAST(coalesce(sum(cents) FILTER (score >= 45), 0) AS BIGINT) AS proceed_value,
 count(*) FILTER (score >= 45 AND {_SUBMITTED}) AS submitted, CAST(coalesce(sum(cents) FILTER (score >= 45 AND {_SUBMITTED}), 0) AS BIGINT) AS submitted_value,
 count(*) FILTER (score >= 45 AND {_SUBMITTED} AND decision = 'approved') AS approved, CAST(coalesce(sum(cents * submissions) FILTER (score >= 45 AND {_SUBMITTED} AND decision = 'approved'), 0) AS BIGINT) AS approved_value FROM calls GROUP BY region"""))
def funnel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.funnel(calls(spark, sf_dir), ["region"], _stages(), {"proceed": F.col("cents"), "submitted": F.col("cents"), "approved": F.col("cents") * F.col("submissions")})


_WEIGHT = "CASE WHEN progress = 'completed' THEN greatest(submissions, 1) ELSE 0 END"


@query(with_calls(f"""SELECT category, CAST(sum({_WEIGHT}) AS BIGINT) AS weighted, CAST(sum(CASE WHEN decision = 'approved' THEN {_WEIGHT} ELSE 0 END) AS BIGINT) AS approved,
 round(100.0 * sum(CASE WHEN decision = 'approved' THEN {_WEIGHT} ELSE 0 END) / greatest(sum({_WEIGHT}), 1), 1) AS win_rate, count(*) FILTER (currency IS NULL OR currency NOT IN ('USD', 'EUR')) AS missing_currency,
 CAST(sum(CASE decision WHEN 'approved' THEN coalesce(cents, 0) WHEN 'declined' THEN -coalesce(cents, 0) WHEN 'awaiting' THEN coalesce(cents, 0) ELSE 0 END) AS BIGINT) AS signed FROM calls GROUP BY category"""))
def outcome_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = op.submission_weight(F.col("progress"), F.col("submissions"))
    won = F.sum(F.when(F.col("decision") == "approved", weight).otherwise(0))
    return calls(spark, sf_dir).groupBy("category").agg(
        F.sum(weight).alias("weighted"), won.alias("approved"), F.round(100.0 * won / F.greatest(F.sum(weight), F.lit(1)), 1).alias("win_rate"),
        F.count_if(F.col("currency").isNull() | ~F.col("currency").isin("USD", "EUR")).alias("missing_currency"),
        F.sum(op.signed_outcome(F.col("decision"), F.col("cents"), F.col("cents"))).alias("signed"),
    )


@query(with_calls("""SELECT region, count(*) AS n, median(date_diff('day', posted, deadline)) AS median_days, round(avg(date_diff('day', posted, deadline)), 1) AS mean_days, CAST(min(date_diff('day', posted, deadline)) AS INTEGER) AS least, CAST(max(date_diff('day', posted, deadline)) AS INTEGER) AS most FROM calls WHERE deadline >= posted GROUP BY region"""))
def cycle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.date_diff("deadline", "posted")
    return calls(spark, sf_dir).where("deadline >= posted").groupBy("region").agg(F.count("*").alias("n"), F.median(days).alias("median_days"), F.round(F.avg(days), 1).alias("mean_days"), F.min(days).alias("least"), F.max(days).alias("most"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, median(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS median_days, count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60) AS overridden
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1""")
def decision_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    days = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).where("l_shipdate >= o_orderdate").select(F.col("l_returnflag").alias("flag"), days.alias("days"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.median("days").alias("median_days"), F.count_if(F.col("days") > 60).alias("overridden"))


@query(with_calls(f""", s AS (SELECT funder, CAST(sum(cents) AS BIGINT) AS total FROM calls WHERE cents IS NOT NULL GROUP BY 1)
 SELECT funder, total, round(100.0 * CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE), 1) AS share, row_number() OVER (ORDER BY total DESC, funder) AS place FROM s"""))
def donor_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.concentration(calls(spark, sf_dir).where("cents is not null"), "funder", "cents")


@query(with_calls("""SELECT max(share) AS largest, CASE WHEN max(share) >= 70 THEN 'High' WHEN max(share) >= 40 THEN 'Medium' ELSE 'Low' END AS risk, round(sum(share) FILTER (place <= 3), 1) AS top3 FROM
 (SELECT round(100.0 * CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE), 1) AS share, row_number() OVER (ORDER BY total DESC, region) AS place FROM (SELECT region, sum(cents) AS total FROM calls GROUP BY 1))"""))
def largest_source_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = op.concentration(calls(spark, sf_dir), "region", "cents")
    return shares.agg(F.max("share").alias("largest"), op.risk_band(F.max("share")).alias("risk"), F.round(F.sum(F.when(F.col("place") <= 3, F.col("share"))), 1).alias("top3"))


@query(with_calls("""SELECT CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 45 THEN 'C' WHEN score IS NULL THEN 'unscored' ELSE 'D' END AS tier, count(*) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents FROM calls GROUP BY 1"""))
def tier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 45, "C").when(F.col("score").isNull(), "unscored").otherwise("D")
    return calls(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


@query(with_calls("SELECT funder, count(*) AS n, left(string_agg(DISTINCT source, ', ' ORDER BY source), 80) AS types FROM calls GROUP BY funder"))
def distinct_types_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("funder").agg(F.count("*").alias("n"), F.left(F.array_join(F.sort_array(F.collect_set("source")), ", "), F.lit(80)).alias("types"))


@query(with_calls(""", c AS (SELECT country AS key, source AS label, count(*) AS n FROM calls GROUP BY 1, 2) SELECT key, CAST(sum(n) OVER (PARTITION BY key) AS BIGINT) AS n, label FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, label) = 1"""))
def mode_label_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.mode_label(calls(spark, sf_dir), F.col("country"), "source")


@query("""WITH x AS (SELECT coalesce(CAST(quality AS VARCHAR), '(none)') AS r, coalesce(CAST(toxic AS VARCHAR), '(none)') AS c FROM labels)
 SELECT coalesce(r, 'ALL') AS row_value, coalesce(c, 'ALL') AS column_value, count(*) AS n FROM x GROUP BY CUBE (r, c)""")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.crosstab(read(spark, sf_dir, "labels"), "quality", "toxic")


@query(with_calls("""SELECT source, field, round(100.0 * lost / n, 1) AS missing FROM (SELECT source, count(*) AS n, unnest([{'field': 'cents', 'lost': count(*) FILTER (cents IS NULL)}, {'field': 'deadline', 'lost': count(*) FILTER (deadline IS NULL)}, {'field': 'decision', 'lost': count(*) FILTER (trim(coalesce(decision, '')) = '')}, {'field': 'score', 'lost': count(*) FILTER (score IS NULL)}], recursive := true) FROM calls GROUP BY source)"""))
def missingness_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.missingness(calls(spark, sf_dir), "source", ["cents", "deadline", "decision", "score"])


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean, round(stddev_samp(n_chars), 2) AS std, min(n_chars) AS least, CAST(median(n_chars) AS DOUBLE) AS median, max(n_chars) AS most, count(DISTINCT source) <= 1 AS constant FROM documents GROUP BY lang""")
def feature_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "n_chars"
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(c), 2).alias("mean"), F.round(F.stddev_samp(c), 2).alias("std"), F.min(c).alias("least"), F.median(c).alias("median"), F.max(c).alias("most"), (F.count_distinct("source") <= 1).alias("constant"))


VOCABULARY = ("completed", "in progress", "discontinued", "not started")


@query(with_calls(", v AS (SELECT CAST(i AS INTEGER) AS place, ['completed', 'in progress', 'discontinued', 'not started'][i + 1] AS value FROM range(4) t(i)) SELECT place, value, count(uid) AS n FROM v LEFT JOIN calls ON progress = value GROUP BY 1, 2"))
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fixed_order(calls(spark, sf_dir), "progress", VOCABULARY)


@query(with_calls(f"""SELECT count(*) AS total, count(*) FILTER (score >= 45) AS proceed, count(*) FILTER (score >= 45 AND deadline < DATE '{AS_OF}') AS overdue, count(*) FILTER (score >= 45 AND deadline BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 14) AS due_soon, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (deadline IS NULL) AS undated FROM calls"""))
def home_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, good = dates.days_until(F.col("deadline"), AS_OF), F.col("score") >= 45
    return calls(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(good).alias("proceed"), F.count_if(good & (days < 0)).alias("overdue"), F.count_if(good & days.between(0, 14)).alias("due_soon"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("deadline").isNull()).alias("undated"))


@query(with_calls("""SELECT split_part(coalesce(nullif(decision, ''), 'none'), ' ', 1) AS human, CASE WHEN score >= 45 THEN 'approved' WHEN score IS NULL THEN 'none' ELSE 'declined' END AS auto, count(*) AS n FROM calls GROUP BY 1, 2"""))
def auto_human_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = F.split_part(F.coalesce(F.nullif("decision", F.lit("")), F.lit("none")), F.lit(" "), F.lit(1))
    auto = F.when(F.col("score") >= 45, "approved").when(F.col("score").isNull(), "none").otherwise("declined")
    return calls(spark, sf_dir).groupBy(human.alias("human"), auto.alias("auto")).agg(F.count("*").alias("n"))


@query(with_calls("""SELECT funder, count(*) AS n, CAST(sum(coalesce(cents, 0)) AS BIGINT) AS requested, CAST(sum(CASE WHEN decision = 'approved' THEN coalesce(cents, 0) ELSE 0 END) AS BIGINT) AS secured, CAST(sum(CASE WHEN decision = 'declined' THEN coalesce(cents, 0) ELSE 0 END) AS BIGINT) AS unsecured,
 CAST(greatest(0, sum(coalesce(cents, 0)) - sum(CASE WHEN decision IN ('approved', 'declined') THEN coalesce(cents, 0) ELSE 0 END)) AS BIGINT) AS balance FROM calls WHERE cents IS NOT NULL GROUP BY funder"""))
def applied_funding_by_funder(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda *d: F.sum(F.when(F.col("decision").isin(*d), F.col("cents")).otherwise(0))
    return calls(spark, sf_dir).where("cents is not null").groupBy("funder").agg(F.count("*").alias("n"), F.sum("cents").alias("requested"), money("approved").alias("secured"), money("declined").alias("unsecured"), F.greatest(F.lit(0), F.sum("cents") - money("approved", "declined")).alias("balance"))


@query(with_calls(f"""SELECT source, count(*) AS total, count(*) FILTER (score >= 45) AS proceed, count(*) FILTER (score >= 45 AND {_SUBMITTED}) AS submitted, count(*) FILTER (score >= 45 AND {_SUBMITTED} AND decision = 'approved') AS approved,
 count(*) FILTER (score >= 90) AS tier_a, CAST(coalesce(sum(cents) FILTER (score >= 90), 0) AS BIGINT) AS tier_a_cents FROM calls GROUP BY source"""))
def funnel_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the funnel of each source beside its best tier, in one pass."""
    c = calls(spark, sf_dir)
    stages, reached, out = _stages(), F.lit(True), []
    for name, condition in stages.items():
        reached = reached & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(reached).alias(name))
    best = F.col("score") >= 90
    return c.groupBy("source").agg(*out, F.count_if(best).alias("tier_a"), F.coalesce(F.sum(F.when(best, F.col("cents"))), F.lit(0)).alias("tier_a_cents"))


@query(with_calls(f"""SELECT CAST(date_trunc('week', posted) AS DATE) AS week, count(*) AS added, count(*) FILTER ({DUPLICATE}) AS dups, count(*) FILTER (decision = 'approved') AS approved FROM calls WHERE posted BETWEEN DATE '{AS_OF}' - 28 AND DATE '{AS_OF}' GROUP BY 1"""))
def weekly_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.lit(AS_OF))
    rows = calls(spark, sf_dir).where(F.col("posted").between(F.date_sub(day, 28), day))
    return rows.groupBy(dates.bucket_start(F.col("posted"), "week").alias("week")).agg(F.count("*").alias("added"), F.count_if(F.expr(DUPLICATE)).alias("dups"), F.count_if(F.col("decision") == "approved").alias("approved"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS word FROM documents)
 SELECT word, count(*) AS hits, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM w JOIN labels USING (doc_id) GROUP BY word HAVING count(*) >= 20""")
def keyword_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, not frequency, of each word against the outcome of its document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    words = docs.join(labels, "doc_id").select("quality", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("hits"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic")).where("hits >= 20")


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents)
 SELECT CASE WHEN word LIKE '%tion' THEN '-tion' WHEN word LIKE '%ing' THEN '-ing' ELSE word END AS stem, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 50""")
def keyword_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word")
    stem = F.when(word.endswith("tion"), "-tion").when(word.endswith("ing"), "-ing").otherwise(word)
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("word"))
    return words.groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).where("n >= 50")
