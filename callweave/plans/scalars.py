"""Scalar functions over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text, urls
from ..registry import query
from .carriers import AS_OF, calls, read, with_calls

_BARE = "regexp_replace(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '/+$', '')"
_COMPARABLE = f"regexp_replace(lower(regexp_extract({_BARE}, '^([^/]*)', 1)), '^www\\.', '') || regexp_extract({_BARE}, '^[^/]*(.*)$', 1)"
_STORE = "regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '/+$', '')"
_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, {_COMPARABLE} AS norm, count(*) OVER (PARTITION BY {_COMPARABLE}) AS same FROM pages")
def url_norm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", urls.comparable(F.col("url")).alias("norm"))
    return pages.join(pages.groupBy("norm").agg(F.count("*").alias("same")), "norm").select("page_id", "norm", "same")


@query(f"SELECT page_id, {_STORE} AS store_key, sha1({_STORE}) AS uid FROM pages")
def url_norm_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.store_key(F.col("url")).alias("store_key"), urls.uid(F.col("url")).alias("uid"))


@query(f"""SELECT page_id, CASE WHEN {_HOST} = 'example.net' OR {_HOST} LIKE '%.example.net' THEN 'primary' WHEN {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' THEN 'aggregator' WHEN {_HOST} LIKE 'blog.%' THEN 'blog' ELSE 'unknown' END AS class FROM pages""")
def host_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = urls.host(F.col("url"))
    kind = F.when(urls.host_in(name, ["example.net"]), "primary").when(urls.host_in(name, ["example.com"]), "aggregator").when(name.startswith("blog."), "blog").otherwise("unknown")
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("class"))


@query("SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^\\s/]+\\.[^\\s/]+') THEN trim(url) END AS link, CASE WHEN page_id % 2 = 0 THEN 'https://bare' || page_id || '.org/x' END AS bare FROM pages")
def link_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("bare"), F.col("page_id").cast("string"), F.lit(".org/x"))).otherwise("no link")
    return read(spark, sf_dir, "pages").select("page_id", urls.valid_link(F.col("url")).alias("link"), urls.valid_link(bare).alias("bare"))


_TITLE = "'RFP: ' || left(split_part(text, chr(10), 1), 60) || ' 2024'"


@query(f"SELECT doc_id, trim(regexp_replace(lower(CASE WHEN length(trim(substr(t, 6))) < 8 THEN t ELSE substr(t, 6) END), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title FROM (SELECT doc_id, {_TITLE} AS t FROM documents)")
def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.normal_title(_title()).alias("title"))


def _title():
    return F.concat(F.lit("RFP: "), F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(60)), F.lit(" 2024"))


_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC)


@query(f"""WITH x AS (SELECT doc_id, trim(regexp_replace(lower(CASE WHEN length(trim(substr(t, 6))) < 8 THEN t ELSE substr(t, 6) END), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title FROM (SELECT doc_id, {_TITLE} AS t FROM documents))
 SELECT doc_id, coalesce(array_to_string(list_sort(list_filter(list_distinct(string_split(title, ' ')), lambda w: length(w) >= 3 AND w NOT IN ({_GENERIC}) AND NOT regexp_matches(w, '^[0-9]{{4}}$'))), ' '), '') AS tokens FROM x""")
def distinctive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(text.distinctive_tokens(_title())), " ").alias("tokens"))


@query("""SELECT o_orderkey, round(o_totalprice / 1000, 2) * 1000 AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency FROM orders""")
def money_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest amount of a text made from the row: 'from $5 up to USD 12.34k in all'.

    Hundredths are rounded as doubles, as the SQL does: Spark's round(x, 2) goes by the decimal text, so 77.195 (which is
    a bit less) would go up.
    """
    k, size = F.col("o_orderkey"), F.format_string("%.2f", F.round(F.col("o_totalprice") / 1000 * 100) / 100)
    body = F.when(k % 3 == 0, F.concat(F.lit("from $5 up to USD "), size, F.lit("k in all"))).when(k % 3 == 1, F.concat(F.lit("award: "), size, F.lit("k EUR, 3 lots"))).otherwise(F.concat(F.lit("worth £"), size, F.lit(" thousand")))
    best = money.largest(body)
    return read(spark, sf_dir, "orders").select("o_orderkey", best["amount"].alias("amount"), best["currency"].alias("currency"))


@query(with_calls(f"SELECT uid, CAST(date_diff('day', DATE '{AS_OF}', deadline) AS INTEGER) AS days FROM calls"))
def days_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", dates.days_until(F.col("deadline"), AS_OF).alias("days"))


@query(with_calls(f"""SELECT uid, CASE WHEN progress = 'completed' THEN CASE WHEN deadline < DATE '{AS_OF}' THEN 'Submitted (closed)' ELSE 'Submitted' END WHEN deadline IS NULL THEN 'No deadline' WHEN deadline < DATE '{AS_OF}' THEN 'Overdue' WHEN deadline <= DATE '{AS_OF}' + 14 THEN 'Due Soon' ELSE 'On Track' END AS status FROM calls"""))
def deadline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", dates.deadline_status(F.col("deadline"), F.col("progress") == "completed", AS_OF).alias("status"))


@query(with_calls("""SELECT uid, 'Week ' || CAST(week(m) AS VARCHAR) || ' (' || strftime(m, '%-d %b') || ' - ' || strftime(m + INTERVAL 6 DAY, '%-d %b') || ')' AS label FROM (SELECT uid, date_trunc('week', CASE WHEN isodow(posted) >= 5 THEN posted + 3 ELSE posted END) AS m FROM calls)"""))
def review_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", dates.review_week(F.col("posted")).alias("label"))


_RATE = "CASE currency " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in money.RATES.items()) + " END"


@query(with_calls(f"SELECT uid, round(cents * CAST({_RATE} AS DOUBLE), 2) AS strict, round(cents * coalesce(CAST({_RATE} AS DOUBLE), 1.0), 2) AS lenient FROM calls"))
def fx_convert_two_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, amount = F.col("currency"), F.col("cents")
    return calls(spark, sf_dir).select("uid", F.round(money.in_dollars(amount, c), 2).alias("strict"), F.round(money.in_dollars(amount, c, True), 2).alias("lenient"))


@query("SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS key, regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g') AS slug FROM customer")
def funder_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("–")), F.lit("­ "))  # an en dash and a soft hyphen change no key
    return read(spark, sf_dir, "customer").select("c_custkey", text.funder_key(odd).alias("key"), text.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha2 AS hash FROM (SELECT event_id, props, sha256(props) AS sha2 FROM events)""")
def json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2("props", 256).alias("hash"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 6 ELSE NULL END AS INTEGER) AS low, CAST(CASE o_orderkey % 4 WHEN 0 THEN 18 WHEN 1 THEN 24 WHEN 2 THEN 6 ELSE NULL END AS INTEGER) AS high FROM orders""")
def duration_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    months = dates.duration_months(F.when(k == 0, "runs 12-18 months").when(k == 1, "2 years at most").when(k == 2, "within 6 months").otherwise("open ended"))
    return read(spark, sf_dir, "orders").select("o_orderkey", months["low"].alias("low"), months["high"].alias("high"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def date_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 2, F.date_format(t, "d MMM yyyy")).when(k == 3, F.date_format(t, "MMMM d, yyyy")).otherwise(F.date_format(t, "d/M/yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.coerce_date(written).alias("day"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Acme Co Inc.|Beta' WHEN 1 THEN 'Save Fund (SF)|Gamma Ltd' ELSE 'Delta' END AS partners, CAST(CASE s_suppkey % 3 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS n FROM supplier""")
def partner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    names = text.partners(F.when(k == 0, "Acme Co, Inc.; Beta").when(k == 1, "Save Fund; (SF), Gamma, Ltd").otherwise(" Delta ;"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(names, "|").alias("partners"), F.size(names).alias("n"))


@query("""SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN NULL ELSE 0.0 END AS DOUBLE) AS score FROM customer""")
def criterion_label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    label = F.when(k == 0, " Yes ").when(k == 1, "mostly met, it seems").when(k == 2, "Not sure").otherwise("NO")
    return read(spark, sf_dir, "customer").select("c_custkey", text.label_score(label, {"yes": 1, "no": 0, "partial": 0.5}, [("not met", 0), ("mostly", 0.5), ("met", 1)]).alias("score"))
