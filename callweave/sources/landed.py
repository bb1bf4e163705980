"""Candidates from landed payloads of portals: one parser a shape, all with the same columns.

A payload is JSON (or XML) as its portal answers, landed in files; Spark's readers take it with a schema, so only the
named fields are read, and every parser is a flat projection: no driver loop, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("source", "opportunity_id", "title", "link", "funder", "amount", "currency", "deadline", "posted", "description")
#: Hosts of alerts that lead to no call.
NOISE_HOSTS = ("twitter.com", "x.com", "facebook.com", "fb.com", "m.facebook.com", "linkedin.com", "lnkd.in", "youtube.com", "youtu.be", "instagram.com", "reddit.com", "tiktok.com", "news.google.com", "feedburner.com", "scholar.google.com")


def candidates(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    kinds = {"amount": "double", "deadline": "date", "posted": "date"}
    made = {"source": F.lit(source)} | fields
    return df.select(*[made.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def day(c: Column) -> Column:
    """Dates as portals write them: ISO, M/d/yyyy, d-MMM-yyyy, or milliseconds since 1970."""
    text = F.trim(c.cast("string"))
    epoch = F.to_date(F.timestamp_millis(F.when(text.rlike(r"^\d{12,14}$"), text).try_cast("long")))
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.coalesce(iso, F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "d-MMM-yyyy"), epoch)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one document each, or with a document a line (.jsonl), which many tasks can share."""
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def alerts(spark: SparkSession, path: str, noise: Sequence[str] = NOISE_HOSTS) -> DataFrame:
    """Alert feeds (RSS): the redirector's target is unwrapped, hosts of noise go, the funder is the host's name."""
    items = spark.read.format("xml").option("rowTag", "item").load(path)
    link = F.col("link").cast("string")
    target = F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract(link, r"[?&](?:url|q)=([^&]+)", 1), F.lit(""))), link)
    rows = items.select(F.trim(F.regexp_replace("title", "<[^>]+>", "")).alias("title"), target.alias("link"), F.col("pubDate").cast("string").alias("at"))
    host = F.regexp_extract(F.lower("link"), r"^https?://(?:www\.)?([^/?#]+)", 1)
    rows = rows.withColumn("host", host)
    for h in noise:
        rows = rows.where((F.col("host") != h) & ~F.col("host").endswith(f".{h}"))
    posted = F.to_date(F.try_to_timestamp(F.regexp_replace("at", "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return candidates(rows, "alerts", title=F.col("title"), link=F.col("link"), funder=F.initcap(F.split_part("host", F.lit("."), F.lit(1))), posted=posted)


def federal_grants(spark: SparkSession, path: str) -> DataFrame:
    """Search answers with details: ceilings count as amounts, zero and blank as none."""
    schema = "oppHits array<struct<id:string,number:string,title:string,agency:string,openDate:string,closeDate:string,synopsis:struct<awardCeiling:string,synopsisDesc:string>>>"
    r = _json(spark, path, schema).select(F.explode("oppHits").alias("r"))
    ceiling = F.regexp_replace("r.synopsis.awardCeiling", "[$,]", "").try_cast("double")
    return candidates(r, "federal grants", opportunity_id=F.col("r.number"), title=F.col("r.title"), link=F.concat(F.lit("https://www.grants.gov/search-results-detail/"), F.col("r.id")), funder=F.col("r.agency"), amount=F.when(ceiling > 0, ceiling), currency=F.lit("USD"), deadline=day(F.col("r.closeDate")), posted=day(F.col("r.openDate")), description=F.regexp_replace("r.synopsis.synopsisDesc", "<[^>]+>", " "))


def eu_topics(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Topics with several cut-off dates and a budget for several awards: the next date that is not past, the budget of one award."""
    schema = "results array<struct<reference:string,metadata:struct<identifier:array<string>,title:array<string>,deadlineDate:array<string>,startDate:array<string>,budget:array<string>,expectedGrants:array<string>>>>"
    r = _json(spark, path, schema).select(F.explode("results").alias("r")).select("r.reference", "r.metadata.*")
    dates = F.array_sort(F.array_compact(F.transform("deadlineDate", day)))
    ahead = F.filter(dates, lambda d: d >= F.to_date(F.lit(as_of)))
    budget, n = F.regexp_replace(F.get("budget", F.lit(0)), "[^0-9.]", "").try_cast("double"), F.get("expectedGrants", F.lit(0)).try_cast("int")
    return candidates(r, "eu topics", opportunity_id=F.get("identifier", F.lit(0)), title=F.get("title", F.lit(0)), link=F.concat(F.lit("https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/"), F.lower(F.get("identifier", F.lit(0)))), funder=F.lit("European Commission"), amount=F.when(n > 0, budget / n).otherwise(budget), currency=F.lit("EUR"), deadline=F.coalesce(F.array_min(ahead), F.array_max(dates)), posted=day(F.get("startDate", F.lit(0))))


def bank_notices(spark: SparkSession, path: str) -> DataFrame:
    schema = "procnotices array<struct<id:string,bid_description:string,notice_text:string,project_name:string,project_ctry_name:string,submission_deadline_date:string,noticedate:string>>"
    r = _json(spark, path, schema).select(F.explode("procnotices").alias("r"))
    return candidates(r, "bank notices", opportunity_id=F.col("r.id"), title=F.coalesce(F.nullif(F.trim("r.bid_description"), F.lit("")), "r.project_name"), link=F.concat(F.lit("https://projects.worldbank.org/en/projects-operations/procurement-detail/"), F.col("r.id")), funder=F.lit("World Bank"), deadline=day(F.col("r.submission_deadline_date")), posted=day(F.col("r.noticedate")), description=F.regexp_replace("r.notice_text", "<[^>]+>", " "))


def tenders(spark: SparkSession, path: str) -> DataFrame:
    """Procurement notices: titles by language, English first; the buyer by language likewise."""
    schema = "notices array<struct<`publication-number`:string,`notice-title`:map<string,string>,`buyer-name`:map<string,array<string>>,`deadline-receipt-tender-date-lot`:array<string>,`publication-date`:string>>"
    r = _json(spark, path, schema).select(F.explode("notices").alias("r")).select(F.col("r.publication-number").alias("id"), F.col("r.notice-title").alias("titles"), F.col("r.buyer-name").alias("buyers"), F.col("r.deadline-receipt-tender-date-lot").alias("dates"), F.col("r.publication-date").alias("at"))
    english = lambda c: F.coalesce(F.try_element_at(c, F.lit("eng")), F.get(F.map_values(c), F.lit(0)))
    return candidates(r, "tenders", opportunity_id=F.col("id"), title=english("titles"), link=F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), F.col("id")), funder=F.get(english("buyers"), F.lit(0)), deadline=F.array_max(F.transform("dates", day)), posted=day(F.col("at")))


def self_candidates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages that are calls themselves: one candidate each where the text has a call's wording and a deadline's, and a title."""
    title = F.trim(F.regexp_extract(html, r"(?is)<(?:h1|title)[^>]*>(.*?)</", 1))
    body = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    rows = pages.withColumn("__title", F.trim(F.regexp_replace(title, "<[^>]+>", " "))).withColumn("__body", F.trim(F.regexp_replace(body, r"\s+", " ")))
    is_call = F.col("__body").rlike(r"(?i)\b(?:call for (?:proposals|applications)|request for (?:proposals|applications)|notice of funding)\b") & F.col("__body").rlike(r"(?i)\b(?:deadline|closing date|apply by)\b")
    return candidates(rows.where(is_call & (F.col("__title") != "")), "page", title=F.col("__title"), link=F.col(url), description=F.left("__body", F.lit(600)))


#: Parsers by method; a source names its method and folder.
METHODS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"alerts": alerts, "federal_grants": federal_grants, "bank_notices": bank_notices, "tenders": tenders}


def dispatched(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """All candidates of (method, path) sources; an unknown method raises before anything is read."""
    unknown = sorted({m for m, _ in sources} - set(METHODS))
    if unknown:
        raise ValueError(f"no parser for {', '.join(unknown)}")
    out = candidates(spark.range(0), "none")
    for method, path in sources:
        out = out.unionByName(METHODS[method](spark, path))
    return out
