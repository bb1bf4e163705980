"""Incremental state over the carriers: change capture, ledgers, expiry, watermarks; and rows from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..registry import query
from ..sources import html, tables
from .carriers import AS_OF, calls, read, with_calls


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'added' WHEN page_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM pages WHERE page_id % 5 = 0 AND page_id % 7 <> 0 OR page_id % 5 <> 0 AND (page_id % 7 = 0 OR page_id % 3 = 0)")
def page_change_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots made from the pages: some missing in either, some altered."""
    pages, k = read(spark, sf_dir, "pages").select("page_id", "html"), F.col("page_id")
    before = pages.where(k % 5 != 0)
    after = pages.where(k % 7 != 0).withColumn("html", F.when(k % 3 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")))
    return tables.changed_pages(before, after, "page_id", "html")


_OPEN = f"CASE WHEN deadline < DATE '{AS_OF}' THEN 'past deadline' WHEN deadline IS NULL AND posted < DATE '{AS_OF}' - 90 THEN 'stale' END"


@query(with_calls(f"SELECT uid, coalesce({_OPEN}, 'open') AS status FROM calls"))
def close_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.lit(AS_OF))
    status = F.when(F.col("deadline") < day, "past deadline").when(F.col("deadline").isNull() & (F.col("posted") < F.date_sub(day, 90)), "stale").otherwise("open")
    return calls(spark, sf_dir).select("uid", status.alias("status"))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-25'")
def newer_than_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.newer_than(read(spark, sf_dir, "events").select("event_id", "ts"), ["ts"], "2024-01-25")


@query(with_calls("""SELECT a.uid FROM calls a WHERE a.uid % 2 = 0 AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.uid = a.uid AND b.decision = 'declined')"""))
def tombstone_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return c.where("uid % 2 = 0").join(c.where("decision = 'declined'").select("uid"), "uid", "left_anti").select("uid")


@query(with_calls("SELECT uid, least(posted, DATE '1998-01-01') AS first_seen, greatest(posted, DATE '1998-01-01') AS last_seen FROM calls WHERE uid % 3 = 0"))
def rescan_seen_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of a row: the first sighting never moves, the last one advances."""
    c = calls(spark, sf_dir).where("uid % 3 = 0")
    scans = c.select("uid", F.col("posted").alias("seen")).unionByName(c.select("uid", F.to_date(F.lit("1998-01-01")).alias("seen")))
    return scans.groupBy("uid").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


@query("SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS unread, count(*) AS n FROM events GROUP BY user_id")
def unread_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.col("ts") > F.lit("2024-01-20").cast("timestamp")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(fresh).alias("unread"), F.count("*").alias("n"))


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS place, regexp_replace(title, '&amp;', '&') AS title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link AS link FROM
 (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS link, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS i FROM pages)""")
def html_anchors_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.anchors(read(spark, sf_dir, "pages"))


@query()
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.strip_html(F.col("html")).alias("text"))


@query()
def listing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.children(read(spark, sf_dir, "pages"))
