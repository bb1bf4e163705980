"""Companion pages: a call without a deadline whose calendar or form stands on another landed page, one link away."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.deadlines import deadline
from ..operators.ranking import top_per_group
from .html import anchors
from .tables import scratch

#: Wording of addresses of calendars and forms, of listings of calls, and of share buttons.
STRONG = ("odess", "/calendar", "/timeline", "candidater", "appel-a-projet", "appel_a_projet", "application-form", "application_form")
WEAK = ("call-for-project", "call_for_project")
SHARES = ("linkedin.com", "facebook.com", "twitter.com", "//x.com", "sharer", "sharearticle", "/share/", "/share?", "wa.me", "whatsapp", "t.me", "pinterest", "reddit.com", "mailto:")
_STRONG = "|".join([*map(re.escape, STRONG), r"/apply(?![\w])"])


def companion_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, target, link, rank, at): links to companions. Another host counts 2, a calendar or form 1; ties by the page's order.
    A page's links to itself go, a target counts once, fragments do not matter. Links are dealt by page, once."""
    found = anchors(pages.withColumn("own", F.col("url")), key, keep=["own"]).withColumn("low", F.lower("link")).withColumn("target", urls.store_key(F.col("link")))
    strong, weak, shares = _STRONG, "|".join(map(re.escape, WEAK)), "|".join(map(re.escape, SHARES))
    rows = found.where(F.col("low").rlike(f"{strong}|{weak}") & ~F.col("low").rlike(shares)).withColumn("strong", F.col("low").rlike(strong))
    rows = rows.where(F.col("target") != urls.store_key(F.col("own")))
    rank = F.when(urls.host(F.col("link")) != urls.host(F.col("own")), 2).otherwise(0) + F.col("strong").cast("int")
    slim = rows.select(key, "target", "link", rank.alias("rank"), F.col("place").alias("at")).repartition(key)
    return slim.groupBy(key, "target").agg(F.min_by(F.struct("link", "rank", "at"), "at").alias("x")).select(key, "target", "x.*")


def companion_deadlines(pages: DataFrame, year: int, most: int = 3, key: str = "page_id") -> DataFrame:
    """(key, link, deadline) of each page without a deadline of its own, from the first of its `most` best companions that is
    landed and gives one. One hop: companions' own links are not followed. Of pages landed twice under one address, the one
    with the largest key is read; pages without a companion give no row.

    Pages are dealt over all tasks, as they are small and long to read, and each is read once: its deadline is kept beside
    its address, its text only if it lacks one."""
    spark = pages.sparkSession
    dealt = pages.where("html is not null and url is not null").select(key, "url", "html").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    read = dealt.withColumn("text", urls.strip_html(F.col("html"))).select(key, "url", "html", deadline(F.col("text"), year)["deadline"].alias("deadline"))
    path = scratch(spark, "landed")
    read.withColumn("html", F.when(F.col("deadline").isNull(), F.col("html"))).write.parquet(path)
    kept = spark.read.parquet(path)
    lacking = kept.where("deadline is null").select(key, "url", "html")
    best = top_per_group(companion_links(lacking, key), [key], [F.desc("rank"), F.asc("at")], most)
    landed = kept.groupBy(urls.store_key(F.col("url")).alias("target")).agg(F.max_by("deadline", key).alias("deadline")).where("deadline is not null")
    hits = best.join(landed, "target")
    return hits.groupBy(key).agg(F.min_by(F.struct("link", "deadline"), "place").alias("x")).select(key, "x.*")
