"""Rows from landed pages: anchors, candidates and feeds."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ANCHOR = re.compile(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a\s*>""")
#: Titles of links that lead to no call.
JUNK = frozenset(("home", "about", "contact", "login", "register", "search", "next", "previous", "more", "read more", "skip to content", "menu"))


#: Plain addresses, which urljoin hands back as they are, and plain paths, which it sets behind the base's host.
_PLAIN, _HOST, _REST = r"(?=[!-:<-Z\\^-~]+\Z)(?!.*/\.)", r"https?://[A-Za-z0-9.:-]+", r"(?:\?[^#]+)?(?:#.+)?"
_WHOLE = re.compile(rf"{_PLAIN}{_HOST}(?:/[^?#]*)?{_REST}")
_PATH = re.compile(rf"{_PLAIN}/(?!/)[^?#]*{_REST}")
_ROOT = re.compile(rf"{_HOST}(?=[/?#]|\Z)")


def joined(base: str, root: str, target: str) -> str:
    """urljoin(base, target), spared where there is nothing to resolve; `root` is the base up to its path, if that is plain."""
    if _WHOLE.fullmatch(target):
        return target
    return root + target if root and _PATH.fullmatch(target) else urljoin(base, target)


def anchors_of(base: str, page: str) -> Iterator[tuple[str, str]]:
    base = base or ""
    start = _ROOT.match(base)
    root = start[0] if start else ""
    for double, single, bare, inner in _ANCHOR.findall(page or ""):
        target = entities.unescape(double or single or bare).strip()
        title = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner) if "<" in inner else inner).split())
        if title and target and not target.startswith(("#", "javascript:", "mailto:")) and title.lower() not in JUNK:
            yield title, joined(base, root, target)


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, place, title, link): the links of every page, absolute, without empty and junk ones. Columns of the page
    named in `keep` follow."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)
            rows = [(n, i, *x) for n, (u, h) in enumerate(pages) for i, x in enumerate(anchors_of(u, h))]
            at, place, title, link = zip(*rows, strict=True) if rows else ((),) * 4
            of = pa.array(at, "int64")
            columns = [batch["key"].take(of), pa.array(place, "int32"), pa.array(title, "string"), pa.array(link, "string"), *[batch[c].take(of) for c in keep]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "title", "link", *keep])

    kinds = dict(pages.dtypes)
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), *[c for c in keep if c not in ("url", "html")])
    schema = ", ".join([f"key {kinds[key]}, place int, title string, link string", *[f"{c} {kinds[c]}" for c in keep]])
    return slim.mapInArrow(scan, schema).withColumnRenamed("key", key)


def children(pages: DataFrame, most: int = 8) -> DataFrame:
    """Listing expansion: the first `most` different links of each page."""
    found = anchors(pages)
    firsts = found.groupBy("page_id", "link").agg(F.min(F.struct("place", "title")).alias("x"))
    from ..operators.ranking import top_per_group

    ranked = top_per_group(firsts.select("page_id", "link", "x.place", "x.title").withColumnRenamed("place", "at"), ["page_id"], [F.asc("at")], most)
    return ranked.select("page_id", "place", "title", "link")


def rss(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of landed RSS files, by Spark's XML reader."""
    items = spark.read.format("xml").option("rowTag", "item").load(path)
    have = set(items.columns)
    column = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    return items.select(column("title").alias("title"), column("link").alias("link"), F.try_to_timestamp(F.regexp_replace(column("pubDate"), "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"))


def releases(spark: SparkSession, path: str) -> DataFrame:
    """One row per release of landed open-contracting packages."""
    schema = "releases array<struct<ocid:string,date:string,tender:struct<title:string,description:string,value:struct<amount:double,currency:string>,tenderPeriod:struct<endDate:string>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("releases").alias("r"))
    return r.select("r.ocid", F.col("r.tender.title").alias("title"), F.col("r.tender.description").alias("description"), F.col("r.tender.value.amount").alias("amount"), F.col("r.tender.value.currency").alias("currency"), F.to_date(F.left("r.tender.tenderPeriod.endDate", F.lit(10))).alias("deadline"))
