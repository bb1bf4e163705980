"""Main text of web pages: block structure, and the runs that a host repeats on pages of different content.

Structure says what a block is: inside an article (or main) element, outside of one, or noise (menus, headers,
footers, sidebars, notices, adverts, forms, comments). Every page's blocks of all three kinds take part in a search
for what its host repeats:

* A block inside an article is dropped if the host shows the same block outside of articles or as noise on at least
  BESIDE pages (of more than one content), and no less often than inside articles. A copy or quotation that only articles
  share is part of their text and stays.
* A page without an article leaves open which of its blocks are text. There, strings of `RUN` tokens or more that
  the host's other pages hold outside of articles are boilerplate: covered tokens go, unique runs stay.

This stands for the suffix array over each host's concatenated pages: a host may hold a third of all pages, so it is
in no task's reach. Blocks and windows of RUN tokens are hashed to 128 bits instead, and one exchange with map-side
minima, maxima and counts finds those with more than one content: the array's covered tokens, exactly, with
no host or shard gathered in a task.

Edge cases: null and empty html gives the empty text; unclosed and stray tags, tags cut off by the end of the
page, and attributes with > in quotes are read as browsers do; repeated pages are no distinct pages, so copies
never remove each other; null urls share one host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .linkgraph import host_of

RUN = 8
#: Pages on which a host must show an article's block elsewhere before it is no article text.
BESIDE = 3
#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NOISE = frozenset("nav footer aside form script style noscript iframe svg math canvas button select template menu dialog head title textarea object audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words in class, id and role that name what is no article text.
NOISE_WORDS = frozenset("nav navbar navigation menu menubar sidebar footer header masthead ad ads advert adverts advertisement advertising banner cookie cookies consent notice notices gdpr comment comments disqus respond share sharing social promo promoted sponsored sponsor related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup popup modal overlay widget toolbar contentinfo complementary search pagination pager skip".split())
#: Words that stand beside those in one name ("site-footer", "comment-list") without changing what it names.
PLACE_WORDS = frozenset("site page global top bottom left right main primary secondary inner outer bar box list item items block area section wrapper wrap container row col column content links link button buttons form js the".split())
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
CLOSES_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}

_MARKUP = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_NAME_PARTS = re.compile(r"[^a-zA-Z]+")
_SPACE = re.compile(r"\s+")


def names_noise(value: str, words: frozenset[str] = NOISE_WORDS) -> bool:
    """Whether one of the names in a class, id or role is made of such words, with words of place beside them."""
    for name in value.lower().split():
        parts = [p for p in _NAME_PARTS.split(name) if p]
        if any(p in words for p in parts) and all(p in words or p in PLACE_WORDS for p in parts):
            return True
    return False


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name in ("class", "id", "role") and names_noise(value, COMMENT_WORDS if tag == "article" else NOISE_WORDS):
            return True
    return False


def blocks(page: str) -> tuple[list[str], bool]:
    """The text blocks of a page, and whether they come from an article or main element."""
    inside, outside, _, found = all_blocks(page)
    return (inside, True) if found else (outside, False)


def all_blocks(page: str) -> tuple[list[str], list[str], list[str], bool]:
    """The text blocks inside and outside of article and main elements, those of noise, and whether there is such an element."""
    inside: list[str] = []
    outside: list[str] = []
    noisy_blocks: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, noise from here on, in an article from here on)
    parts: list[str] = []
    aside: list[str] = []
    found = False
    noise = article = False
    at, end = 0, len(page)

    def close_block() -> None:
        for held, to in ((parts, inside if article else outside), (aside, noisy_blocks)):
            if held:
                text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
                held.clear()
                if text:
                    to.append(text)

    def set_state() -> None:
        nonlocal noise, article
        noise, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def pop_to(i: int) -> None:
        close_block()
        del stack[i:]
        set_state()

    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            (aside if noise else parts).append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6] or ""
        if m[2] is None and at == end and page[end - 1] != ">":
            break  # a tag that the end of the page cuts off
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0:
                above = any(x[0] in BLOCKS for x in stack[i:])
                if tag in BLOCKS or (above and stack[i][1]):
                    pop_to(i)
                elif not above:  # inline: the block goes on
                    del stack[i:]
                    set_state()
            elif tag == "p" or tag in BLOCKS:
                close_block()
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                (aside if noise else parts).append(" ")
            continue
        if tag in CLOSES_P:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            if i >= 0 and stack[i][0] == "p":
                pop_to(i)
        elif tag in ("li", "dd", "dt", "tr", "td", "th"):
            same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
            scope = ("ul", "ol", "dl", "menu", "table") + (("tr",) if tag in ("td", "th") else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in same:
                    pop_to(i)
                    break
        if tag in BLOCKS:
            close_block()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        was = noise
        noisy = noise or _is_noise(tag, attributes, article)
        article_now = article or (tag in ("article", "main") and not noisy)
        found = found or (article_now and not article)
        if noisy and not was and tag not in BLOCKS:
            parts.append(" ")
            aside.append(" ")
        if tag in RAW:
            closed = _RAW_END[tag].search(page, at)
            if not noisy:
                parts.append(page[at : closed.start() if closed else end])
            at = closed.end() if closed else end
            continue
        if article_now != article:
            close_block()
        stack.append((tag, noisy, article_now))
        noise, article = noisy, article_now
    close_block()
    return inside, outside, noisy_blocks, found


def _tokens(page: list[str]) -> list[str]:
    return [w for b in page for w in b.split(" ")]


def _digests(tokens: list[str], run: int) -> tuple[bytes, list[bytes]]:
    """128-bit hashes of a page's tokens, and of each window of `run` of them."""
    words = [w.encode("utf-8", "surrogatepass") for w in tokens]
    digest = xxhash.xxh3_128_digest
    return digest(b" ".join(words)), [digest(b" ".join(words[i : i + run])) for i in range(len(words) - run + 1)]


def without_runs(page: list[str], starts: list[int], run: int) -> str:
    """The page's text without the tokens of the windows that begin at `starts`."""
    gone = np.zeros(sum(b.count(" ") + 1 for b in page) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.array(starts, np.int64) + run, -1)
    gone = np.cumsum(gone) > 0
    at, kept = 0, []
    for b in page:
        own = b.split(" ")
        left = [w for w, x in zip(own, gone[at : at + len(own)], strict=True) if not x]
        at += len(own)
        if left:
            kept.append(" ".join(left))
    return "\n\n".join(kept)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN, beside: int = BESIDE) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated): the last counts the blocks and windows that went because the host repeats them."""
    types = dict(pages.dtypes)
    head = f"key {types[key]}, url {types[url]}"
    digest = xxhash.xxh3_128_digest

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_blocks(v.as_py() or "") for v in batch.column(2)]
            settled = pa.array([closed or not outside for _, outside, _, closed in found])
            own = pa.array([inside if closed else outside for inside, outside, _, closed in found], pa.list_(pa.string()))
            other = pa.array([(outside if closed else []) + noise for _, outside, noise, closed in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), settled, own, other], names=["key", "url", "settled", "blocks", "others"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page, host, settled, blocks, others) -> a row for each different block, with where it stands."""
        for batch in batches:
            rows: list[tuple] = []
            for page, host, settled, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = digest("\0".join(own).encode("utf-8", "surrogatepass"))
                inside = own if settled else []
                away = other if settled else own + other
                rows += [(page, host, digest(b.encode("utf-8", "surrogatepass")), content, 1, 0) for b in set(inside)]
                rows += [(page, host, digest(b.encode("utf-8", "surrogatepass")), content, 0, 1) for b in set(away)]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 20_000], strict=True), (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["page", "host", "w", "content", "inside", "away"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page, host, blocks) -> a row for each window."""
        for batch in batches:
            for page, host, found in zip(*batch.columns, strict=True):
                content, own = _digests(_tokens(found.as_py()), run)
                n = len(own)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([page.as_py()] * n, pa.int64()), pa.array([host.as_py()] * n, pa.string()), pa.array(own, pa.binary()), pa.array([content] * n, pa.binary()), pa.array(range(n), pa.int32())], names=["page", "host", "w", "content", "at"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, went = [], []
            for found, starts, gone in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                dropped = set(gone or ())
                kept = [b for b in found if digest(b.encode("utf-8", "surrogatepass")) not in dropped] if dropped else found
                text.append(without_runs(kept, starts or [], run))
                went.append(len(found) - len(kept) + len(starts or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(went, pa.int64())], names=["key", "url", "text", "n_repeated"])

    # parsed once; most pages are settled by their own structure
    parsed = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(parse, f"{head}, settled boolean, blocks array<string>, others array<string>")
    parsed = stored(parsed.withColumn("host", host_of(F.col("url"))).withColumn("page", F.monotonically_increasing_id()), "blocks")
    # blocks inside of articles that the host shows more often elsewhere; each page counts once for a block
    blocks_ = parsed.select("page", "host", "settled", "blocks", "others").mapInArrow(signed, "page long, host string, w binary, content binary, inside int, away int")
    per = blocks_.groupBy("host", "w").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.sum("inside").alias("inside"), F.sum("away").alias("away"))
    shown = per.where((F.col("inside") > 0) & (F.col("away") >= beside) & (F.col("away") >= F.col("inside")) & (F.col("a") != F.col("b"))).select("host", "w")
    gone = blocks_.where("inside > 0").join(shown, ["host", "w"]).groupBy("page").agg(F.collect_list("w").alias("gone"))  # of one page
    # tokens of pages without an article that the host's pages hold outside of articles
    open_ = parsed.where("not settled").select("page", "host", "blocks")
    hosts = open_.select("host").distinct()
    evidence = parsed.where("size(others) > 0").join(hosts, "host", "left_semi").select("page", "host", F.col("others").alias("blocks"))
    schema = "page long, host string, w binary, content binary, at int"
    own = open_.mapInArrow(windows, schema)
    every = own.unionByName(evidence.mapInArrow(windows, schema))
    shared = every.groupBy("host", "w").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("host", "w")
    starts = own.join(shared, ["host", "w"]).groupBy("page").agg(F.collect_list("at").alias("starts"))  # of one page
    found = stored(gone.join(starts, "page", "full"), "repeats")  # few pages; their blocks are joined by key, all others pass
    hit = parsed.join(found, "page").select("key", "url", "blocks", "starts", "gone").mapInArrow(clean, f"{head}, text string, n_repeated long")
    rest = parsed.join(found.select("page"), "page", "left_anti").select("key", "url", F.array_join("blocks", "\n\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
    return hit.unionByName(rest).select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
