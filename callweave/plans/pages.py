"""Records, tables and companions of landed pages, and search over them.

The given pages are read as they are; portals' layouts, notice tables and companion pages are landed from orders, lines,
customers, parts and suppliers, sixteen calls a page, so that they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import search
from ..registry import query
from ..sources import companions, markup
from ..sources.tables import scratch
from .carriers import read, spread

YEAR = 1998


@query(r"""WITH n AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1, 's') AS menu FROM pages),
 r AS (SELECT page_id, host, unnest(regexp_extract_all(menu, '<li>.*?</li>')) AS li, generate_subscripts(regexp_extract_all(menu, '<li>.*?</li>'), 1) - 1 AS place FROM n WHERE len(regexp_extract_all(menu, '<li>.*?</li>')) > 1)
 SELECT page_id, CAST(place AS INTEGER) AS place, replace(regexp_extract(li, '<a href="[^"]*">(.*)</a>', 1), '&amp;', '&') AS title, host || replace(regexp_extract(li, 'href="([^"]*)"', 1), '&amp;', '&') AS link FROM r""")
def menu_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the given pages repeat are their menus; the induction finds them without being told."""
    found = markup.records(read(spark, sf_dir, "pages"))
    return found.where("path like '%nav/ul/li'").select("page_id", "place", "title", "link")


_TITLE = "concat('Grant ', cast({0} as varchar(20)), ' for ', {1})"
_MONTH = "CAST(floor(o_orderkey / 16) AS BIGINT)"


def _sixteens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls, sixteen a page: page, uid, title, link and closing day."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.floor(k / 16).alias("page_id"), k.alias("uid"), F.concat(F.lit("Grant "), k.cast("string"), F.lit(" for "), F.col("o_orderpriority")).alias("title"), F.date_add(F.to_date("o_orderdate"), 30).alias("closes"))


def _dealt(rows: DataFrame) -> DataFrame:
    """By page, over all tasks: pages are small in rows and long to read, so that a plan by bytes would give one task all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in four layouts: cards with a button, list items, headings in a row without boxes, and a description list."""
    rows = _dealt(_sixteens(spark, sf_dir))
    day = lambda f: F.date_format("closes", f)
    link, state = F.concat(F.lit("/calls?id="), F.col("uid")), F.when(F.col("uid") % 3 == 0, "EXPIRED ").when(F.col("uid") % 3 == 1, "Open: ").otherwise("")
    text = F.format_string
    record = (
        F.when(F.col("page_id") % 4 == 0, text('<div class="card %s"><h3>%s%s</h3><p>Deadline: <b>%s</b></p><div class="foot"><a class="btn" href="%s">Click to View Details</a></div></div>', F.when(F.col("uid") % 2 == 0, "even").otherwise("odd"), state, F.col("title"), day("d MMMM, yyyy"), link))
        .when(F.col("page_id") % 4 == 1, text('<li><span class="tag">Grants</span><a href=%s>%s</a><br><small>Closing date %s</small>', link, F.col("title"), day("yyyy-MM-dd")))
        .when(F.col("page_id") % 4 == 2, text('<h4>%s</h4><p>A fund for all.<p>Apply by %s</p><p><a href="%s">View full details</a>', F.col("title"), day("MMMM d, yyyy"), link))
        .otherwise(text('<dt>%s<dd>Deadline %s <a href="%s">More</a>', F.col("title"), day("d MMM yyyy"), link))
    )
    many = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", record.alias("html")))), lambda x: x["html"]), "\n")
    box = F.when(F.col("page_id") % 4 == 1, F.lit("<ul>%s</ul>")).when(F.col("page_id") % 4 == 3, F.lit("<dl>%s</dl>")).otherwise(F.lit('<div class="list">%s</div>'))
    shell = F.concat(F.lit('<html><body><nav><ul><li><a href="/">Start</a><li><a href="/news">News</a></ul></nav><main>'), box, F.lit('</main><footer><a href="/legal">Legal</a></footer></body></html>'))
    return rows.groupBy("page_id").agg(many.alias("records")).select("page_id", F.concat(F.lit("https://portal"), F.col("page_id"), F.lit(".example.org/list")).alias("url"), F.replace(shell, F.lit("%s"), F.col("records")).alias("html"))


@query(f"""WITH r AS (SELECT {_MONTH} AS page_id, o_orderkey AS uid, {_TITLE.format('o_orderkey', 'o_orderpriority')} AS title, CAST(o_orderdate AS DATE) + 30 AS deadline FROM orders)
 SELECT page_id, title, concat('https://portal', page_id, '.example.org/calls?id=', uid) AS link, deadline FROM r QUALIFY count(*) OVER (PARTITION BY page_id) > 1 AND min(deadline) OVER (PARTITION BY page_id) < max(deadline) OVER (PARTITION BY page_id)""")
def portal_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of listings in four layouts by one induction: menus, buttons, status words and template texts do not come through."""
    found = markup.cards(markup.records(portal_pages(spark, sf_dir)), YEAR)
    return found.select("page_id", "title", "link", "deadline")


def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of notices: two header rows, a cell a call over the rows of its lots, and a nested table that is no lot."""
    lots = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("lot"), F.concat(F.lit("<td>Lot "), F.col("l_linenumber"), F.lit("<td>"), F.date_format("l_shipdate", "d-MMM-yyyy"), F.lit("<td>"), F.col("l_returnflag")).alias("cells"))
    per = lots.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("lot", "cells"))).alias("lots"))
    rows = _dealt(_sixteens(spark, sf_dir).join(per, "uid"))
    first = F.concat(F.lit("<tr><td rowspan="), F.size("lots"), F.lit('><a href="/n/'), F.col("uid"), F.lit('">'), F.col("title"), F.lit("</a><table><tr><td>nested</table>"))
    body = F.concat(first, F.array_join(F.transform("lots", lambda x: x["cells"]), "<tr>"))
    many = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", body.alias("html")))), lambda x: x["html"]), "\n")
    head = "<table><thead><tr><th rowspan=2>Title<th colspan=2>Submission<th rowspan=2>Agency<tr><th>Reference<th>Deadline</thead><tbody>"
    return rows.groupBy("page_id").agg(many.alias("rows")).select("page_id", F.concat(F.lit("https://notices"), F.col("page_id"), F.lit(".example.org/")).alias("url"), F.concat(F.lit(head), F.col("rows"), F.lit("</table>")).alias("html"))


@query(f"""SELECT {_MONTH} AS page_id, {_TITLE.format('o_orderkey', 'o_orderpriority')} AS title, concat('https://notices', {_MONTH}, '.example.org/n/', o_orderkey) AS link, CAST(l_shipdate AS DATE) AS deadline, l_returnflag AS agency, concat('Lot ', l_linenumber) AS reference, CAST(NULL AS VARCHAR) AS country
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def notice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each lot of all notices, spans filled in, columns found by their header words."""
    return markup.notice_rows(markup.tables(notice_pages(spark, sf_dir))).drop("table", "row")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a supplier: customers as contacts, parts as documents and codes."""
    n = read(spark, sf_dir, "supplier").count()
    shell = lambda df, k: df.withColumn("page_id", F.col(k) % n)
    people = shell(read(spark, sf_dir, "customer"), "c_custkey").select("page_id", F.lit(0).alias("kind"), F.col("c_custkey").alias("id"), F.format_string('<div class="item"><div class="row"><span class="label">First name:</span><span>%s</span></div><div class="row"><span>Surname:</span><span>%s</span></div><div class="row"><span>Email:</span> <a href="mailto:x">c%d@example.org</a></div><div class="row"><span>Phone:</span><span>+%d</span></div></div>', "c_mktsegment", "c_name", "c_custkey", "c_custkey").alias("x"))
    parts = shell(read(spark, sf_dir, "part"), "p_partkey")
    files = parts.select("page_id", F.lit(1).alias("kind"), F.col("p_partkey").alias("id"), F.format_string('<li><a href="/files/%d.pdf?v=1">%s</a>', "p_partkey", "p_name").alias("x"))
    codes = parts.select("page_id", F.lit(2).alias("kind"), F.col("p_partkey").alias("id"), F.format_string("<div><span>%d</span><span>%s</span></div>", 10000000 + F.col("p_partkey"), "p_type").alias("x"))
    rows = people.unionByName(files).unionByName(codes)
    many = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "id", "x"))), lambda r: r["x"]), "\n")
    return rows.groupBy("page_id").agg(F.concat(F.lit("<body>"), many, F.lit("</body>")).alias("html")).withColumn("url", F.concat(F.lit("https://d.example.org/"), F.col("page_id")))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier)
 SELECT c_custkey % n AS page_id, 'contact' AS kind, concat(c_mktsegment, ' ', c_name) AS name, concat('c', c_custkey, '@example.org +', c_custkey) AS detail FROM customer, n
 UNION ALL SELECT p_partkey % n, 'document', p_name, concat('https://d.example.org/files/', p_partkey, '.pdf?v=1') FROM part, n
 UNION ALL SELECT p_partkey % n, 'code', p_type, CAST(10000000 + p_partkey AS VARCHAR) FROM part, n""")
def notice_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, documents and codes of notices, whole lists, as rows."""
    lists = markup.notice_lists(detail_pages(spark, sf_dir))
    entry = lambda kind, name, detail: lambda x: F.struct(F.lit(kind).alias("kind"), name(x).alias("name"), detail(x).alias("detail"))
    name = lambda x: x["name"]
    every = F.concat(F.transform("contacts", entry("contact", name, lambda x: F.concat_ws(" ", x["email"], x["phone"]))), F.transform("documents", entry("document", name, lambda x: x["url"])), F.transform("codes", entry("code", name, lambda x: x["code"])))
    return lists.select("page_id", F.inline(every))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without dates that link to their listing, a share button and customers' calendars, and those calendars, of which some lack a date."""
    u, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.when(u % 5 == 0, F.lit("<p>Deadline: 1 March 1998</p>")).otherwise("")
    calls = read(spark, sf_dir, "orders").select(
        u.alias("page_id"),
        F.format_string("https://fund%d.example.org/c/%d/", c % 7, u).alias("url"),
        F.concat(F.format_string('<h1>Grant</h1><a href="https://www.linkedin.com/share?u=/apply">Share</a><a href="/call-for-projects/">All</a><a href="/c/%d#top">Here</a><a href="https://forms.example.net/calendar/%d#x">Dates</a><a href="https://forms.example.net/apply/%d">Form</a>', u, c, c % 11), own).alias("html"),
    )
    days = read(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("page_id"), F.format_string("https://forms.example.net/calendar/%d", "c_custkey").alias("url"), F.when(F.col("c_custkey") % 3 > 0, F.format_string('<p>Closing date: %d June 1998</p><a href="/apply/99">Form</a>', F.col("c_custkey") % 28 + 1)).otherwise(F.lit("<p>Soon</p>")).alias("html"))
    forms = read(spark, sf_dir, "nation").where("n_nationkey < 11").select((-100000000 - F.col("n_nationkey")).cast("long").alias("page_id"), F.format_string("https://forms.example.net/apply/%d/", "n_nationkey").alias("url"), F.when(F.col("n_nationkey") % 2 == 0, F.format_string("<p>Deadline: %d July 1998</p>", F.col("n_nationkey") + 1)).otherwise(F.lit("<p>Form</p>")).alias("html"))
    return calls.unionByName(days).unionByName(forms)


@query("""WITH o AS (SELECT o_orderkey AS page_id, c_custkey AS c, CASE WHEN c_custkey % 3 > 0 THEN make_date(1998, 6, CAST(c_custkey % 28 + 1 AS INTEGER)) END AS day, CASE WHEN n_nationkey % 2 = 0 THEN make_date(1998, 7, CAST(n_nationkey + 1 AS INTEGER)) END AS form, n_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_custkey % 11 WHERE o_orderkey % 5 > 0)
 SELECT page_id, CASE WHEN day IS NOT NULL THEN concat('https://forms.example.net/calendar/', c, '#x') ELSE concat('https://forms.example.net/apply/', n) END AS link, coalesce(day, form) AS deadline FROM o WHERE day IS NOT NULL OR form IS NOT NULL""")
def companion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines of calls that have none, from the best companion that gives one; calendars' own links are not followed."""
    return companions.companion_deadlines(linked_pages(spark, sf_dir), YEAR).where("page_id > 0")


_PROSE = r"""regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>', ' ', 'g')"""
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PROSE = f"replace({_PROSE}, '{_a}', '{_b}')"
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_RANKED = f"""d AS (SELECT page_id, {_WORDS.format(_PROSE)} AS w FROM pages), p AS (SELECT page_id, len(w) AS size, unnest(w) AS term FROM d), i AS (SELECT term, page_id, any_value(size) AS size, count(*) AS tf FROM p GROUP BY 1, 2),
 s AS (SELECT count(*) AS n, avg(size) AS mean FROM (SELECT DISTINCT page_id, size FROM i)), f AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
 q AS (SELECT DISTINCT item_id AS query, unnest({_WORDS.format('text')}) AS term FROM benchmark),
 r AS (SELECT query, page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * size / mean))), 6) AS score FROM q JOIN i USING (term) JOIN f USING (term), s GROUP BY 1, 2),
 t AS (SELECT query, page_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, page_id) AS place FROM r QUALIFY place <= 10)"""


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", urls.strip_html(F.col("html")).alias("text"))
    path = scratch(spark, "postings")
    search.postings(docs, "page_id", "text").write.parquet(path)
    index, asked = spark.read.parquet(path), read(spark, sf_dir, "benchmark")
    n, mean = search.collection(index, "page_id")
    weights = search.weighed(index.join(search.asked_terms(asked, "text"), "term", "left_semi"), "page_id", n, mean)
    return search.top_k(asked, "item_id", "text", weights, "page_id", 10, search.parts(n)).withColumnRenamed("item_id", "query")


@query(f"WITH {_RANKED} SELECT query, page_id, score, place FROM t")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pages of each benchmark text by BM25 over the words of all whole pages."""
    return ranked_pages(spark, sf_dir).select("query", "page_id", "score", "place")


@query(rf"""WITH {_RANKED}, l AS (SELECT t.*, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/$', '') AS link, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM t JOIN pages USING (page_id)),
 b AS (SELECT link, arg_min(struct_pack(place := place, query := query, title := title), (place, query)) AS x FROM l WHERE lower(link) LIKE 'http%' GROUP BY link),
 k AS (SELECT regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '/+$', '') AS u FROM pages WHERE page_id % 7 = 0),
 h AS (SELECT link, x.title AS title, x.query AS query, x.place AS place, regexp_replace(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM b WHERE regexp_replace(lower(link), '/+$', '') NOT IN (SELECT u FROM k))
 SELECT link, title, query, place, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' THEN NULL ELSE array_to_string([upper(left(x, 1)) || substr(x, 2) for x in string_split(split_part(host, '.', 1), '-')], ' ') END AS funder, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'aggregator' ELSE 'primary' END AS class FROM h""")
def search_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New candidates from the answers to all benchmark texts: a row a link, without those known, republishers marked."""
    pages = read(spark, sf_dir, "pages")
    found = ranked_pages(spark, sf_dir).join(pages.select("page_id", F.col("url").alias("link"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title")), "page_id")
    return search.discovered(found, pages.where("page_id % 7 = 0").select(F.col("url").alias("link")), ["example.net"])
