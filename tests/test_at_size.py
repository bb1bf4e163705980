"""What showed on larger tables only: each case on a few rows made for it, against the query's SQL."""

import datetime
import difflib
import itertools
import random
from html.parser import HTMLParser

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from callweave import registry
from callweave.functions import deadlines, places
from callweave.operators import dedup, joins, matching, search
from callweave.sources import companions, html, markup
from callweave.streaming import ledger

from .compare import SF, difference
from .test_operators import DUP, first_rules, random_calls


@pytest.fixture
def made(spark, tmp_path):
    """Writes the given frames as tables of a folder; the other tables are those of the tests."""

    def write(**frames):
        con = duckdb.connect()
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def test_money_extract_rounds_ties_as_its_sql(spark, made):
    orders = spark.createDataFrame([(19100, 77195.0), (66405, 128605.0), (10, 129200.0), (7, 1234.5)], "o_orderkey long, o_totalprice double")
    folder, con = made(orders=orders)
    sql = registry.oracle_sql()["money_extract"]
    assert sorted(map(tuple, registry.queries()["money_extract"](spark, folder).collect())) == sorted(con.sql(sql).fetchall())


def test_federal_grants_keep_ceilings_below_a_dollar(spark, made):
    supplier = spark.createDataFrame([(1, "A", 3, 0.5), (2, "B", 4, -0.5), (3, "C", 5, 0.0), (4, "D", 6, 9999.99), (5, "E", 7, None)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    folder, con = made(supplier=supplier)
    assert difference(registry.queries()["federal_grants_scan"](spark, folder), registry.oracle_sql()["federal_grants_scan"], con) == ""


def test_rule_4_meets_titles_once_however_many_rows_days_and_places(spark):
    rows = [(60 * d + i, "", "", f"soil study for region {i % 3}", "Fund", datetime.date(2026, 1, 1 + d), None, [f"land {i}"]) for d in range(20) for i in range(60)]
    df = spark.createDataFrame(rows, DUP)
    funders = dedup.funder_pairs(df.select("funder"))
    assert dedup.deadline_pairs(df, df, funders).count() == 9


def test_rules_with_several_places_and_marks(spark):
    rnd, rows = random.Random(3), []
    for i, r in enumerate(random_calls(11, 120)):
        rows.append((*r[:2], rnd.choice(["", "l", "m", "n"]), *r[3:7], rnd.sample(["kenya", "mali", "peru"], rnd.choice([0, 1, 2]))))
    names = ("id", "oid", "link", "title", "funder", "deadline", "value", "countries")
    got = {r.id: (r.lead, r.rule) for r in dedup.find_duplicates(spark.createDataFrame(rows, DUP)).collect()}
    assert got == first_rules([dict(zip(names, r)) for r in rows])


def test_geo_gate_is_spread_and_its_pattern_branches(spark):
    """A small file is no single task, and names are sought by common beginnings: longest first, as before."""
    rows = registry.queries()["geo_gate"](spark, SF)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert places._pattern(["guinea", "guinea bissau", "guyana"]).count("gu") == 1
    got = spark.createDataFrame([("Guinea  Bissau, guineas, GUYANA guinea",)], "t string").select(F.regexp_extract_all("t", F.lit(places._pattern(["guinea", "guinea bissau", "guyana"])), F.lit(0)).alias("x")).first().x
    assert got == ["Guinea  Bissau", "GUYANA", "guinea"]


def test_topk_holds_some_cosines_at_a_time(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, v array<double>").repartition(3)
    whole = {tuple(r)[:2] for r in matching.cosine_topk(rows, rows.where("id < 9"), "id", "v", 4).collect()}
    monkeypatch.setattr(matching, "CELLS", 40)  # less than two queries' cosines with a batch
    assert {tuple(r)[:2] for r in matching.cosine_topk(rows, rows.where("id < 9"), "id", "v", 4).collect()} == whole and len(whole) == 36


def syllables(n: int) -> list[str]:
    """Titles of frequent syllables, which share most of their runs; every tenth is the one before with a letter changed."""
    rnd, out = random.Random(5), []
    while len(out) < n:
        out.append(" ".join("".join(rnd.choices(("the", "er", "on", "in", "tion", "ed", "an", "th", "wh", "ou", "ly", "re", "es", "ha", "at", "ble", "or", "of", "st", "ing"), k=2)) for _ in range(9)))
        if len(out) % 10 == 9:
            out.append(f"{out[-1][:20]}z{out[-1][21:]}")
    return out[:n]


def test_few_pairs_of_like_titles_reach_the_ratio(spark, monkeypatch):
    titles = syllables(300)
    cell = pd.DataFrame({"n": [len(t) for t in titles], "new": True, "side": -1, "map": [dedup._marks(t) for t in titles]})
    found = {(int(a), int(b)) for a, b in zip(*dedup._near(cell, 0.9), strict=True)}
    ratio = lambda a, b: difflib.SequenceMatcher(None, titles[b], titles[a]).ratio()
    brute = {(a, b): ratio(a, b) for a, b in itertools.combinations(range(300), 2)}
    want = {k for k, r in brute.items() if r >= 0.9}
    assert want <= found and 30 <= len(want) and len(found) < 10 * len(want)
    monkeypatch.setattr(dedup, "BLOCK", 70)  # several blocks, and known titles that never meet each other
    rows = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(titles)], "id long, title string, new boolean")
    assert {(r.other, r.id) for r in dedup.similar_titles(rows).collect()} == want
    assert {(r.other, r.id) for r in dedup.similar_titles(rows, new="new").collect()} == {(a, b) for a, b in want if a % 3 == 0 or b % 3 == 0}


def test_leaders_read_the_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    chain = [(i, i + 1) for i in range(6)]
    pairs = spark.createDataFrame(chain, "id long, other long").mapInPandas(count, "id long, other long")
    got = dedup.leaders(spark.createDataFrame([(i, i) for i in range(8)], "id long, rank long"), pairs)
    assert {(r.id, r.lead) for r in got.collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (7, 7)}
    assert read.value == len(chain)


def test_plain_tags_are_read_as_the_parser_reads_them(monkeypatch):
    class Slow(markup._Tree):
        parse_starttag = HTMLParser.parse_starttag

    def shape(node):
        return (node.tag, node.attrs, [k if isinstance(k, str) else shape(k) for k in node.kids])

    odd = ["<TD>a<Td >b<td\n>c", "<p><b>x</p></b>", "<script>if (a<b>c) {}</script><p>y", "<title><b>t</title>", "<textarea><td></textarea>", "<br><br/><x1>z<a-b>w", "a<", "<td", "<1>", "<style><p></style>&amp;<i>é</i>", "<iframe><p>q</iframe>"]
    for html in odd:
        slow = Slow()
        slow.feed(html)
        slow.close()
        assert shape(markup.tree(html)) == shape(slow.root), html
    monkeypatch.delattr(HTMLParser, "parse_starttag")  # plain tags do without it
    assert [n.tag for n in markup.walk([markup.tree("<p><b>x<td>y")]) if not isinstance(n, str)] == ["", "p", "b", "td"]


def test_chain_is_doubled_from_the_farthest_ancestors_only(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 12)] + [(11, 3), (3, 0)], "child long, parent long")
    got = {(r.node, r.ancestor): r.hops for r in joins.chain(edges, "child", "parent").collect()}
    want, up = {}, {i: {i - 1} for i in range(1, 12)}
    up[11].add(3)
    up[3].add(0)
    for node in up:
        at, hops = {node}, 0
        while at := {p for x in at for p in up.get(x, ())}:
            hops += 1
            for p in at:
                want.setdefault((node, p), hops)
    assert got == want


def test_criteria_say_nothing_twice_and_are_spread(spark):
    """What a factor reads is a column of its own: as one expression, years of experience were read some hundred times a row."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = registry.queries()["criteria_verdict"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract") < 10 and "Repartition" in plan


def test_ledger_asks_the_store_only_for_what_changes():
    """A row whose timer stays costs one read and one write; before, timers were listed, deleted and set again each time."""
    class Store:
        held, timers, calls = None, set(), 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def registerTimer(self, at):
            self.timers, self.calls = self.timers | {at}, self.calls + 1

        def deleteTimer(self, at):
            self.timers, self.calls = self.timers - {at}, self.calls + 1

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    store, day = Store(), ledger._DAY
    call = ledger.CallLedger(6)
    call.init(store)
    seen = lambda ms, deadline=None, kind="seen": list(call.handleInputRows((1,), iter([Row(ms=ms, event_id=ms, kind=kind, deadline=deadline, posted=None, rolling=None)]), Now()))
    seen(day)
    assert store.timers == {7 * day} and store.calls == 1
    seen(day // 2)  # late: the timer stays
    assert store.calls == 1
    seen(2 * day)
    assert store.timers == {8 * day} and store.calls == 3
    seen(3 * day, kind="tombstone")
    assert not store.timers and store.calls == 4


def test_companions_read_each_page_once(spark):
    read = spark.sparkContext.accumulator(0)

    def page(k):
        read.add(1)
        return f'<a href="https://cal.example.net/calendar/{k}">c</a>' if k % 2 else "<p>Deadline: 2 June 2026</p>"

    rows = spark.range(40).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 1, F.format_string("http://f.org/%d", "id")).otherwise(F.format_string("https://cal.example.net/calendar/%d", F.col("id") + 1)).alias("url"), F.udf(page, "string").asNondeterministic()("id").alias("html"))
    got = {r.page_id: str(r.deadline) for r in companions.companion_deadlines(rows, 2026).collect()}
    assert got == {k: "2026-06-02" for k in range(1, 40, 2)} and read.value == 40


def test_anchors_join_plain_addresses_as_urljoin_does():
    from urllib.parse import urljoin

    for base in ("http://a.org/x/y?q", "https://a.org", "//a.org/b", "", "a/b", "HTTP://A.org/x"):
        for target in ("/p", "/p/../q", "/p?", "/p#", "/p;a?b#c", "//b.org/x", "https://b.org", "http://b.org?", "http://b.org/./x?y#z", "https://b.org/a b", "HTTPS://b.org/x", "x/y", "?q", "/\u00e9", "https://b.org/x?u=/.."):
            assert [x for _, x in html.anchors_of(base, f'<a href="{target}">t</a>')] == [urljoin(base, target)]


def test_dates_are_cut_out_with_what_stands_before_them(spark):
    texts = ["no date " * 20 + "1234 Deadline: 5 May 2026", "\U0001f600" * 90 + " 5 May 2026 and 6.7.2026x, closes" + "y" * 65 + " 2026-07-08", "x5 May 2026"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", F.size(deadlines.dated(F.col("t"))), deadlines.deadline(F.col("t"), 2026)["deadline"].cast("string"), F.transform(deadlines.dated(F.col("t")), lambda x: F.length(x["evidence"]))).orderBy("k").collect()
    assert [(r[1], r[2], r[3]) for r in rows] == [(1, "2026-05-05", [80]), (2, "2026-07-08", [80, 80]), (1, "2026-05-05", [11])]


def test_postings_of_dealt_documents_are_not_dealt_again(spark):
    rows = [(1, "b a b"), (2, None), (3, " .,"), (1, "c a"), (4, "Z")]
    docs = spark.createDataFrame(rows, "k long, t string").repartition(3, "k")
    index = search.postings(docs, "k", "t")
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the one above
    assert sorted(map(tuple, index.collect())) == [("a", 1, 2, 5), ("b", 1, 2, 5), ("c", 1, 1, 5), ("z", 4, 1, 1)]


def test_top_k_over_many_cells_equals_a_plain_search(spark, monkeypatch):
    from .test_pages import plain_top

    monkeypatch.setattr(search, "QUERIES", 3)
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["hot", "hot", *(f"w{j}" for j in range(25))]) for _ in range(n))
    docs = [(f"d{i}", text(rng.randrange(0, 30))) for i in range(150)] + [(f"copy{i}", "hot w1 w2") for i in range(60)]
    asked = [(q, text(4)) for q in range(10)] + [(50, "hot"), (51, "w1 w2")]
    index = search.postings(spark.createDataFrame(docs, "k string, body string"), "k", "body").cache()
    frame = spark.createDataFrame(asked, "q int, t string")
    weights = search.weighed(index.join(search.asked_terms(frame, "t"), "term", "left_semi"), "k", *search.collection(index, "k"))
    expected = {q: v for q, v in plain_top(docs, asked, 7).items() if v}
    for salts in (1, 40):
        got = {}
        for r in search.top_k(frame, "q", "t", weights, "k", 7, salts).orderBy("q", "place").collect():
            got.setdefault(r.q, []).append((r.score, r.k))
        assert {q: [d for _, d in x] for q, x in got.items()} == {q: [d for _, d in x] for q, x in expected.items()}


def test_cells_keep_their_size_and_hand_on_few_rows():
    assert search.parts(100) == 16 and search.parts(1_000_000) * search.DOCS >= 1_000_000
    found = pd.DataFrame({"term": ["hot"] * 1000 + ["w"], "key": [*range(1000, 0, -1), 5], "weight": [0.5] * 1000 + [1e-7]})
    best = search._best(pd.DataFrame({"query": [1, 1, 2, 3], "term": ["hot", "w", "hot", "none"]}), found, 4)
    assert {q: sorted(x["key"]) for q, x in best.groupby("query")} == {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4]}
    assert not len(search._best(pd.DataFrame({"query": [1], "term": ["hot"]}), found[:0], 4))
