"""Operators whose results the carriers do not show."""

import datetime
import random
import re
import subprocess
import sys
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from callweave.functions import text
from callweave.operators import aggregates, dedup, joins, matching, ranking, state
from callweave.plans import dedup as plans
from callweave.sources import html, landed, tables
from callweave.streaming import ingest, jobs

from .compare import SF


def test_similar_titles_equal_brute_force(spark):
    titles = ["clean water for east kenya schools", "clean water for east kenya school", "clean water for west kenya schools", "poetry grants for young writers", "poetry grant for young writers 2024", "malaria vaccine delivery research call", "malaria vaccines delivery research calls", "short"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {(r.id, r.other) for r in dedup.similar_titles(rows).collect()}
    assert got == {(i, j) for i in range(len(titles)) for j in range(i) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.9}


def similar(a, b, least):
    return bool(a) and bool(b) and SequenceMatcher(None, a, b).ratio() >= least


def test_titles_without_a_common_word_and_with_many_changes(spark):
    rnd = random.Random(3)
    titles = ["organisation", "organization", "sustainable agriculture", "sustainible agricultire", "abcd", "abce", "abcdefghij", "abcdefghijk", "abdcefghij", "aaaaaaaaaa", "aaaaaaaaaaa", "ab", "ab c"]
    for _ in range(150):
        base = list(rnd.choice(titles[:4]) + " " + "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 40))))
        for _ in range(rnd.randint(0, 4)):
            base[rnd.randrange(len(base))] = rnd.choice("xyz ab")
        titles.append("".join(base))
    titles = list(dict.fromkeys(titles))
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string").repartition(3)
    for least in (0.9, 0.75):
        got = {(r.id, r.other) for r in dedup.similar_titles(rows, least).collect()}
        assert got == {(i, j) for i in range(len(titles)) for j in range(i) if similar(titles[i], titles[j], least)}
        assert (1, 0) in got and (3, 2) in got


def test_page_titles_equal_plain_search(spark):
    titles = sorted((r.id, r.title) for r in plans.page_titles(spark, SF).collect())
    got = {(r.id, r.other): r.ratio for r in plans.dedup_rule_3_ratio(spark, SF).collect()}
    want = {(i, j): round(x, 6) for n, (i, t) in enumerate(titles) for j, u in titles[:n] if (x := SequenceMatcher(None, t, u).ratio()) >= 0.9}
    assert got == want


def greedy(ranks, pairs):
    near = {frozenset(p) for p in pairs}
    heads, lead = [], {}
    for _, i in sorted((r, i) for i, r in ranks):
        lead[i] = next((h for h in heads if frozenset((h, i)) in near), i)
        if lead[i] == i:
            heads.append(i)
    return lead


def test_leaders_are_greedy_not_components(spark):
    """2 ~ 1 and 3 ~ 2, but 3 is not like 1: 2 joins 1, and 3 leads itself. 5 joins leader 4, though it is linked to 2."""
    rnd = random.Random(7)
    cases = [([(1, 1), (2, 2), (3, 3), (9, 4)], [(2, 1), (3, 2)]), ([(i, i) for i in range(1, 6)], [(5, 2), (5, 4), (2, 1)]), ([(i, 0) for i in range(30)], [(i, i + 1) for i in range(29)])]
    cases.append(([(i, rnd.randint(0, 9)) for i in range(60)], list({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(140)})))
    for ranks, pairs in cases:
        got = dedup.leaders(spark.createDataFrame(ranks, "id long, rank long"), spark.createDataFrame(pairs, "id long, other long"))
        assert {r.id: r.lead for r in got.collect()} == greedy(ranks, pairs)


DUP = "id long, oid string, link string, title string, funder string, deadline date, value long, countries array<string>"


def rules(a, b):
    """The first rule by which b, an earlier row, is the same call as a; plainly, pair by pair."""
    if a["oid"] and a["oid"] == b["oid"]:
        return "1 id"
    if a["link"] and a["link"] == b["link"]:
        return None if a["oid"] and b["oid"] else "2 link"  # two ids under one link part rows under every later rule
    if a["countries"] and b["countries"] and not set(a["countries"]) & set(b["countries"]):
        return None
    if similar(a["title"], b["title"], 0.9):
        return "3 title"
    if a["funder"] and b["funder"] and a["deadline"] and a["deadline"] == b["deadline"] and same_funder(a["funder"], b["funder"]):
        words = [{w for w in x["title"].split() if len(w) >= 3 and w not in text.GENERIC and not re.fullmatch(r"[0-9]{4}", w)} for x in (a, b)]
        if similar(a["title"], b["title"], 0.75) or len(words[0] & words[1]) >= 3:
            return "4 deadline"
        if a["value"] is not None and a["value"] == b["value"]:
            return "5 value"
    return None


def same_funder(a, b):
    after = [x.split(" - ", 1)[1] if " - " in x else x for x in (a, b)]
    x, y = (" ".join(re.sub("[^a-z0-9]+", " ", n.lower()).split()) for n in after)
    if x == y or (len(x) >= 5 and len(y) >= 5 and (x in y or y in x)):
        return True
    initials = ["".join(w[0].upper() for w in re.findall(r"[A-Za-z][A-Za-z'&-]*", n) if w.lower() not in text.SMALL_WORDS) for n in after]
    letters = [re.sub("[^A-Za-z]", "", n).upper() for n in (a, b)]
    return any(2 <= len(p) <= 6 and p == q for p, q in ((letters[0], initials[1]), (letters[1], initials[0])))


def first_rules(rows):
    out = {}
    for a in rows:
        # a link's ids that differ settle a pair, whatever the later rules say
        found = [(rule, b["id"]) for b in rows if b["id"] < a["id"] and (rule := rules(a, b))]
        if found:
            out[a["id"]] = min(found)[::-1]
    return out


def test_rules_and_country_veto(spark):
    day = datetime.date(2026, 8, 1)
    one = "modern slavery fund albania programme"
    rows = [
        (1, "A1", "x/1", "", "f", day, 5, []), (2, "A1", "", "", "g", None, None, ["kenya"]), (3, "B2", "x/1", "", "h", None, None, []),
        (4, "", "x/1", "", "h", None, None, []), (5, "", "", "", "f", day, 5, ["mali"]), (6, "C", "", "", "f", day, 5, ["kenya"]), (7, "A1", "", "", "q", None, None, ["mali"]),
        (10, "", "", one, "k", None, None, ["albania"]), (11, "", "", one.replace("albania", "algeria"), "k", None, None, ["algeria"]), (12, "", "", one + "s", "k", None, None, []),
        (20, "", "", "ninth african malaria drug discovery", "Medicines for Malaria Venture", day, None, []), (21, "", "", "malaria drug discovery african round", "MMV", day, None, []),
        (22, "", "", "grand cost innovations", "MMV", day, None, []), (23, "", "", "other thing entirely", "MMV - Medicines for Malaria Venture", day, 9, []), (24, "", "", "unlike it", "MMV", day, 9, []),
    ]
    got = {r.id: (r.lead, r.rule) for r in dedup.find_duplicates(spark.createDataFrame(rows, DUP)).collect()}
    assert got == {2: (1, "1 id"), 4: (1, "2 link"), 5: (1, "5 value"), 6: (1, "5 value"), 7: (1, "1 id"), 12: (10, "3 title"), 21: (20, "4 deadline"), 24: (23, "5 value")}


def test_the_whole_chain_equals_plain_search(spark):
    rows = plans.titled_calls(spark, SF.replace("sf0.01", "sf0.001")).where("id < 1500")
    plain = [r.asDict() for r in rows.collect()]
    got = {r.id: (r.lead, r.rule) for r in dedup.find_duplicates(rows).collect()}
    assert len(plain) > 100 and got == first_rules(plain) and {x[1] for x in got.values()} >= {"2 link", "3 title"}


def test_a_vetoed_link_leader_hides_no_other(spark):
    rows = [(1, "X", "l", "", "a", None, None, []), (2, "", "l", "", "b", None, None, []), (3, "Y", "l", "", "c", None, None, []), (4, "Z", "l", "", "d", None, None, ["mali"]), (5, "Y", "m", "", "e", None, None, ["mali"])]
    got = {r.id: (r.lead, r.rule) for r in dedup.find_duplicates(spark.createDataFrame(rows, DUP)).collect()}
    assert got == {2: (1, "2 link"), 3: (2, "2 link"), 4: (2, "2 link"), 5: (3, "1 id")}


def test_two_ids_under_one_link_are_two_calls_under_every_rule(spark):
    day = datetime.date(2026, 1, 5)
    same = ("one title of a call for water", "Fund", day, 7, [])
    rows = [(1, "X", "l", *same), (2, "Y", "l", *same), (3, "Y", "m", *same), (4, "Z", "l", *same), (5, "", "k", *same), (6, "W", "l", *same), (7, "V", "n", "water calls of one title", "Fund", day, 7, []), (8, "U", "n", "water calls of one title", "Fund", day, 7, [])]
    got = {r.id: (r.lead, r.rule) for r in dedup.find_duplicates(spark.createDataFrame(rows, DUP)).collect()}
    plain = first_rules([dict(zip(("id", "oid", "link", "title", "funder", "deadline", "value", "countries"), r)) for r in rows])
    assert got == plain and 2 not in got and got[3] == (2, "1 id") and got[4] == (3, "3 title")
    assert {r.id for r in dedup.find_duplicates(spark.createDataFrame(rows[:2], DUP)).collect()} == set()


def random_calls(seed, n):
    rnd = random.Random(seed)
    titles = ["clean water for east kenya schools", "clean water for east kenya school", "clean water for west kenya schools", "poetry grants for young writers", "poetry grant for young writers 2024", "malaria vaccine delivery research call", ""]
    days = [None, datetime.date(2026, 1, 5), datetime.date(2026, 1, 6)]
    return [(i, rnd.choice(["", "", "A", "B", "C"]), rnd.choice(["", "", "l", "m"]), rnd.choice(titles), rnd.choice([None, "Global Science and Health Fund", "GSHF", "Other Fund"]), rnd.choice(days), rnd.choice([None, 5, 6]), rnd.choice([[], [], ["kenya"], ["mali"]])) for i in range(n)]


def plain_kept(rows, known=()):
    """One row after the other against the rows kept so far."""
    names = ("id", "oid", "link", "title", "funder", "deadline", "value", "countries")
    kept, out = [dict(zip(names, r)) for r in known], {}
    for a in (dict(zip(names, r)) for r in rows):
        found = sorted((rule, b["id"]) for b in kept if (rule := rules(a, b)))
        out[a["id"]] = (found[0][1], found[0][0]) if found else (None, None)
        if not found:
            kept.append(a)
    return out


def test_kept_rows_are_judged_against_kept_rows_only(spark):
    rows = random_calls(0, 60)
    got = dedup.kept_and_dropped(spark.createDataFrame(rows, DUP), spark.createDataFrame([], DUP))
    assert {r.id: (r.lead, r.rule) for r in got.collect()} == plain_kept(rows)


def test_batches_end_in_the_rows_of_one_run_and_replays_change_nothing(spark, tmp_path):
    rows = random_calls(5, 45)
    want = plain_kept(rows)
    for k in range(3):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], DUP).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    ingest.run(jobs.landed(spark, str(tmp_path / "in"), ingest.CALL, per_trigger=1), folder, str(tmp_path / "state"))
    read = lambda: {r.id: (r.lead, r.rule) for r in ingest.stored_rows(spark, folder, ingest.CALL).collect()}
    assert read() == want
    ingest.take_in(spark.createDataFrame(rows[15:30], DUP), 1, folder)  # the batch is run again
    ingest.take_in(spark.createDataFrame(rows[:15] + rows[40:], DUP), 3, folder)  # rows that are stored land again
    assert read() == want
    filled = ingest.catalogue(ingest.stored_rows(spark, folder, ingest.CALL), {"deadline": "deadline is null"})
    assert filled.count() == sum(v[0] is None for v in want.values())


def test_tombstones_suppress_what_is_like_them(spark, tmp_path):
    dead = spark.createDataFrame([(900, "A", "", "", None, None, None, [])], DUP)
    rows = [(1, "", "", "clean water for east kenya schools", None, None, None, []), (2, "A", "", "clean water for east kenya school", None, None, None, []), (3, "A", "", "something else", None, None, None, [])]
    ingest.take_in(spark.createDataFrame(rows[:1], DUP), 0, str(tmp_path), tombstones=dead)
    ingest.take_in(spark.createDataFrame(rows[1:], DUP), 1, str(tmp_path), tombstones=dead)
    got = {r.id: (r.verdict, r.lead, r.rule) for r in ingest.stored_rows(spark, str(tmp_path), ingest.CALL).collect()}
    assert got == {1: ("inserted", None, None), 2: ("duplicate", 1, "3 title"), 3: ("suppressed", 900, "seen 1 id")}


def test_gap_fill(spark):
    schema = "id long, title string, amount long"
    old = spark.createDataFrame([(1, "a", None), (2, " ", 5), (3, "c", 7)], schema)
    new = spark.createDataFrame([(1, "z", 9), (2, "b", 5), (4, "d", 1)], schema)
    got = {r.id: (r.title, r.amount, r.conflicts) for r in joins.gap_fill(old, new, "id", ["title", "amount"], frozen=["title"]).collect()}
    assert got == {1: ("a", 9, "title"), 2: (" ", 5, ""), 3: ("c", 7, ""), 4: ("d", 1, "")}


def test_chain_rejects_cycles(spark):
    tables.ensure_checkpoints(spark)
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "c long, p long")
    assert {tuple(r) for r in joins.chain(edges, "c", "p").collect()} == {(i, j, i - j) for i in range(2, 6) for j in range(1, i)}
    for loop in ([(10, 11), (11, 10)], [(7, 7)], [(1, 2), (2, 3), (3, 1), (4, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            joins.chain(spark.createDataFrame(loop, "c long, p long"), "c", "p")


def test_buckets_without_rows(spark):
    none = spark.createDataFrame([], "d date")
    assert aggregates.bucketed(none, "d", "week").count() == 0
    rows = spark.createDataFrame([(datetime.date(2024, 1, 31),), (datetime.date(2024, 4, 1),), (None,)], "d date")
    assert [tuple(r) for r in aggregates.bucketed(rows, "d", "month").orderBy("bucket").collect()] == [(datetime.date(2024, m, 1), n) for m, n in ((1, 1), (2, 0), (3, 0), (4, 1))]


def test_backfill_relaxes_the_cap(spark):
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b", 10 - i) for i in range(6)], "id long, f string, s int")
    got = [r.id for r in ranking.capped_top(rows, "f", [F.desc("s")], 2, 4).orderBy("place").collect()]
    assert got == [0, 1, 5, 2]


def test_dense_ids(spark):
    rows = spark.range(500).withColumn("k", F.xxhash64("id")).repartition(7)
    got = ranking.dense_ids(rows, ["k"], "n").orderBy("k").select("n").collect()
    assert [r.n for r in got] == list(range(1, 501))


def test_job_moves(spark):
    rows = spark.createDataFrame([("queued", "dispatched"), ("queued", "done"), ("done", "queued"), ("failed", "queued"), (None, "done")], "a string, b string")
    assert [r.x for r in rows.select(state.may_move(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, True, False]


def test_topk_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, v array<double>").repartition(3)
    whole = {tuple(r)[:2] for r in matching.cosine_topk(rows, rows.where("id < 9"), "id", "v", 4).collect()}
    monkeypatch.setattr(matching, "QUERY_BLOCK", 3)
    assert {tuple(r)[:2] for r in matching.cosine_topk(rows, rows.where("id < 9"), "id", "v", 4).collect()} == whole and len(whole) == 36


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    old.write.parquet(f"{tmp_path}/one")
    new = tables.upsert_parquet(spark, spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string"), f"{tmp_path}/one", ["id"], f"{tmp_path}/two")
    assert {tuple(r) for r in new.collect()} == {(1, "a"), (2, "B"), (3, "c")}
    nested = old.select(F.col("id").alias("The ID"), F.array("v", F.lit('q"')).alias("some-list"))
    tables.export_csv(nested, f"{tmp_path}/csv")
    back = tables.import_csv(spark, f"{tmp_path}/csv")
    assert back.columns == ["the_id", "some_list"] and {r.some_list for r in back.collect()} == {'["a","q\\""]', '["b","q\\""]'}
    stamped = old.withColumn("at", F.lit("2024-01-02").cast("timestamp"))
    assert tables.backup(stamped, ["at"], "2024-01-03", f"{tmp_path}/none") == 0
    assert tables.backup(stamped, ["at"], "2024-01-01", f"{tmp_path}/some") == 2 and spark.read.parquet(f"{tmp_path}/some").count() == 2


def test_landed_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://a</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>B</title></item></channel></rss>")
    rows = {r.title: r for r in html.rss(spark, f"{tmp_path}/f.xml").collect()}
    assert set(rows) == {"A", "B"} and rows["A"].published is not None and rows["B"].link is None
    (tmp_path / "r.json").write_text('{"releases": [{"ocid": "o1", "tender": {"title": "T", "value": {"amount": 5, "currency": "USD"}, "tenderPeriod": {"endDate": "2024-05-06T00:00:00Z"}}}, {"ocid": "o2"}]}')
    got = {r.ocid: (r.title, r.amount, r.deadline) for r in html.releases(spark, f"{tmp_path}/r.json").collect()}
    assert got == {"o1": ("T", 5.0, datetime.date(2024, 5, 6)), "o2": (None, None, None)}


def test_upserting_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema, source = "id long, at long, v string", f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).write.parquet(source)
    run = lambda: jobs.upsert_batches(jobs.landed(spark, source, schema), f"{tmp_path}/out", f"{tmp_path}/state", ["id"], ["at"])
    run()
    spark.createDataFrame([(2, 5, "d")], schema).write.mode("append").parquet(source)
    run()
    assert {tuple(r) for r in jobs.current(spark, f"{tmp_path}/out", ["id"], ["at"]).select("id", "v").collect()} == {(1, "b"), (2, "d")}


def test_landed_payloads(spark, tmp_path):
    item = "<item><title>&lt;b&gt;A&lt;/b&gt; call</title><link>https://www.google.com/url?rct=j&amp;url={}&amp;ct=ga</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>"
    (tmp_path / "a.xml").write_text("<rss><channel>" + item.format("https%3A%2F%2Fwww.fund.org%2Fcall") + item.format("https%3A%2F%2Fm.youtube.com%2Fx") + "</channel></rss>")
    got = landed.alerts(spark, f"{tmp_path}/a.xml").collect()
    assert [(r.title, r.link, r.funder, r.posted) for r in got] == [("A call", "https://www.fund.org/call", "Fund", datetime.date(2024, 1, 1))]
    (tmp_path / "t.json").write_text('{"notices": [{"publication-number": "1-2024", "notice-title": {"fra": "Eau", "eng": "Water"}, "buyer-name": {"fra": ["Ville"]}, "deadline-receipt-tender-date-lot": ["2024-05-06+02:00", "2024-07-08"], "publication-date": "2024-04-01Z"}, {"publication-number": "2"}]}')
    got = {r.opportunity_id: (r.title, r.funder, r.deadline, r.posted) for r in landed.tenders(spark, f"{tmp_path}/t.json").collect()}
    assert got == {"1-2024": ("Water", "Ville", datetime.date(2024, 7, 8), datetime.date(2024, 4, 1)), "2": (None, None, None, None)}
    rows = landed.dispatched(spark, [("alerts", f"{tmp_path}/a.xml"), ("tenders", f"{tmp_path}/t.json")])
    assert rows.columns == list(landed.COLUMNS) and rows.count() == 3
    with pytest.raises(ValueError, match="no parser for magic"):
        landed.dispatched(spark, [("magic", "x")])


def test_pages_that_are_calls(spark):
    pages = spark.createDataFrame([("http://a", "<title>T</title><h1>Water</h1><p>Call for proposals. Deadline: 1 May.</p>"), ("http://b", "<h1>News</h1><p>Call for proposals</p>"), ("http://c", None)], "url string, html string")
    assert [(r.title, r.link) for r in landed.self_candidates(pages).collect()] == [("T", "http://a")]


def test_entry_survives_a_broken_subpackage(tmp_path):
    """Whatever import of the training-data folder fails, the other queries stay."""
    code = "import sys; sys.modules['callweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert 'funnel_by_source' in n and 'pipeline' not in n and not any(k.startswith('op1_') for k in n); print(len(n))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1])
    assert out.returncode == 0 and int(out.stdout) > 150
