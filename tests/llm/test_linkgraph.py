import numpy as np

from callweave.llm import linkgraph
from callweave.llm.linkgraph import Rule


def rank(edges, seeds, rounds=linkgraph.ROUNDS, damping=linkgraph.DAMPING):
    total, mass = {}, dict(seeds)
    for (a, _), n in edges.items():
        total[a] = total.get(a, 0) + n
    for _ in range(rounds):
        new = {h: (1 - damping) * s for h, s in seeds.items()}
        for (a, b), n in edges.items():
            if a in mass:
                new[b] = new.get(b, 0) + damping * mass[a] * n / total[a]
        mass = new
    return mass


def test_rank_equals_plain_iteration(spark):
    rng = np.random.default_rng(2)
    edges = {(f"h{a}", f"h{b}"): int(n) for a, b, n in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40), strict=True) if a != b}
    seeds = {"h0": 0.75, "h3": 0.25}
    got = linkgraph.personalised_rank(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed double"))
    wanted = rank(edges, seeds)
    assert {r.host for r in got.collect()} == set(wanted)
    assert all(abs(r.mass - wanted[r.host]) < 1e-12 for r in got.collect())


RULES = (Rule("block", "bad.org", "/"), Rule("allow", "good.org", "/"), Rule("block", "mixed.org", "/x/"))


def page(i, url, *links):
    return (i, url, "".join(f'<a class=k href="{x}">t</a>' for x in links))


def test_verdicts_follow_links(spark):
    rows = [
        page(1, "http://bad.org/"), page(2, "HTTP://WWW.Good.org/p?q#f", "http://friend.org/a"), page(3, "http://friend.org/a/b"),
        page(4, "http://spam.net/1", "http://bad.org/x", "http://bad.org/y"), page(5, "http://other.net/1", "http://friend.org"),
        page(6, "http://mixed.org/x/1"), page(7, "http://mixed.org/y"), page(8, "http://mixed.org/z"), page(9, None), page(10, "no scheme"), page(11, "http://notbad.org/x"), (12, "http://sub.bad.org", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge_urls(pages, RULES).collect()}
    assert got[1] == ("bad.org", "/", "bad.org/", "block") and got[2] == ("www.good.org", "/p", "good.org/", "allow")
    assert got[3] == ("friend.org", "/a/b", None, "allow")
    assert got[4] == ("spam.net", "/1", None, "block")  # it links to a blocked host
    assert got[5][3] == "allow" and got[6][3] == "block"
    assert got[7][3] == got[8][3] == "allow"  # a blocked path does not taint its host
    assert got[9] == ("", "", None, "allow") == got[10]
    assert got[11][3] == "allow" and got[12][:3] == ("sub.bad.org", "", None)


def test_longest_rule_wins(spark):
    rows = [(1, "http://a.example.net/en/1", ""), (2, "http://a.example.net/fr/1", ""), (3, "http://example.com/de/", ""), (4, "http://x.org/fr/1?u=://net/", ""), (5, "http://x.net", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in linkgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("example.net/en/", "allow") and got[2] == ("net/", "block") and got[3] == ("example.com/de/", "block") and got[4] == ("org/fr/", "allow")
    assert got[5][0] is None


def test_edge_cases(spark):
    schema = "page_id long, url string, html string, host string, mass double, hit string"
    assert linkgraph.judge_urls(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "http://a.org/", "<a href='http://b.org/'>" * 5, "h", 1.0, "x")] * 2
    assert linkgraph.judge_urls(spark.createDataFrame(rows, schema)).count() == 2


def test_settled_ranks_equal_a_long_iteration(spark):
    rng = np.random.default_rng(3)
    edges = {(f"h{a}", f"h{b}"): int(n) for a, b, n in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40), strict=True) if a != b}
    seeds = {"h0": 0.75, "h3": 0.25}
    frames = spark.createDataFrame([("w", a, b, n) for (a, b), n in edges.items()], "walk string, src string, dst string, n long"), spark.createDataFrame([("w", *x) for x in seeds.items()], "walk string, host string, seed double")
    got, wanted = {r.host: r.mass for r in linkgraph.settled_ranks(*frames).collect()}, rank(edges, seeds, rounds=300)
    assert set(got) == set(wanted) and sum(abs(got[h] - wanted[h]) for h in got) < 2 * linkgraph.TOLERANCE


def test_copies_of_the_graph_leave_verdicts_unchanged(spark):
    """Each copy: twelve hosts in a row lead to a blocked one, and one of 50 hosts that link to it."""
    rules = (Rule("block", "bad", "/"), Rule("allow", "good", "/"))

    def graph(k, size):
        chain = [page(None, f"http://c{i}.k{k}/", f"http://c{i + 1}.k{k}/" if i < 11 else f"http://k{k}.bad/") for i in range(12)]
        fans = [page(None, f"http://f{i}.k{k}/", f"http://k{k}.bad/", f"http://a{i}.k{k}/") for i in range(size)]
        return [*chain, *fans, page(None, f"http://k{k}.bad/"), page(None, f"http://k{k}.good/", f"http://c3.k{k}/")]

    def verdicts(copies):
        rows = [x for k in range(copies) for x in graph(k, 50 if k == 0 else 1)]
        many = [page(None, f"http://x{k}.bad/") for k in range(60_000)] if copies > 1 else []
        pages = spark.createDataFrame(rows + many, "page_id long, url string, html string")
        return {(r.host, r.verdict) for r in linkgraph.judge_urls(pages, rules).where("host like '%.k0' or host like 'k0.%'").collect()}

    once = verdicts(1)
    assert ("c0.k0", "block") in once and ("f7.k0", "block") in once and ("c3.k0", "block") not in once
    assert verdicts(3) == once


def test_verdicts_on_thousands_of_hosts_equal_plain_pagerank(spark):
    """3 000 hosts with links by preference; trust goes forward from good hosts, distrust back from bad ones."""
    rng = np.random.default_rng(5)
    n = 3_000
    name = [f"h{i}.{'bad' if i % 40 == 0 else 'good' if i % 25 == 1 else 'net' if i % 2 else 'org'}" for i in range(n)]
    rows, forth = [], {}
    for i in range(n):
        targets = {int(x) for x in (rng.random(int(rng.integers(0, 6))) ** 2 * n)} - {i}
        rows.append(page(i, f"http://{name[i]}/", *(f"http://{name[j]}/p" for j in sorted(targets))))
        forth |= {(name[i], name[j]): 1 for j in targets}
    back = {(b, a): w for (a, b), w in forth.items()}
    seeds = lambda kind: {h: 1 / sum(x.endswith(kind) for x in name) for h in name if h.endswith(kind)}
    trust, distrust = rank(forth, seeds(".good"), rounds=150), rank(back, seeds(".bad"), rounds=150)
    bad = sum(x.endswith(".bad") for x in name)
    rules = (Rule("block", "bad", "/"), Rule("allow", "good", "/"))
    got = {r.host: r.verdict for r in linkgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), rules).collect()}
    judged = 0
    for h in name:
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        if h.endswith((".bad", ".good")) or abs(d - t) < 1e-7 or abs(d * bad - linkgraph.LEAST) < 1e-7:
            continue
        judged += 1
        assert got[h] == ("block" if d > t and d * bad > linkgraph.LEAST else "allow"), h
    assert judged > 2_500 and len(got) == n
    assert 300 < sum(v == "block" for v in got.values()) < n - 300
