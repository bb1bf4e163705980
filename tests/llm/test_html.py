from html.parser import HTMLParser

import numpy as np

from callweave.llm import htmltext

from ..compare import SF
from .conftest import LONG

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>
<article><h1>Head &amp; line</h1><p>One <b>bold</b>
 two<br>three.<p>Unclosed &lt;p&gt; &eacute;<div class="share-buttons">Share</div><ul><li>first<li>second</ul><form><input value=">">Send</form>
<section id="comments"><p>Nice!</p></section><aside>Side</aside><p title="a > b">Last</p></article><footer>&copy; me</footer></body></html>"""


def text(page):
    return "\n\n".join(htmltext.blocks(page)[0])


def test_article_only():
    assert htmltext.blocks(PAGE) == (["Head & line", "One bold two three.", "Unclosed <p> é", "first", "second", "Last"], True)


def test_damaged_pages():
    assert text("<article><p>cut off he<b>re and th") == "cut off here and th"
    assert text("<article><p>cut tag <a hre") == "cut tag"
    assert text("<article><p>a < b &am") == "a < b &am"
    assert text("</p></div><article>x</article></article>y") == "x"
    assert text("<article><!-- never closed <p>x") == ""
    assert text("<article><script>never closed <p>x") == ""
    assert text("") == "" and text("plain") == "plain"
    assert text('<article><p class="x>y">q</p>') == "q"


def test_attributes_and_names():
    assert text('<article><div style="overflow: hidden">seen</div></article>') == "seen"
    assert text('<article><p data-id="menu" title="class=ad">seen</p></article>') == "seen"
    assert text('<article><div class="article-header"><h1>Title</h1></div><section class="related-work">Section</section></article>') == "Title\n\nSection"
    assert text('<main><p>text</p><article class="comment">not this</article></main>') == "text"
    assert text('<article><div class="site-footer x">no</div><div class="comment-list">no</div><p hidden>no</p><p aria-hidden="true">no</p><p class="adverb">yes</p></article>') == "yes"
    assert text("<article><p CLASS=Newsletter>no</p><p class='wide sidebar'>no</p><p id=note>yes</p></article>") == "yes"


class Plain(HTMLParser):
    """A plain reading of well-formed pages with one article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.blocks, self.parts = False, 0, [], []

    def end_block(self):
        if piece := " ".join("".join(self.parts).split()):
            self.blocks.append(piece)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("script", "style", "nav", "form", "aside", "footer"):
            self.skipped += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "section"):
            self.end_block()

    def handle_endtag(self, tag):
        if tag == "article":
            self.end_block()
            self.inside = False
        elif tag in ("script", "style", "nav", "form", "aside", "footer"):
            self.skipped -= 1
        elif tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "section"):
            self.end_block()

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


def test_whole_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 200
    for r in rows:
        plain = Plain()
        plain.feed(r.html)
        want = "\n\n".join(plain.blocks)
        assert got[r.page_id] == (want, len(want)) and want


def test_blocks_that_a_host_shows_elsewhere_leave_articles(spark):
    """Every page takes part: the notice stands beside other articles of the host; a passage that only articles share stays."""
    notice, passage = "Read our newsletter for more of this", "a passage that several articles of the host quote in full"
    rows = [(i, f"http://h.org/{i}", f"<article><p>own text {i}</p><p>{passage}</p></article><footer><p>{notice}</p></footer>") for i in range(4)]
    rows += [(10, "http://h.org/x", f"<article><p>own text x</p><p>{notice}</p><p>{passage}</p></article>"), (11, "http://o.org/x", f"<article><p>{notice}</p></article>")]
    got = {r.page_id: (r.text, r.n_repeated) for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: (f"own text {i}\n\n{passage}", 0) for i in range(4)} | {10: (f"own text x\n\n{passage}", 1), 11: (notice, 0)}


def repeated_tokens(pages, run):
    """Plainly: which tokens a string of `run` tokens covers that a page of other content holds."""
    out = []
    for page in pages:
        covered = [False] * len(page)
        for at in range(len(page) - run + 1):
            piece = page[at : at + run]
            if any(q != page and any(q[j : j + run] == piece for j in range(len(q) - run + 1)) for q in pages):
                covered[at : at + run] = [True] * run
        out.append(covered)
    return out


def test_pages_without_article_lose_what_their_host_repeats(spark):
    rest = "imprint terms privacy and all that legal matter below here"
    rows = [(i, f"http://h.org/{i}", f"<body><div>own text number {i} tells {i} of {i}</div><div>{rest}</div></body>") for i in range(6)]
    rows += [(10, "http://h.org/x", "<body><article>kept</article><div>" + rest + "</div></body>"), (11, None, None), (12, "http://h.org/e", ""), (13, "http://other.org/", f"<p>{rest}</p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.main_text(pages).collect())
    own = [(i, f"own text number {i} tells {i} of {i}") for i in (0, 0, 1, 2, 3, 4, 5)]
    assert got == sorted((i, t, len(t)) for i, t in [*own, (10, "kept"), (11, ""), (12, ""), (13, rest)])


def test_a_run_on_two_of_a_hosts_many_pages_goes(spark):
    """Twenty pairs of pages share a run each, among 4 100 pages of one host."""
    run = lambda k: " ".join(f"r{k}x{j}" for j in range(9))
    rows = [(i, f"http://h.org/{i}", f"<p>own{i} text{i}</p>" + (f"<p>{run(i % 20)}</p>" if i < 40 else "")) for i in range(4_100)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own{i} text{i}" for i in range(4_100)}


def test_pages_with_an_article_show_what_their_host_repeats(spark):
    rest, quoted = "imprint terms privacy and all that legal matter below here", "a long sentence that the article of another page holds too"
    rows = [(1, "http://h.org/1", f"<p>own text</p><p>{quoted}</p><div>{rest}</div>"), (2, "http://h.org/2", f"<article>{quoted}</article><div>{rest}</div>"), (3, "http://o.org/", f"<p>{rest}</p>")]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"own text\n\n{quoted}", 2: quoted, 3: rest}


def test_exchange_equals_plain_search(spark):
    rng = np.random.default_rng(7)
    pages = [" ".join(str(x) for x in rng.integers(0, 4, int(rng.integers(1, 120)))) for _ in range(20)]
    pages += [pages[0], pages[1] + " 1"]
    rows = [(i, "http://h.org/", f"<p>{p}</p>") for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), run=5).collect()}
    tokens = [p.split(" ") for p in pages]
    gone = repeated_tokens(tokens, 5)
    assert got == {i: " ".join(w for w, x in zip(t, gone[i], strict=True) if not x) for i, t in enumerate(tokens)}


def test_edge_cases(spark):
    schema = "page_id long, url string, html string, blocks string, settled string, host string"
    assert htmltext.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, f"<article>{LONG}</article>", "b", "s", "h"), (None, None, "<p>" + "<b>" * 3000 + "deep", "b", "s", "h")]
    assert sorted(r.n_chars for r in htmltext.main_text(spark.createDataFrame(rows, schema)).collect()) == [4, len(LONG.strip())]
