"""Records and tables of landed pages: repeated siblings, tables with spans, and the lists of a notice.

Pages are read in tasks, one at a time; a page's work is linear in its length. Null, empty and broken pages give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.deadlines import deadline, read_date

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "dt"))
#: Fixed values of HTML: elements without content, and which open elements a start tag ends.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"), "option": ("option",)}
ENDS |= dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "div", "section", "article", "main", "form", "footer", "header", "nav", "aside", "hr", "pre", "blockquote"), ("p",))
#: What those may not look past.
WALLS = frozenset(("table", "ul", "ol", "dl", "div", "section", "article", "body", "select"))
MOST_SPAN = 1000  # fixed value of HTML: wider cells count as one column
SPANNED = 100_000  # places that the spans of one table fill at most; further cells then span one row and column, as a hostile table grows by the square
PLAIN = re.compile("<([A-Za-z][A-Za-z0-9]*)>")
#: Fixed value of HTML: elements whose content the parser may read as text.
RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))
ROWS = 2000  # rows after which a task hands its pages' rows on
TAGS = 8  # how many of its last tags a path names, so that deep pages do not grow by the square


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def name(self) -> str:
        kind = (self.attrs.get("class") or "").split()
        return f"{self.tag}.{kind[0]}" if kind else self.tag


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines and columns

    def parse_starttag(self, i: int) -> int:
        """A start tag without attributes is read by one pattern; all else as ever."""
        plain = PLAIN.match(self.rawdata, i)
        if plain is None or plain[1].lower() in RAW:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1].lower(), [])
        return plain.end()

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for old in ENDS.get(tag, ()):
            if self.open.get(old):
                node = self.at
                while node.tag not in WALLS and node.tag != old and node.parent is not None:
                    node = node.parent
                if node.tag == old:
                    while self.at is not node:
                        self._leave()
                    self._leave()
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):  # an end without a start is passed over without a search
            while self.at.tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.at.kids.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def walk(nodes: list[Node | str], without: str | None = None) -> Iterator[Node | str]:
    """All parts in the page's order; what lies in elements `without` is passed over."""
    stack = list(reversed(nodes))
    while stack:
        part = stack.pop()
        yield part
        if isinstance(part, Node) and part.tag != without:
            stack.extend(reversed(part.kids))


def text_of(nodes: list[Node | str], without: str | None = None) -> str:
    return " ".join(" ".join(p if isinstance(p, str) else " " if p.tag == "br" else "" for p in walk(nodes, without)).split())


def _link(node: Node) -> str:
    href = (node.attrs.get("href") or "").strip() if node.tag == "a" else ""
    return "" if href.startswith(("#", "javascript:", "mailto:", "tel:")) else href


# Records


def _summaries(root: Node) -> dict[int, tuple[object, object]]:
    """Of each subtree: its heading and its link; None if it has none, False if it has several different ones."""
    found: dict[int, tuple[object, object]] = {}
    both = lambda a, b: b if a is None else a if b is None or a == b else False
    for node in reversed([n for n in walk([root]) if isinstance(n, Node)]):  # children come before their parents
        heading: object = id(node) if node.tag in HEADINGS else None
        link: object = _link(node) or None
        for kid in node.elements():
            h, a = found[id(kid)]
            heading, link = both(heading, h), both(link, a)
        found[id(node)] = (heading, link)
    return found


def _is_record(heading: object, link: object) -> bool:
    """One heading whatever its links, or one link and no heading."""
    return heading not in (None, False) or (heading is None and link not in (None, False))


def regions(root: Node) -> Iterator[tuple[str, list[list[Node | str]]]]:
    """(path, records) of each repeated group, outermost first: siblings of one tag that are records each, or the stretches
    that begin with headings of one tag below one parent. A record is not searched for groups of its own."""
    known = _summaries(root)
    queue: list[tuple[Node, tuple[str, ...]]] = [(root, ())]
    while queue:
        node, path = queue.pop()
        kids, inside = node.elements(), set()
        by_tag: dict[str, list[Node]] = {}
        for k in kids:
            by_tag.setdefault(k.tag, []).append(k)
        for tag, same in by_tag.items():
            here = "/".join((*path, tag)[-TAGS:])
            if tag in HEADINGS and len(same) > 1:
                places = [i for i, k in enumerate(node.kids) if isinstance(k, Node) and k.tag == tag] + [len(node.kids)]
                yield here, [node.kids[a:b] for a, b in zip(places, places[1:], strict=False)]
                inside.update(id(k) for k in node.kids[places[0] :] if isinstance(k, Node))
            elif tag not in HEADINGS and tag != "a":
                fits = [k for k in same if id(k) not in inside and _is_record(*known[id(k)])]
                if len(fits) > 1:
                    yield here, [[k] for k in fits]
                    inside.update(id(k) for k in fits)
        queue.extend((k, (*path, k.tag)[-TAGS:]) for k in reversed(kids) if id(k) not in inside)


def _fields(record: list[Node | str]) -> tuple[dict[str, str], str, str]:
    """Text by the path of its element within the record, numbered among equals; the path of the heading; the link."""
    values: dict[str, str] = {}
    counts: dict[str, int] = {}
    heading, link = "", ""
    stack: list[tuple[Node | str, tuple[str, ...]]] = [(part, ()) for part in reversed(record)]
    while stack:
        part, path = stack.pop()
        if isinstance(part, str):
            continue
        link = link or _link(part)
        here = (*path, part.name())[-TAGS:]
        kids = part.elements()
        plain = part.tag in HEADINGS or part.tag in ("a", "p", "td", "th") or not any(k.tag != "br" for k in kids)
        own = text_of(part.kids) if plain else text_of([k for k in part.kids if isinstance(k, str)])
        if own:
            name = "/".join(here)
            counts[name] = counts.get(name, 0) + 1
            key = f"{name}[{counts[name]}]"
            values[key] = own
            if part.tag in HEADINGS and not heading:
                heading = key
        if plain:
            link = link or next((_link(n) for n in walk(part.kids) if isinstance(n, Node) and _link(n)), "")
        else:
            stack.extend((k, here) for k in reversed(part.kids))
    return values, heading, link


def records_of(url: str | None, html: str | None) -> Iterator[tuple[int, str, int, str, str | None, list[tuple[str, str]]]]:
    """(region, path, place, title, link, fields) of a page. Texts that all records of a group share at one place are its
    template and no fields. The title is the heading, else the first field with a word; no title, no record."""
    for number, (path, group) in enumerate(regions(tree(html))):
        read = [_fields(r) for r in group]
        first = read[0][0]
        fixed = {k for k, v in first.items() if all(r[0].get(k) == v for r in read)}
        for place, (values, heading, link) in enumerate(read):
            fields = [(k, v) for k, v in values.items() if k not in fixed]
            head = heading or next((k for k, v in fields if re.search(r"\w", v)), None)
            if head:
                yield number, path, place, values[head], urljoin(url or "", link) if link else None, [(k, v) for k, v in fields if k != head]


def _per_page(pages: DataFrame, key: str, url: str, html: str, read, schema: str) -> DataFrame:
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).where("html <> ''")
    told = f"key {dict(pages.dtypes)[key]}, {schema}"
    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], told).schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html")), strict=True):
                for row in read(u, h):
                    rows.append((k, *row))
                    if len(rows) >= ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return slim.mapInArrow(scan, told).withColumnRenamed("key", key)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, region, path, place, title, link, fields): the repeated records of every page; no portal is named anywhere."""

    def read(u, h):
        return ((*r[:5], [{"path": p, "value": v} for p, v in r[5]]) for r in records_of(u, h))

    return _per_page(pages, key, url, html, read, "region int, path string, place int, title string, link string, fields array<struct<path:string,value:string>>")


def cards(found: DataFrame, year: int) -> DataFrame:
    """Records that are calls: they have a link and a field beside the title. Status words before a title go, as does the
    label of a labelled field; the deadline is read from all fields."""
    body = F.concat_ws(" . ", F.transform("fields", lambda x: x["value"]))
    title = F.regexp_replace("title", r"(?i)^(?:expired|open|closed)\b[\s:]+(?=\S)", "")
    labelled = F.filter(F.transform("fields", lambda x: F.regexp_extract(x["value"], r"^([\p{L}][\p{L} ]{1,30}):\s*\S", 1)), lambda x: x != "")
    rows = found.where("link is not null and size(fields) > 0")
    return rows.select(*[c for c in found.columns if c not in ("title", "fields")], title.alias("title"), body.alias("description"), labelled.alias("labels"), deadline(body, year)["deadline"].alias("deadline"))


# Tables


def _whole(text: str | None, least: int) -> int:
    return int(text) if text and re.fullmatch(r"[0-9]{1,9}", text.strip()) and int(text) >= least else 1


def grid(table: Node) -> tuple[list[list[tuple[Node, bool]]], int]:
    """The table's cells, each at all the rows and columns that it spans, and how many leading rows are headers."""
    rows: list[tuple[Node, str, int]] = []
    for part in table.elements():
        if part.tag == "tr":
            rows.append((part, "", 0))
        elif part.tag in ("thead", "tbody", "tfoot"):
            rows.extend((r, part.tag, id(part)) for r in part.elements() if r.tag == "tr")
    out: list[list[tuple[Node, bool]]] = []
    carried: dict[int, tuple[int, Node]] = {}  # column: the row at which its span ends, cell
    nothing = Node("td", {}, None)  # where a row stops short of a span
    heads, group, room = 0, 0, SPANNED
    for row, kind, at in rows:
        if at != group:
            carried, group = {}, at  # no cell reaches out of its group of rows
        line: list[tuple[Node, bool]] = []

        carried = {i: x for i, x in carried.items() if x[0] > len(out)}

        def take(line=line, carried=carried):
            while len(line) in carried:
                line.append((carried[len(line)][1], True))

        spans: list[tuple[int, int, Node]] = []
        cells = [c for c in row.elements() if c.tag in ("td", "th")]
        for cell in cells:
            take()
            wide, text = _whole(cell.attrs.get("colspan"), 1), (cell.attrs.get("rowspan") or "").strip()
            tall = len(rows) if text == "0" else _whole(text, 1)
            wide, tall = wide if wide <= MOST_SPAN else 1, min(tall, len(rows) - len(out))
            if wide * tall > 1:
                wide, tall = (wide, tall) if wide * tall <= room else (1, 1)
                room -= wide * tall
            for _ in range(wide):
                spans.append((len(line), len(out) + tall, cell))
                line.append((cell, False))
        for i in range(len(line), max(carried, default=-1) + 1):
            line.append((carried[i][1] if i in carried else nothing, True))
        carried.update((i, (end, cell)) for i, end, cell in spans)
        if heads == len(out) and line and (kind == "thead" or all(c.tag == "th" for c, _ in line)):
            heads += 1
        out.append(line)
    return out, heads


def tables_of(url: str | None, html: str | None) -> Iterator[tuple[int, int, list[dict[str, str | None]]]]:
    """(table, row, cells) of a page. Column names join the different texts of the header rows above; without header rows a
    row of one th and one td is a label and its value, and other columns are named by their number."""
    number = -1
    for node in walk([tree(html)]):
        if not isinstance(node, Node) or node.tag != "table":
            continue
        number += 1
        lines, heads = grid(node)
        texts: dict[int, tuple[str, str | None]] = {}

        def read(cell: Node, texts=texts) -> tuple[str, str | None]:
            if id(cell) not in texts:  # tables within a cell speak for themselves
                link = next((_link(n) for n in walk(cell.kids, "table") if isinstance(n, Node) and _link(n)), "")
                texts[id(cell)] = (text_of(cell.kids, "table"), urljoin(url or "", link) if link else None)
            return texts[id(cell)]

        names: list[list[str]] = []
        for line in lines[:heads]:
            for i, (cell, _) in enumerate(line):
                while len(names) <= i:
                    names.append([])
                said = read(cell)[0]
                if said and said not in names[i]:
                    names[i].append(said)
        titles = [" / ".join(said) if said else f"column {i + 1}" for i, said in enumerate(names)]
        titles += [f"column {i + 1}" for i in range(len(titles), max(map(len, lines), default=0))]
        for place, line in enumerate(lines[heads:]):
            if not heads and [c.tag for c, _ in line] == ["th", "td"]:
                value, link = read(line[1][0])
                yield number, place, [{"name": read(line[0][0])[0].rstrip(": "), "value": value, "link": link}]
            elif line:
                said = [read(c) for c, _ in line]
                yield number, place, [{"name": name, "value": value, "link": link} for name, (value, link) in zip(titles, said, strict=False)]


def tables(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, table, row, cells): every row of every table, spans filled in, cells named by their headers."""
    return _per_page(pages, key, url, html, tables_of, "table int, row int, cells array<struct<name:string,value:string,link:string>>")


def cell(pattern: str, part: str = "value") -> Column:
    """The first cell of a row whose name fits the pattern."""
    return F.get(F.filter("cells", lambda c: F.regexp_like(F.lower(c["name"]), F.lit(pattern))), F.lit(0))[part]


def notice_rows(found: DataFrame) -> DataFrame:
    """Table rows that are notices: a title column with a link, deadline, agency, reference and country by header words."""
    title = cell(r"^(?:title|notice|subject|description)\b")
    link = F.coalesce(cell(r"^(?:title|notice|subject|description)\b", "link"), F.get(F.filter(F.transform("cells", lambda c: c["link"]), lambda x: x.isNotNull()), F.lit(0)))
    key = [c for c in found.columns if c != "cells"]
    rows = found.select(*key, title.alias("title"), link.alias("link"), read_date(cell(r"\bdeadline\b|\bclosing\b"))["date"].alias("deadline"), cell(r"\bagency\b|\borgani[sz]ation\b|\bbuyer\b").alias("agency"), cell(r"\breference\b").alias("reference"), cell(r"\bcountry\b|\bterritory\b").alias("country"))
    return rows.where("title <> '' and link is not null")


# The lists of a notice: contacts, documents, codes


_DOCUMENT = re.compile(r"(?i)\.(?:pdf|docx?|xlsx?|zip|odt|rtf)(?:[?#]|$)|/download[a-z]*(?:[/?]|$)")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def lists_of(url: str | None, html: str | None) -> Iterator[tuple[list[dict], list[dict], list[dict]]]:
    """Contacts (label and value pairs under one parent, at least a name or an address), linked documents, codes (a number
    element followed by its name), each once and in the page's order; a page without any gives no row."""
    contacts, documents, codes = [], {}, {}
    seen: set[tuple[str, ...]] = set()
    pairs: dict[int, dict[str, str]] = {}
    for node in walk([tree(html)]):
        if not isinstance(node, Node):
            continue
        href = _link(node)
        if href and _DOCUMENT.search(href):
            name = text_of(node.kids)
            if name:
                documents.setdefault(urljoin(url or "", href), name)
        kids = node.elements()
        if len(kids) == 2 and node.parent is not None and not any(k.elements() for k in kids if k.tag != "a"):
            label, value = text_of(kids[0].kids), text_of(kids[1].kids)
            if re.fullmatch(r"[0-9]{6,10}", label) and value:
                codes.setdefault(label, value)
            elif label.endswith(":") and value:
                pairs.setdefault(id(node.parent), {}).setdefault(label.rstrip(": ").lower(), value)
    for said in pairs.values():
        of = lambda *words: next((v for k, v in said.items() if any(w in k for w in words)), "")  # noqa: E731, B023
        name = " ".join(x for x in (of("first name"), of("surname", "last name")) if x) or said.get("name", "")
        mail = _MAIL.search(of("email", "e-mail"))
        who = (name, mail.group() if mail else "", of("phone"), of("role", "function", "title"))
        if (who[0] or who[1]) and who not in seen:
            seen.add(who)
            contacts.append(dict(zip(("name", "email", "phone", "role"), who, strict=True)))
    if contacts or documents or codes:
        yield contacts, [{"name": n, "url": u} for u, n in documents.items()], [{"code": c, "name": n} for c, n in codes.items()]


def notice_lists(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, contacts, documents, codes) as arrays of structs, whole lists."""
    pair = "array<struct<{}:string,{}:string>>".format
    return _per_page(pages, key, url, html, lists_of, f"contacts array<struct<name:string,email:string,phone:string,role:string>>, documents {pair('name', 'url')}, codes {pair('code', 'name')}")
