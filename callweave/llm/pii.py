"""Personal data in whole texts: base patterns, and identifiers in disguise found through transducers.

A transducer rewrites a text and keeps, for every character it writes, the span of source characters that it
stands for. They run in turn: invisible characters vanish and homoglyphs become ASCII; runs of spelled digits
become digits; "at" and "dot" in disguise become @ and a point. Identifiers found in the result are mapped
back to source spans, so nothing is lost of the original's offsets. Base spans always stay; a disguised one is
added unless a base span of its kind holds it.

Spelled digits count in runs of at least `DIGIT_RUN` of them, of `LEAST_DIGITS` digits of either kind, or of four parts. A bare "at" and a plain @ count only if a "dot" in
disguise follows in the domain or a bracketed one stands in the local part, a bracketed "at" always: plain prose
stays clean. The local part is followed back over its dots for any length; a bare dot in it must use a word that
the domain uses too, if the domain has dots in words ("contact point jane at example dot org").

Edge cases: null and empty texts have no spans; repeated rows are searched each; offsets are code points.
All patterns take linear time on long runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at the start of its digits: later starts in the same digits fail where the first does
_IP = re.compile(r"(?<![0-9])[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """As the leftmost pattern finds them, but led by the @: a long run without one costs nothing."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def find(text: str) -> dict[str, list[Span]]:
    """Base spans by kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# ---------------------------------------------------------------- transducers

#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaopvikABEZHIKMNOPTYX", strict=True))
#: Signs that stand for @, a point, a hyphen, a plus or a blank.
HOMOGLYPHS |= {"﹫": "@", "。": ".", "｡": ".", "․": ".", "﹒": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
HOMOGLYPHS |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
#: Characters that are not seen.
HOMOGLYPHS |= {c: "" for c in "­​‌‍⁠﻿᠎"}
_HOMOGLYPH = re.compile(f"[{re.escape(''.join(HOMOGLYPHS))}]")

#: Digits as words, in the languages of the corpus.
DIGIT_WORDS = {w: str(d) for d, words in enumerate(("zero oh cero zéro null", "one uno un eins", "two dos deux zwei", "three tres trois drei", "four cuatro quatre vier", "five cinco cinq fünf", "six seis sechs", "seven siete sept sieben", "eight ocho huit acht", "nine nueve neuf neun")) for w in words.split()}
#: A run counts with so many spelled digits, or with so many digits in all (the least of a phone number), or as four parts.
DIGIT_RUN, LEAST_DIGITS, LEAST_DOTS = 4, 9, 3
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT = rf"(?:(?:{_WORD})(?!\w)|[0-9]+)"
_RUN = re.compile(rf"(?<!\w){_UNIT}(?:[\s,-]{{1,3}}(?:{_UNIT}|(?:plus|dot|point|punto|punkt)(?!\w)))*+(?!\w)")
_TOKEN = re.compile(rf"(?<!\w)({_WORD})(?!\w)|[0-9]|(?<!\w)(?:dot|point|punto|punkt)(?!\w)")

_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT_SIGN = rf"\s*{_OPEN}(?:at|@|arroba|chez)(?:{_CLOSE})\s*"
_DOT_SIGN = rf"\s*{_OPEN}(?:dot|\.|punto|point|punkt)(?:{_CLOSE})\s*"
_BARE_AT, _BARE_DOT = r"\s+(?:at|arroba|chez)\s+", r"\s+(?:dot|punto|point|punkt)\s+"
_AT = re.compile(rf"(?<=[a-z0-9_%+-])(?:({_AT_SIGN}|\s+@\s*|\s*@\s+)|({_BARE_AT}|@))(?=([a-z0-9-]+)((?:(?:\.|{_DOT_SIGN}|{_BARE_DOT})[a-z0-9-]+)+))")
_DOT = re.compile(rf"{_DOT_SIGN}|{_BARE_DOT}")
_DOT_WORDS = ("dot", "punto", "point", "punkt")
_HINT = re.compile(rf"{_DOT_SIGN}|{_AT_SIGN}|\s(?:dot|punto|point|punkt)\s|\s@|@\s")


class Traced:
    """A rewritten text, with the source span of each of its characters."""

    def __init__(self, text: str, spans: list[Span] | None = None) -> None:
        self.text, self.spans = text, spans if spans is not None else [(i, i + 1) for i in range(len(text))]

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Traced:
        """Puts `new` for text[a:b], for sorted, disjoint (a, b, new)."""
        if not changes:
            return self
        text, spans, at = [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            spans += self.spans[at:a]
            if new:
                spans += [(self.spans[a][0], self.spans[b - 1][1])] * len(new)
            at = b
        return Traced("".join(text) + self.text[at:], spans + self.spans[at:])

    def source(self, a: int, b: int) -> Span:
        return self.spans[a][0], self.spans[b - 1][1]


def look_alikes(t: Traced) -> Traced:
    return t.rewrite([(m.start(), m.end(), HOMOGLYPHS[m.group()]) for m in _HOMOGLYPH.finditer(t.text)])


def _lower(text: str) -> str:
    """Lower case with offsets kept: the few letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def spelled_digits(t: Traced) -> Traced:
    low, changes = _lower(t.text), []
    for run in _RUN.finditer(low):
        tokens = list(_TOKEN.finditer(low, run.start(), run.end()))
        spelled = sum(bool(x[1]) for x in tokens)
        digits = spelled + sum(x.group().isdigit() for x in tokens)
        if not spelled or (spelled < DIGIT_RUN and digits < LEAST_DIGITS and len(tokens) - digits < LEAST_DOTS):
            continue
        while tokens and not (tokens[-1][1] or tokens[-1].group().isdigit()):
            tokens.pop()
        start = run.start()
        before = _skip_blanks(low, start, 0)
        if before < start and low.endswith("plus", 0, before) and not (before > 4 and (low[before - 5].isalnum() or low[before - 5] == "_")):
            changes.append((before - 4, start, "+"))
        for i, x in enumerate(tokens):
            # each token takes the separator after it along, so that digits join
            end = tokens[i + 1].start() if i + 1 < len(tokens) else x.end()
            changes.append((x.start(), end, DIGIT_WORDS.get(x[1], x.group()) if x[1] else x.group() if x.group().isdigit() else "."))
    return t.rewrite(changes)


def _skip_blanks(low: str, end: int, floor: int) -> int:
    while end > floor and low[end - 1].isspace():
        end -= 1
    return end


def _dot_before(low: str, end: int, floor: int) -> tuple[int, str, bool] | None:
    """(start, word, whether in brackets) of the point in disguise that ends at `end`."""
    at = _skip_blanks(low, end, floor)
    closed = at > floor and low[at - 1] in "])}>"
    if not closed and at == end:
        return None
    stop = _skip_blanks(low, at - 1, floor) if closed else at
    word = next((w for w in (*_DOT_WORDS, ".") if (closed or w != ".") and low.startswith(w, max(floor, stop - len(w)), stop)), None)
    if word is None:
        return None
    at = _skip_blanks(low, start := stop - len(word), floor)
    if closed:
        return (_skip_blanks(low, at - 1, floor), word, True) if at > floor and low[at - 1] in "[({<" else None
    return (at, word, False) if at < start else None


def _local_dots(low: str, end: int, floor: int, words: set[str]) -> tuple[list[tuple[int, int, str]], bool]:
    """Changes for the points in disguise of the local part that ends at `end`, and whether one is in brackets."""
    dots: list[tuple[int, int, str]] = []
    bracketed = False
    while True:
        start = end
        while start > floor and low[start - 1] in _LOCAL:
            start -= 1
        dot = _dot_before(low, start, floor) if start < end else None
        if dot is None or dot[0] <= floor or low[dot[0] - 1] not in _LOCAL or not (dot[2] or not words or dot[1] in words):
            return dots[::-1], bracketed
        dots.append((dot[0], start, "."))
        end, bracketed = dot[0], bracketed or dot[2]


def at_and_dot(t: Traced) -> Traced:
    low, changes = _lower(t.text), []
    tried = 0
    for m in _AT.finditer(low):
        dots = list(_DOT.finditer(low, m.end(3), m.end(4)))
        floor = changes[-1][1] if changes else 0
        if m.start() < floor:
            continue
        words = {w for d in dots for w in _DOT_WORDS if w in d.group()}
        local, bracketed = _local_dots(low, m.start(), max(floor, tried), words)
        if m[1] is None and not dots and not bracketed:
            tried = m.start()
            continue  # a bare "at" before a plain host name is prose
        changes += local
        changes.append((m.start(), m.end(), "@"))
        changes += [(d.start(), d.end(), ".") for d in dots]
    return t.rewrite(changes)


TRANSDUCERS: tuple[Callable[[Traced], Traced], ...] = (look_alikes, spelled_digits, at_and_dot)


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans, by kind, that only the normalised text shows."""
    odd = not text.isascii() and _HOMOGLYPH.search(text)
    low = _lower(text)
    if not (odd or _RUN_HINT(low) or _HINT.search(low)):
        return {}
    t = Traced(text)
    for step in TRANSDUCERS:
        t = step(t)
    if t.text == text:
        return {}
    out: dict[str, list[Span]] = {}
    for kind, spans in find(t.text).items():
        known = base[kind]
        for span in dict.fromkeys(t.source(a, b) for a, b in spans):
            if not any(a <= span[0] and span[1] <= b for a, b in known):
                out.setdefault(kind, []).append(span)
    return out


_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD})[\s,-]{{1,3}}(?:(?:{_WORD}|dot|point|punto|punkt)(?!\w)|[0-9])|[0-9][\s,-]{{1,3}}(?:{_WORD})(?!\w)")


def _RUN_HINT(low: str) -> bool:  # noqa: N802
    """Cheap sieve first: a run that counts holds a spelled digit beside another of its parts."""
    return bool(_SPELLED.search(low))


def joined(spans: dict[str, list[Span]]) -> str:
    rows = sorted((a, KINDS.index(k), b) for k, found in spans.items() for a, b in found)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def both(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans."""
    base = find(text)
    more = disguised(text, base)
    return base, {k: base[k] + more.get(k, []) for k in KINDS} if more else base


def redact(text: str) -> str:
    """The text with [KIND] for each span; overlapping spans become one, named after the first."""
    spans = sorted((a, -b, KINDS.index(k)) for k, found in both(text)[1].items() for a, b in found)
    if not spans:
        return text
    out, at = [], 0
    for a, minus_b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, -minus_b)
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- on DataFrames


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of base spans, base_sha256, spans, n_disguised)."""
    kind = dict(docs.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans, more = [], [], []
            for value in batch.column(1):
                base, every = both(value.as_py() or "")
                for k in KINDS:
                    counts[k].append(len(base[k]))
                listed = joined(base)
                digests.append(hashlib.sha256(listed.encode()).hexdigest())
                spans.append(listed if every is base else joined(every))
                more.append(0 if every is base else sum(len(every[k]) - len(base[k]) for k in KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    schema = f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    return docs.select(key, text).mapInArrow(scan, schema).withColumnRenamed("key", key)


def redacted(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The documents with their spans replaced; null texts stay null. `length` names a column to hold the new length."""
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := v.as_py()) is None else redact(t) for v in batch.column(names.index(text))]
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(new, batch.schema.field(names.index(text)).type)
            if length:
                i = names.index(length)
                columns[i] = pa.array([None if t is None else len(t) for t in new]).cast(batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
