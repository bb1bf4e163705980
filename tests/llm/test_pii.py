import hashlib
import random
import time

import pytest

from callweave.llm import pii

from .brute import base_spans
from .conftest import sample_documents


def test_base_equals_plain_patterns():
    rnd = random.Random(2)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "12345678901234", " ", "-", "(", ")", "word", "é", "\n", "a@b.c@d.e", "..", "0001.002.3.0", "@a.b@c.d", "%_+-"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert pii.joined(pii.find(text)) == ",".join(base_spans(text)), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
        ("write jane at example dot org please", "email", "jane at example dot org"),
        ("bob(at)x.org", "email", "bob(at)x.org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊｏｈｎ＠ｅｘ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘ．ｃｏｍ"),
        ("é call plus one nine eight eight five five five two four eight five ok", "phone", "plus one nine eight eight five five five two four eight five"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("ip one nine two dot one six eight dot one dot one x", "ip", "one nine two dot one six eight dot one dot one"),
        ("zero​width: a​b@c.org", "email", "a​b@c.org"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises_map_back_to_their_source(text, kind, found):
    base, every = pii.both(text)
    added = [text[a:b] for a, b in every[kind] if (a, b) not in base[kind]]
    assert added == [found]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail jane@example dot com now", "jane@example dot com"),
        ("mail jane@example[dot]com now", "jane@example[dot]com"),
        ("mail jane dot doe at example dot com now", "jane dot doe at example dot com"),
        ("mail jane (dot) doe@example.com now", "jane (dot) doe@example.com"),
        ("mail jane [dot] doe at example.com now", "jane [dot] doe at example.com"),
        ("contact point jane at example dot org", "jane at example dot org"),
        ("see " + " [dot] ".join(["jane"] * 30) + " [at] example.com", " [dot] ".join(["jane"] * 30) + " [at] example.com"),
        ("see " + " dot ".join(["jane"] * 30) + " at example dot com", " dot ".join(["jane"] * 30) + " at example dot com"),
    ],
)
def test_whole_disguised_address(text, found):
    start = text.index(found)
    assert (start, start + len(found)) in pii.both(text)[1]["email"]
    assert pii.redact(text) == text.replace(found, "[EMAIL]")


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail " + "ab [dot] " * 12 + "zz [at] example [dot] org", "email", "ab [dot] " * 12 + "zz [at] example [dot] org"),
        ("call plus" + " " * 17 + "one two three four five six seven eight nine now", "phone", "plus" + " " * 17 + "one two three four five six seven eight nine"),
        ("call plus one two three four five six seven eight nine now", "phone", "plus one two three four five six seven eight nine"),
        ("card 4111 one one one 1 1111 1111", "card", "4111 one one one 1 1111 1111"),
        ("card four 1 1 1 1111 1111 1111 end", "card", "four 1 1 1 1111 1111 1111"),
        ("host 10 dot zero dot 0 dot one up", "ip", "10 dot zero dot 0 dot one"),
    ],
)
def test_spans_of_any_length(text, kind, found):
    start = text.index(found)
    assert pii.both(text)[1][kind] == [(start, start + len(found))]


@pytest.mark.parametrize("text", ["a dot " * 50_000, "a dot " * 50_000 + "at b", "a [dot] " * 40_000 + "at b.c", "a at b.c " * 40_000, "a dot a@b.c " * 30_000, "a@b dot " * 40_000])
def test_long_chains_take_linear_time(text):
    start = time.time()
    pii.both(text)
    assert time.time() - start < 20


@pytest.mark.parametrize("text", ["meet me at example.com today", "the one two of us", "at dot", "she looked at the dot. com", "one two three four", "", "point at that. No dot at all"])
def test_prose_stays_clean(text):
    assert pii.joined(pii.both(text)[1]) == ""


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "+" + "(" * 300_000, "1." * 150_000, "at " * 100_000, "one " * 50_000, "1 " * 100_000, "plus" + " " * 200_000 + "one one one one", "one 1 " * 50_000, "a@" * 100_000, "é" * 300_000):
        pii.both(text)
    assert time.time() - start < 20


def test_redaction():
    assert pii.redact("a b@c.de x") == "a [EMAIL] x"
    assert pii.redact("plain") == "plain"


def test_on_tables(spark, documents, odd, empty):
    got = {r.doc_id: r for r in pii.find_pii(documents).collect()}
    for d, t, _, _ in sample_documents():
        assert got[d].base_sha256 == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()
    assert pii.find_pii(empty).count() == 0 and pii.find_pii(odd).count() == odd.count()
    assert pii.redacted(empty, length="n_chars").count() == 0
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == odd.where("text is null").count()
