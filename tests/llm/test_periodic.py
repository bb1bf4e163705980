import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import periodic, queries
from tests.compare import SF

from .brute import words


def plain_runs(w, least=6, times=4):
    """Every period tried on every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, plant=True):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_documents_equal_a_plain_search(spark):
    """Every document of the tables; the plain search tries all periods on arrays."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = rows(queries.op12_periodic_runs(spark, SF))
    assert [r[0] for r in got] == sorted(docs, key=repr)
    assert sum(r[1] > 0 for r in got) > 50
    short = {k for k, t in docs.items() if len(words(t)) < 700}
    assert [r for r in got if r[0] in short] == sorted((plain_row(k, docs[k]) for k in short), key=repr)
    for r in (r for r in got if r[0] not in short):
        assert r == long_row(r[0], docs[r[0]])


def long_row(doc_id, text):
    """plain_row with the comparisons of one period made at once."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    number = {}
    ids = np.array([number.setdefault(x, len(number)) for x in w])
    found = {}
    for q in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids[q:] == ids[:-q], [0])).astype(int)))
        for i, j in zip(edge[0::2], edge[1::2]):
            if j + q - i >= max(6, 4 * q):
                found.setdefault((int(i), int(j + q - i)), q)
    runs = sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_dense_words_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            k, w = rnd.choice([1, 2, 3, 10]), []
            for _ in range(rnd.randint(0, 12)):
                w += [rnd.randrange(k) for _ in range(rnd.randint(1, 6))] * rnd.choice([1, 1, 2, 4, 7])
            docs.append(w)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        found = periodic.maximal_runs(np.array(sum(docs, []), np.int64), owner)
        want, offset = [], 0
        for d in docs:
            want += [(s + offset, n, q) for s, n, q in plain_runs(d)]
            offset += len(d)
        assert sorted(zip(*(x.tolist() for x in found))) == sorted(want)


def test_words_outside_of_repeated_grams_are_masked():
    ids = np.array([*range(50), *[1, 2] * 5, *range(60, 90)])
    first, last = periodic.surviving_segments(periodic.Words(ids), np.zeros(len(ids), np.int64), periodic.least_overlap())
    assert periodic.least_overlap() == 5 and list(zip(first, last)) == [(50, 60)]


def test_a_long_text_takes_no_square_of_its_length():
    ids = np.arange(400_000) % 13
    assert [x.tolist() for x in periodic.maximal_runs(ids, np.zeros(len(ids), np.int64))] == [[0], [400_000], [13]]


def test_edge_rows(spark, odd, empty):
    got = rows(periodic.periodic_runs(odd))
    long = [r for r in got if r[0] == 1]
    assert [r[1:6] for r in long] == [(1, 0, 180_000, 6, 30_000_000)] * 2
    plain = odd.where("doc_id is null or doc_id > 1").select("doc_id", "text").collect()
    assert [r for r in got if r not in long] == sorted((plain_row(r.doc_id, r.text, plant=False) for r in plain), key=repr)
    assert periodic.periodic_runs(empty).count() == 0
    tricky = [(1, "a\x0bb " * 6), (2, "a b " * 8), (3, "x\x1cy\x85z " * 7), (4, "\x00 " * 9), (5, "A a " * 9), (6, "漢 字 " * 5)]
    df = spark.createDataFrame(tricky, "doc_id long, text string")
    assert rows(periodic.periodic_runs(df)) == sorted((plain_row(*r, plant=False) for r in tricky), key=repr)


def test_collapsed_texts_keep_other_columns(spark, odd):
    out = periodic.collapsed(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert {r.text for r in out.where("doc_id is null").collect()} == {"some words", "other words"}
    assert out.where(F.col("text").isNull()).count() == 1
