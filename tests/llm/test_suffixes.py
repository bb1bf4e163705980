import random

import numpy as np
from pyspark.sql import functions as F

from callweave.llm import suffixes

from . import brute
from .conftest import sample_documents


def test_deep_shallow_orders_and_measures():
    rnd = random.Random(1)
    for _ in range(150):
        n, width = rnd.randint(1, 40), 68
        rows = np.array([[1 if j < rnd.randint(0, 70) else rnd.choice((0, 1, 2)) for j in range(width)] for _ in range(n)], np.uint8)
        group = np.array([rnd.randint(0, 2) for _ in range(n)])
        order, lcp = suffixes.deep_shallow(group, rows)
        found = [(group[i], rows[i].tobytes()) for i in order]
        assert found == sorted(found)
        for k in range(n):
            a, b = order[k - 1], order[k]
            same = rows[a] == rows[b]
            wanted = -1 if k == 0 or group[a] != group[b] else width if same.all() else int((~same).argmax())
            assert lcp[k] == wanted


def test_multikey_quicksort_equals_plain_sorting():
    rng = np.random.default_rng(2)
    for n, kinds, depth in ((0, 2, 4), (1, 2, 4), (300, 2, 16), (500, 3, 5), (400, 200, 8), (200, 1, 12)):
        rows, group = rng.integers(0, kinds, (n, 20)).astype(np.uint8), rng.integers(0, 4, n)
        order = suffixes.multikey_quicksort(group, rows, depth)
        found = [(group[i], rows[i, :depth].tobytes()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and found == sorted(found)


def texts():
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, line = letters(400), letters(80)
    rows = [(i, letters(rnd.randint(0, 600))) for i in range(40)]
    rows += [(100 + i, letters(rnd.randint(0, 120)) + passage[rnd.randint(0, 250) :] + letters(50)) for i in range(25)]
    rows += [(200 + i, letters(150) + line + letters(150)) for i in range(15)]  # shorter than a window
    rows += [(300, "ab" * 400), (301, "a" * 1000), (302, "ab" * 300), (303, passage), (304, passage), (305, passage[:99]), (306, None), (307, ""), (308, passage[:200] + "X" + passage[201:])]
    return rows


def check(spark, rows, parts):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = suffixes.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == brute.repeats(rows)


def test_equals_brute_force(spark):
    check(spark, texts(), 3)
    check(spark, [r[:2] for r in sample_documents()], 2)


def test_hot_anchors_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_ROWS", 3)
    check(spark, texts(), 4)


def test_windows_of_hot_anchors_are_not_gathered(spark, monkeypatch):
    """A passage between different texts: no task compares its copies, however many there are."""
    rnd = random.Random(11)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = letters(300)
    rows = [(i, letters(90) + passage + letters(90)) for i in range(120)]
    seen = spark.sparkContext.accumulator(0)
    plain = suffixes._compare_segment

    def counted(segment):
        seen.add(segment.num_rows)
        yield from plain(segment)

    monkeypatch.setattr(suffixes, "HOT_ROWS", 20)
    monkeypatch.setattr(suffixes, "_compare_segment", counted)
    compare = suffixes._compare

    def _compare(batches):
        suffixes._compare_segment = counted
        yield from compare(batches)

    monkeypatch.setattr(suffixes, "_compare", _compare)
    check(spark, rows, 4)
    assert seen.value < 120


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    whole = [t.encode() for _, t in texts() if t]
    runs = suffixes.anchor_runs(whole)
    held = sorted((r, s + k) for r, s, n in zip(runs["row"], runs["start"], runs["n"], strict=True) for k in range(n))
    assert held == [(i, p) for i, t in enumerate(whole) for p in range(max(0, len(t) - 99))]


def test_edge_cases(spark, odd, empty):
    assert suffixes.without_repeats(empty).count() == 0
    out = suffixes.without_repeats(odd).collect()
    assert len(out) == odd.count()
    # identical rows are one document: both keep the same
    twins = [(r.n_bytes, r.n_removed, bytes(r.kept)) for r in out if r.doc_id == 1]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_ids_of_string_type(spark):
    rows = [(f"k{i:03}", t) for i, t in texts()]
    numbered = brute.repeats([(i, t) for i, (_, t) in enumerate(sorted(rows))])
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    names = [k for k, _ in sorted(rows)]
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == {names[i]: v for i, v in numbered.items()}
