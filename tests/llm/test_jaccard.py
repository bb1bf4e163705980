import random
import re

import corpus_pipeline
import numpy as np
import pytest

from callweave.llm import jaccard, oracles, queries
from callweave.llm.components import connected_components
from tests.compare import SF, difference, duck

from .brute import words


def plain_set(text, n=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_classes(sets, percent=85):
    """The smallest place reachable from each set; every pair is compared."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def family(rnd, n, words_, edits, vocabulary=5000):
    base = [f"w{rnd.randrange(vocabulary)}" for _ in range(words_)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**9)}"
        out.append(" ".join(w[: len(w) - rnd.randint(0, 3)]))
    return out


def texts_of(rnd):
    shared = " ".join(f"p{i}" for i in range(60))
    texts = family(rnd, 60, 147, 12) + family(rnd, 25, 30, 2) + family(rnd, 15, 400, 25)
    texts += [f"{shared} " + " ".join(f"u{rnd.randrange(10**9)}" for _ in range(rnd.randint(2, 14))) for _ in range(40)]
    texts += [" ".join(f"q{rnd.randrange(4)}" for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    texts += [texts[3].upper(), texts[3].replace(" ", "\n\t"), "", " \x0b ", "One two", "one TWO", "one two three", None]
    return texts


def check(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_classes(df, **more).collect()}
    sets = [plain_set(t) for t in texts]
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, plain_classes(sets)))}


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_all_pairs(spark, seed):
    check(spark, texts_of(random.Random(seed)))


def test_large_posted_sets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ROWS", 8)
    check(spark, texts_of(random.Random(7)))


@pytest.mark.parametrize("seed", range(6))
def test_a_shard_joins_what_all_pairs_join(seed):
    rnd = random.Random(seed)
    sets = list({frozenset(x): x for x in (np.unique(np.array([rnd.randrange(2**64 - 1) if rnd.random() < 0.1 else (rnd.randrange(30) * 0x9E3779B97F4A7C15) % 2**64 for _ in range(rnd.randint(1, 60))], np.uint64)) for _ in range(300))}.values())
    sketch = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    sketch[np.random.default_rng(seed).integers(0, len(sketch), 1 << 18)] = 3
    for percent in (85, 60):
        label = list(range(len(sets)))
        for a, b in jaccard.forest([jaccard.in_order(s, sketch) for s in sets], sketch, percent):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert 100 * len(x & y) >= percent * len(x | y)
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if v == old else v for v in label]
        assert label == plain_classes([set(s.tolist()) for s in sets], percent)


@pytest.mark.parametrize("seed", range(4))
def test_maps_lose_no_similar_set(seed):
    rnd = random.Random(seed)
    texts = [t for t in texts_of(rnd) if t and len(plain_set(t)) > 0] + family(rnd, 20, 520, 30) + family(rnd, 20, 510, 20)
    sets = jaccard.gram_sets(texts)
    near = jaccard.near_maps(np.array([len(s) for s in sets]), [jaccard.parity_map(s) for s in sets])
    plain = [set(s.tolist()) for s in sets]
    linked = [any(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(plain) if j != i) for i, a in enumerate(plain)]
    assert all(n for n, x in zip(near, linked) if x) and not near.all()


def test_whole_table_equals_sql(spark):
    assert difference(queries.op11_jaccard_join(spark, SF), oracles.JACCARD, duck()) == ""


def test_edge_rows(spark, odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(odd).collect()), key=repr)
    assert got == sorted([(1, 6, 1), (1, 6, 1), (2, 0, 2), (None, 2, None), (None, 2, None), (3, 2, 3), (3, 2, 3), (4, 0, 4)], key=repr)
    assert jaccard.similar_classes(empty).count() == 0
    same = spark.createDataFrame([(None, "a b c d e"), (4, "A b c d e"), (3, "a b\nc d e"), (9, "a\x00b c d e"), (8, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.similar_classes(same).collect()} == {(None, 3), (4, 3), (3, 3), (9, 9), (8, 8)}


def test_components_go_on_until_they_are_settled(spark):
    chain = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {r.root for r in connected_components(chain).collect()} == {0}


def test_one_of_each_leaves_out_no_link(spark, odd, empty):
    """Short texts, whose similarity fingerprints tell badly: exactly the first of each class stays."""
    rnd, rows = random.Random(4), []
    for i in range(60):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(20, 60))]
        rows.append(" ".join(base))
        for _ in range(4):
            base[rnd.choice([0, 1, -1, -2, rnd.randrange(len(base))])] = f"x{rnd.randrange(10**6)}"
            rows.append(" ".join(base))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    firsts = set(plain_classes([plain_set(t, 5) for t in rows], 80))
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == firsts and len(firsts) < len(rows) - 50
    assert jaccard.one_of_each(empty).count() == 0
    # the repeated row and the second of the two empty texts go; null ids and an id with two texts stay
    assert jaccard.one_of_each(odd).count() == odd.count() - 2 and jaccard.one_of_each(odd).columns == odd.columns
