import random

import numpy as np

from callweave.llm import simhash
from callweave.llm.components import connected_components

from . import brute
from .conftest import sample_documents, sentence


def stars(pairs, fps):
    at = {int(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        for x, y in zip(a, b, strict=True):
            i, j = sorted((find(at[int(x)]), find(at[int(y)])))
            root[j] = i
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_plain_ones(spark, documents):
    text = {d: t for d, t, _, _ in sample_documents()}
    for n in (3, 5):
        got = simhash.fingerprints(documents, shingle=n, tables=3).collect()
        assert len(got) == len(text)
        for r in got:
            assert [x % 2**64 for x in r.fps] == brute.tables(text[r.id], 3, simhash.SALTS, simhash.mix, n)
            assert r.fps[0] % 2**64 == brute.fingerprint(text[r.id], n)


def test_local_trees_find_every_link():
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(2500)]
    for _ in range(1500):  # links, chains of links and dense groups
        f = rnd.choice(fps)
        for bit in rnd.sample(range(64), rnd.randint(1, 4)):
            f ^= 1 << bit
        fps.append(f)
    fps = np.unique(np.array(fps, np.uint64))
    assert stars(simhash.local_stars(fps), fps) == brute.components(fps).tolist()
    tree = simhash.grow(fps, 1.0, shard_rows=400)
    dealt = [fps[at] for _, at in simhash.route(fps, tree)]
    assert sum(map(len, dealt)) == 4 * len(fps)  # four copies at any size
    assert len(dealt) > 4
    assert stars([p for part in dealt for p in simhash.local_stars(np.unique(part))], fps) == brute.components(fps).tolist()


def test_one_dense_group():
    """No vantage parts it: its bits deal it to shards, and no link is lost."""
    base = 0x0123456789ABCDEF
    fps = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)], np.uint64))
    assert len(set(stars(simhash.local_stars(fps), fps))) == 1
    rnd = random.Random(2)
    dense = np.unique(np.array([base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(3, 7))) for _ in range(3000)], np.uint64))
    tree = simhash.grow(dense, 1.0, shard_rows=900)
    dealt = [dense[at] for _, at in simhash.route(dense, tree)]
    assert len(dealt) > 3 and max(map(len, dealt)) < len(dense)
    assert stars([p for part in dealt for p in simhash.local_stars(np.unique(part))], dense) == brute.components(dense).tolist()


def test_blocks_deal_every_near_pair():
    rnd = random.Random(8)
    fps = np.array([rnd.getrandbits(64) for _ in range(2000)], np.uint64)
    near = np.array([int(f) ^ sum(1 << b for b in rnd.sample(range(64), 3)) for f in fps], np.uint64)
    both = np.concatenate((fps, near))
    tree = simhash.grow(both, 1.0, shard_rows=50)
    met = {i for _, at in simhash.route(both, tree) for i in set(at.tolist()) & {x - 2000 for x in at.tolist()}}
    assert len(met) == 2000


def test_trees_grow_as_deep_as_the_rows_ask():
    rnd = np.random.default_rng(1)
    sample = np.unique(rnd.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    dealt = list(simhash.route(sample, simhash.grow(sample, 10_000.0)))  # a sample of 200 million rows
    assert len({k for k, _ in dealt}) > 4000 and sum(len(at) for _, at in dealt) < 4.3 * len(sample)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 99), (98, 99), (-7, 98)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys((1, 2, 3, 98, 99, -7), -7) | {10: 10, 11: 10}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in connected_components(chain).collect()} == {0}


def test_classes_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    rows = sorted(sample_documents())
    label = brute.components([brute.fingerprint(t) for _, t, _, _ in rows])
    wanted = {r[0]: rows[k][0] for r, k in zip(rows, label, strict=True)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(documents).collect()} == wanted


def near_copies(rnd, n=60):
    rows = [(i, sentence(rnd, rnd.randint(60, 200))) for i in range(n)]
    for i in range(3 * n):  # copies with some changed words: similar, somewhat similar and hardly so
        words = rows[i % n][1].split()
        for _ in range(rnd.randint(1, 6)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_near_copies_against_brute_force(spark, monkeypatch):
    """No document goes that is not similar over links; nearly all that are go."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rows = near_copies(random.Random(11))
    label = brute.similar([t for _, t in rows])
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    first = {rows[k][0] for k in label}
    gone = len(rows) - len(first)
    assert first <= kept and gone > 50
    assert len(kept - first) <= 0.05 * gone


def test_candidates_are_few_for_each_text(spark):
    """A group of near copies gives a few pairs for each copy, not all pairs, and stays one class."""
    rnd = random.Random(5)
    base = sentence(rnd, 300).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(300)] = f"changed{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash.fingerprints(docs, shingle=5, tables=simhash.TABLES).selectExpr("mark as m", "fps").dropDuplicates(["fps"])
    pairs = simhash.candidates(nodes).count()
    assert pairs < 8 * nodes.count()
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [0]


def test_verified_pairs_have_the_similarity(spark):
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(9))), (3, list(range(1, 10)) + [99]), (4, [7])], "mark long, hashes array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long")
    assert {(r.a, r.b) for r in simhash.verified(pairs, sets, 0.8).collect()} == {(1, 2), (1, 3)}


def test_edge_cases(spark, odd, empty):
    assert simhash.near_duplicate_classes(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert simhash.near_duplicate_classes(odd).count() == odd.count()
    words = odd.withColumn("doc_id", odd["doc_id"].cast("string"))
    assert simhash.near_duplicate_classes(words).count() == odd.count() and simhash.one_of_each(words).count() == odd.count() - 2
    kept = simhash.one_of_each(odd)
    # the repeated row and the second of the two empty texts go; null ids and an id with two texts stay
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
