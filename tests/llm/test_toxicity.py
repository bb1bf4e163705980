import math
import random
import zlib

import numpy as np

from callweave.llm import toxicity

from .conftest import sentence


def tables(spark, n=900):
    rnd = random.Random(6)
    bad = ["grumbol", "snarfix", "vextor"]
    rows, marks = [], []
    for i in range(n):
        words, toxic = sentence(rnd, rnd.randint(20, 80)).split(), int(rnd.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = toxicity.judge_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.toxic for r in held)
    assert len(held) > 150 and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels = tables(spark, 300)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def plain_pass(z, n, rows):
    """FTRL-proximal by its formulas, a coordinate at a time; z and n are dicts, -1 is the bias."""
    for places, y in rows:
        w = {}
        for i in places:
            zi = z.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= toxicity.L1 else -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.SMOOTH + math.sqrt(n.get(i, 0.0))) / toxicity.RATE + toxicity.L2)
        w[-1] = -z.get(-1, 0.0) / ((toxicity.SMOOTH + math.sqrt(n.get(-1, 0.0))) / toxicity.RATE)
        g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
        for i, wi in w.items():
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.RATE * wi
            n[i] = old + g * g


def test_weights_equal_plain_ftrl(spark):
    docs, labels = tables(spark, 240)
    text, label = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    keys = sorted(i for i in text if zlib.crc32(str(i).encode()) % 4 != 2)
    shards = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.shard_of(docs["doc_id"]).alias("s")).collect()}
    z, n = {}, {}
    for turn in range(toxicity.ROUNDS):
        states = []
        for s in range(toxicity.SHARDS):
            own = [k for k in keys if shards[k] == s]
            order = np.random.default_rng(turn).permutation(len(own))
            a, b = dict(z), dict(n)
            plain_pass(a, b, [(toxicity.distinct_features([text[own[i]]])[0].tolist(), label[own[i]]) for i in order])
            states.append((a, b))
        z, n = ({i: sum(x[k].get(i, 0.0) for x in states) / toxicity.SHARDS for i in set().union(*(x[k] for x in states))} for k in (0, 1))
    model = toxicity.train(docs, labels)
    want = np.zeros(1 << toxicity.BITS)
    for i, zi in z.items():
        if i >= 0 and abs(zi) > toxicity.L1:
            want[i] = -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.SMOOTH + math.sqrt(n[i])) / toxicity.RATE + toxicity.L2)
    assert np.count_nonzero(want) > 5 and np.abs(model.weights - want).max() < 1e-5
    bias = -z[-1] / ((toxicity.SMOOTH + math.sqrt(n[-1])) / toxicity.RATE)
    assert abs(model.bias - bias) < 1e-6
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k in keys[:20]:
        total = bias + sum(want[i] for i in set(toxicity.distinct_features([text[k]])[0].tolist()))
        assert abs(scored[k] - 1 / (1 + math.exp(-total))) < 1e-5


def test_each_shard_trains_in_its_own_task(spark):
    docs, _ = tables(spark, 400)
    dealt = docs.select(toxicity.shard_of(docs["doc_id"]).alias("shard")).repartitionById(toxicity.SHARDS, "shard")
    held = [set(x) for x in dealt.rdd.map(lambda r: r.shard).glom().collect() if x]
    assert len(held) == toxicity.SHARDS and all(len(x) == 1 for x in held)


def test_several_labels_of_one_document(spark):
    docs, labels = tables(spark, 200)
    mixed = labels.unionByName(labels.selectExpr("doc_id", "quality", "0 as toxic"))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, mixed)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_weights_are_sparse(spark):
    model = toxicity.train(*tables(spark))
    assert 0 < (model.weights != 0).sum() < 0.1 * len(model.weights)


def test_edge_cases(spark, odd, empty):
    docs, labels = tables(spark, 300)
    none = labels.limit(0)
    assert toxicity.judge_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.judge_toxicity(odd, none).collect()} == {toxicity.judge_toxicity(odd, none).first().score}
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    out = toxicity.judge_toxicity(odd.select("doc_id", "text", "key", "place"), twice).collect()
    assert len(out) == odd.count() and not any(r.held_out for r in out if r.doc_id is None)


def test_rows_that_repeat_an_id_train_once(spark):
    docs, labels = tables(spark, 200)
    again = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 6 = 0"))
    a, b = toxicity.train(docs, labels), toxicity.train(again, labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias
