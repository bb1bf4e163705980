from pyspark.sql import functions as F

from callweave.llm import mixing

from .brute import water_fill, words
from .conftest import sample_documents


def test_targets_and_takings(spark, documents):
    got = {r.doc_id: r for r in mixing.mix(documents).collect()}
    rows = sample_documents()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    wanted = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert len(got) == len(rows)
    for d, t, _, s in rows:
        assert (got[d].size, got[d].source_size) == (len(words(t)), sizes[s])
        assert abs(got[d].target - wanted[s]) < 1e-6 * max(1, wanted[s])
        assert got[d].taken <= 2 * got[d].size and got[d].taken % max(1, got[d].size) == 0
    for s in sizes:
        taken = sum(got[d].taken for d, _, _, x in rows if x == s)
        assert abs(taken - wanted[s]) <= max((len(words(t)) for _, t, _, x in rows if x == s), default=0) / 2 + 1


def test_reruns_agree_and_rows_repeat(spark, documents):
    plan = {(r.doc_id, r.copies) for r in mixing.mix(documents).collect()}
    assert plan == {(r.doc_id, r.copies) for r in mixing.mix(documents.repartition(5)).collect()}
    rows = mixing.mixed_rows(documents)
    assert rows.columns == documents.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in plan if n}


def test_many_buckets_give_the_same_shape(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    rows = mixing.mix(documents).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1 for r in rows)


def test_edge_cases(spark, odd, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 2 * r.size for r in out)
    assert mixing.mixed_rows(odd).columns == odd.columns
    only_empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(only_empty).collect()] == [0, 0]
