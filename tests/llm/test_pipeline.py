import corpus_pipeline

from callweave.llm import decontam, pii, quality
from callweave.llm.queries import oracle_sql, queries

from ..compare import SF, difference, duck
from . import brute


def rows(spark, df):
    """Written and read again, as the pipeline does it."""
    from callweave.llm.common import stored

    return stored(df, "test")


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    (_, rules), (_, near), (_, leaks), (_, personal), (_, mixed) = corpus_pipeline.STAGES

    kept = rows(spark, rules(spark, docs, SF))
    assert kept.columns == columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.judge_quality(docs, labels).where("kept").collect()}

    one = rows(spark, near(spark, kept, SF))
    texts = sorted((r.doc_id, r.text) for r in kept.collect())
    label = brute.similar([t for _, t in texts])
    firsts, stay = {texts[k][0] for k in label}, {r.doc_id for r in one.collect()}
    assert one.columns == columns
    assert firsts <= stay and len(stay - firsts) <= 0.05 * (len(texts) - len(firsts))  # none goes wrongly, nearly all near copies go

    clean = rows(spark, leaks(spark, one, SF))
    items = [r.text for r in bench.collect()]
    left, before = {r.doc_id for r in clean.collect()}, {r.doc_id: r.text for r in one.collect()}
    assert clean.columns == columns
    assert {d for d, t in before.items() if any(x in t for x in items)} <= set(before) - left
    assert set(before) - left == {r.doc_id for r in decontam.find_leaks(one, bench).collect()}

    safe = rows(spark, personal(spark, clean, SF))
    assert safe.columns == columns
    for r in safe.collect():
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == pii.redact(before[r.doc_id])

    sizes: dict = {}
    last = [(r.doc_id, len(brute.words(r.text)), r.source) for r in safe.collect()]
    for _, n, s in last:
        sizes[s] = sizes.get(s, 0) + n
    target = brute.water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
    taken: dict = {}
    for r in mixed(spark, safe, SF).collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    most = {s: max(n for _, n, x in last if x == s) for s in sizes}
    assert all(abs(taken.get(s, 0) - target[s]) <= most[s] / 2 + 1 for s in sizes)


def test_stages_take_empty_and_odd_tables(spark, empty, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).columns == empty.columns
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).columns == odd.columns


def test_queries_of_this_subpackage(spark):
    con = duck()
    for name, sql in oracle_sql().items():
        assert difference(queries()[name](spark, SF), sql, con) == "", name
