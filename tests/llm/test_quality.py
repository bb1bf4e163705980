import math

import numpy as np
from pyspark.sql import functions as F

from callweave.llm import quality

from ..compare import SF, difference, duck
from . import brute
from .conftest import sample_documents


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_equal_plain_ones(spark, documents):
    got = {r.doc_id: r for r in quality.judge_quality(documents, labels(spark, [])).collect()}
    for d, t, _, _ in sample_documents():
        r, (n, chars, symbols, lines, repeats) = got[d], brute.stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed)  # without labels no cutoff is safe


def test_sorting_and_scanning_agree(spark, documents, monkeypatch):
    a = {r.doc_id: r.n_repeat_words for r in quality.text_stats(documents).collect()}
    monkeypatch.setattr(quality, "FEW_REPEATS", 0)
    assert a == {r.doc_id: r.n_repeat_words for r in quality.text_stats(documents).collect()}


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (100, 0), (500, 2), (900, 8), (900, 9), (50, 0)]
    rows = spark.createDataFrame([(float(n), k) for n, k in cases], "n double, k long").select("n", "k", quality.log_binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in rows:
        wanted = math.log(brute.binomial_tail(int(r.n), r.k, 0.01)) if r.k < r.n * 0.01 else 0.0
        assert abs(r.p - wanted) < 1e-9


def test_cutoffs_hold_the_risk(spark):
    """Good documents without symbols make a strict cutoff safe; a stratum with many good ones above it keeps them."""
    clean = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    noisy = lambda i: " ".join(f"w{i}#{k}" for k in range(80))
    rows = [(i, clean(i), "en", "s") for i in range(3000)] + [(i, noisy(i), "en", "s") for i in range(3000, 3020)]
    rows += [(i, clean(i) if i % 2 else noisy(i), "fr", "s") for i in range(4000, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    marks = labels(spark, [(i, 1, 0) for i in range(3000)] + [(i, 0, 0) for i in range(3000, 3020)] + [(i, 1, 0) for i in range(4000, 6000)])
    out = quality.judge_quality(docs, marks)
    assert out.where("doc_id < 3000 and not kept").count() == 0
    assert out.where("doc_id between 3000 and 3019 and kept").count() == 0
    assert out.where("doc_id >= 4000 and not kept").count() == 0
    assert {r.doc_id for r in quality.accepted(docs, marks).collect()} == {r.doc_id for r in out.where("kept").collect()}


def test_levels_only_tighten():
    assert len({len(x) for x in quality.LEVELS.values()}) == 1
    assert all(list(x) == sorted(x, reverse=True) for x in quality.LEVELS.values())


def test_levels_stop_at_the_first_failure(spark):
    """Against exact tails; the fourth level would pass again by itself, but the sequence has ended."""
    rows = [("a", 1000, [0, 5, 40, 0]), ("b", 100, [0, 0, 0, 0]), (None, 150, [0, 0, 0, 0]), ("c", 5000, [0, 50, 90, 120])]
    got = {r.stratum: r.level for r in quality.safe_levels(spark.createDataFrame(rows, "stratum string, n long, k array<long>"), 4).collect()}
    want = {}
    for s, n, ks in rows:
        level = -1
        while level < 3 and ks[level + 1] < n * quality.ALPHA and brute.binomial_tail(n, ks[level + 1], quality.ALPHA) <= quality.DELTA / len(rows):
            level += 1
        if level >= 0:
            want[s] = level
    assert got == want == {"a": 1, "c": 2}


def test_risk_is_limited_over_many_holdouts(spark):
    """Holdouts drawn from known risks: at most about DELTA of them may lead to a level whose true risk is above ALPHA."""
    rnd, risks = np.random.default_rng(3), [0.0, 0.01, 0.02, 0.03, 0.06]
    draws = []
    for i in range(600):
        n = int(rnd.integers(150, 1500))
        first = np.searchsorted(risks, rnd.random(n))  # the first level that rejects each good document
        draws.append((str(i), n, [int((first <= k).sum()) for k in range(len(risks))]))
    chosen = quality.safe_levels(spark.createDataFrame(draws, "stratum string, n long, k array<long>"), len(risks), strata=1).collect()
    violated = sum(risks[r.level] > quality.ALPHA for r in chosen)
    assert len(chosen) > 500 and violated <= quality.DELTA * 600 + 3 * math.sqrt(600 * quality.DELTA)
    assert sum(risks[r.level] > 0 for r in chosen) > 100  # and the bound is not so wide that nothing passes


def test_query_with_levels_that_act_equals_sql(spark):
    from callweave.llm import queries

    out = queries.op9_quality_rules(spark, SF)
    assert out.where("not kept and not base_failed").count() > 0  # a level is applied on these tables
    assert difference(out, queries.oracle_sql()["op9_quality_rules"], duck()) == ""


def test_main_path_is_native(documents, spark):
    plan = quality.accepted(documents, labels(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_cases(spark, odd, empty):
    marks = labels(spark, [(1, 1, None), (1, 1, 0), (None, 1, 0), (2, None, None)])
    assert quality.judge_quality(empty, marks).count() == 0 and quality.accepted(empty, marks).count() == 0
    assert quality.judge_quality(odd, marks).count() == odd.count()
    assert quality.accepted(odd, marks).columns == odd.columns
