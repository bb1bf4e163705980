import random

import numpy as np

from callweave.llm import decontam

from .conftest import sentence


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def tables(spark):
    rnd = random.Random(8)
    bench = [(i, sentence(rnd, rnd.randint(15, 50))) for i in range(12)] + [(50, sentence(rnd, 6)), (51, "two words"), (52, None), (53, "")]
    docs, wanted = [], set()
    for d in range(60):
        words = sentence(rnd, rnd.randint(40, 300)).split()
        if d % 3 == 0:
            i, text = bench[d % 12]
            own = text.split()
            for k in range(4, len(own), 9):  # substitutions, one in nine
                own[k] = "zzz"
            own[0] = own[0].upper() + ","
            at = rnd.randint(0, len(words))
            words[at:at] = own
            wanted.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(100, "start " + bench[12][1].title() + "! end"), (101, None), (102, ""), (103, "two words two words")]
    return docs, bench, wanted | {(100, 50)}


def test_substituted_passages_are_found_and_others_left(spark):
    docs, bench, wanted = tables(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontam.find_leaks(frame, items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted
    assert all(r.agreed <= r.item_words and r.first_word < r.end_word for r in found)
    kept = decontam.without_leaks(frame, items(spark, bench))
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in wanted}


def test_blocks_of_items_change_nothing(spark):
    docs, bench, wanted = tables(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, items(spark, bench), block_chars=600).collect()} == wanted
    assert decontam.without_leaks(frame, items(spark, bench), block_chars=600).count() == len(docs) - len({d for d, _ in wanted})


def test_overlaps_equal_a_plain_search():
    """Without substitutions, an item is found exactly where its words stand in a row."""
    rnd = random.Random(3)
    bench = [(i, " ".join(rnd.choice("abcdefghij") * 3 for _ in range(20))) for i in range(5)]
    index = decontam.build_index(bench)
    texts = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(40)]
    for k in range(0, 40, 4):
        texts[k] = f"{texts[k]} {bench[k % 5][1]} tail"
    found = {(t, k) for t, k, agreed, _, _ in decontam.overlaps(texts, index) if agreed == 20}
    assert found == {(t, k) for t, x in enumerate(texts) for k, (_, b) in enumerate(bench) if b in x}


def test_longest_stretch_equals_a_search_of_all():
    rnd = random.Random(4)
    for _ in range(400):
        same = np.array([rnd.random() < rnd.choice((0.3, 0.75, 0.95)) for _ in range(rnd.randint(1, 60))])
        places, need = np.flatnonzero(same), min(decontam.LEAST, len(same))
        good = [(j - i + 1, -i, i, j) for i in range(len(places)) for j in range(i, len(places)) if j - i + 1 >= decontam.IDENTITY * max(places[j] - places[i] + 1, need) - 1e-9]
        wanted = (int(places[max(good)[2]]), int(places[max(good)[3]]) + 1) if good else None
        assert decontam._best_stretch(same, decontam.LEAST, decontam.IDENTITY) == wanted


def test_a_very_long_item_needs_little_memory():
    rnd = random.Random(5)
    item = sentence(rnd, 60_000)
    index = decontam.build_index([(1, item)])
    found = {k: agreed for _, k, agreed, _, _ in decontam.overlaps([f"before {item} after"], index)}
    assert found == {0: 60_000}


def test_edge_cases(spark, odd, empty):
    bench = items(spark, [(1, "lorem ipsum dolor sit amet consectetur lorem"), (1, "lorem ipsum dolor sit amet consectetur lorem")])
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.without_leaks(empty, bench).count() == 0
    none = items(spark, [])
    assert decontam.find_leaks(odd, none).count() == 0 and decontam.without_leaks(odd, none).count() == odd.count()
    assert {r.doc_id for r in decontam.find_leaks(odd, bench).collect()} == {1}
    assert decontam.without_leaks(odd, bench).columns == odd.columns


def test_items_of_few_words_are_found_as_whole_texts(spark):
    docs = spark.createDataFrame([(1, "What is love?"), (2, "so what is love then, I ask"), (3, "yes"), (4, ""), (5, None), (6, "what is  love")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "what is love"), (11, "Yes!"), (12, "what is love"), (13, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    assert found == {(1, 10), (1, 12), (6, 10), (6, 12), (3, 11)}
    assert {r.doc_id for r in decontam.without_leaks(docs, items).collect()} == {2, 4, 5}


def test_texts_with_nul(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words.replace(" ", "\0", 3)), (2, "\0\0"), (3, words)], "doc_id long, text string")
    items = spark.createDataFrame([(10, words), (11, "\0")], "item_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(docs, items).collect()} == {1, 3}
