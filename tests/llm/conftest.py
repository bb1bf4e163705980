import random

import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def sample_documents():
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, rnd.randint(60, 240)), rnd.choice(["en", "fr"]), rnd.choice("abc")) for i in range(60)]
    text = rows[3][1]
    rows += [
        (100, text, "en", "a"),  # exact copies
        (101, text, "en", "b"),
        (102, text.replace(text.split()[40], "changed"), "en", "b"),  # a near copy
        (103, None, "en", "c"),
        (104, "", "fr", None),
        (105, " \t\n ", None, "a"),
        (106, "one", "en", "b"),
        (107, sentence(rnd, 50) + " " + " ".join(rows[5][1].split()[10:60]) + "\n" + sentence(rnd, 20), "en", "c"),
        (108, "same line here\n" * 40 + "### $$$ %%% <<<", "en", "c"),
        (109, "é ü 漢字 " * 60, "fr", "a"),
        (110, "a" * 5000, "en", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(sample_documents(), "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, repeated rows, one id with two texts, and columns whose names operators use inside."""
    rows = [(1, LONG, "en", "a"), (1, LONG, "en", "a"), (2, None, None, None), (None, "some words " * 30, "en", "a"), (None, "other words " * 30, "en", None), (3, "text one " * 40, "en", "b"), (3, "another text " * 40, "en", "b"), (4, "", "en", "b")]
    extra = "copies int, key string, h long, fp long, size int, row string, shard int, hit string, `__w` string, bucket int, `__source` string, place int"
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, "r", 5, "x", "w", 6, "s", 7) for r in rows], f"doc_id long, text string, lang string, source string, {extra}")
