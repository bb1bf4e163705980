"""Areas of texts by a vocabulary of terms with word edges, read in one pass of an automaton over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 8_000_000  # of all terms together: beyond it no task holds the vocabulary, and terms meet texts on their first words
UNSPECIFIED = "Unspecified Program Area"  # fixed value


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def standing(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] has word edges on both sides."""
    first = _word(text[start - 1]) if start else False
    last = _word(text[end]) if end < len(text) else False
    return first != _word(text[start]) and last != _word(text[end - 1])


def _automaton(words: Iterator[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def _stands_in(text: str, automaton) -> set[str]:
    low = text.lower()
    return {w for end, w in automaton.iter(low) if standing(low, end - len(w) + 1, end + 1)} if len(automaton) else set()


def term_hits(docs: DataFrame, key: str, text: str, terms: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, area, term): each term that stands in the text, whatever its case, once a row of docs.

    `terms` has (area, term); blank terms and those without a letter or digit are passed over, repeats count once. Up to
    `most_chars` the vocabulary goes to every task as one automaton; beyond it, terms meet the texts' words on their first
    word and only the candidates are looked up. Both give the same rows. Null and empty texts have no hit.
    """
    low = F.lower(F.trim("term"))
    vocabulary = terms.select("area", F.col("term"), low.alias("low")).where(F.regexp_like("low", F.lit(r"[\p{L}\p{N}_]"))).distinct()
    size = vocabulary.select("low").distinct().agg(F.coalesce(F.sum(F.length("low")), F.lit(0))).first()[0]
    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    if size <= most_chars:
        words = docs.sparkSession.sparkContext.broadcast([r[0].lower() for r in vocabulary.select("low").distinct().collect()])  # checked above

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(words.value)
            for batch in batches:
                rows = [(k, w) for k, t in zip(batch["key"], batch["text"], strict=True) for w in sorted(_stands_in(t, automaton))]
                yield pd.DataFrame(rows, columns=["key", "low"])

        hits = slim.mapInPandas(scan, f"key {kind}, low string")
    else:
        runs = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
        numbered = slim.withColumn("row", F.monotonically_increasing_id())
        from ..sources.tables import scratch

        path = scratch(docs.sparkSession, "texts")  # written, so that a lost executor gives no row another number
        numbered.write.parquet(path)
        kept = docs.sparkSession.read.parquet(path)
        firsts = vocabulary.select("low", runs(F.col("low"))[0].alias("word")).distinct()
        words_of = kept.select("row", F.explode(F.array_distinct(runs(F.lower("text")))).alias("word"))
        asked = words_of.join(firsts, "word").groupBy("row").agg(F.collect_set("low").alias("lows"))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(k, w) for k, t, ws in zip(batch["key"], batch["text"], batch["lows"], strict=True) for w in sorted(_stands_in(t, _automaton(ws)))]
                yield pd.DataFrame(rows, columns=["key", "low"])

        hits = kept.join(asked, "row").select("key", "text", "lows").mapInPandas(look, f"key {kind}, low string")
    return hits.join(vocabulary, "low").select(F.col("key").alias(key), "area", "term")


def areas(docs: DataFrame, key: str, text: str, terms: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, areas): every area with a term in the text, by the smallest `place` of its terms, then name; UNSPECIFIED if none.
    Rows that repeat a key share their areas."""
    order = terms.groupBy("area").agg(F.min("place").alias("place"))
    hits = term_hits(docs, key, text, terms, most_chars).select(key, "area").distinct().join(order, "area")
    found = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "area"))), lambda x: x["area"]).alias("areas"))
    rest = docs.select(key).distinct().alias("d").join(found.alias("f"), F.col(f"d.{key}").eqNullSafe(F.col(f"f.{key}")), "left")
    return rest.select(F.col(f"d.{key}").alias(key), F.coalesce("f.areas", F.array(F.lit(UNSPECIFIED))).alias("areas"))


def area_counts(found: DataFrame) -> DataFrame:
    """(area, rows): in how many rows each area stands, once a row, its "PREFIX - " taken off; areas that are equal then are one."""
    bare = F.array_distinct(F.transform("areas", lambda a: F.regexp_replace(a, r"^[^-]{1,12} - ", "")))
    return found.select(F.explode(bare).alias("area")).groupBy("area").agg(F.count("*").alias("rows"))
