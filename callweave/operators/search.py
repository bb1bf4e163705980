"""Search over landed texts: an inverted index with frequencies, ranked answers, and new candidates from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .ranking import top_per_group

K1, B = 1.2, 0.75  # fixed values: the usual constants of BM25


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, repeats included; null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, size): one row a term and document. Rows that repeat a key count as one text each, added up.

    A document's texts meet once, by key, and its words are counted within its row as runs of the sorted words; `size` is the
    document's number of words.
    """
    whole = docs.groupBy(key).agg(F.array_join(F.collect_list(F.col(text)), " ").alias("_text"))
    words = whole.select(key, F.sort_array(terms(F.col("_text"))).alias("w"))
    ends = F.transform("w", lambda w, i: F.when((i == F.size("w") - 1) | (w != F.get(F.col("w"), i + 1)), i + 1))  # null within a run
    runs = words.select(key, "w", F.array_compact(ends).alias("e"))
    counted = F.transform("e", lambda e, i: F.struct(F.get(F.col("w"), e - 1).alias("term"), (e - F.coalesce(F.get(F.col("e"), i - 1), F.lit(0))).cast("long").alias("tf")))
    return runs.select(key, F.size("w").cast("long").alias("size"), F.explode(counted).alias("x")).select("x.term", key, "x.tf", "size")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term stands."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def weighed(index: DataFrame, key: str, docs: int, mean: float) -> DataFrame:
    """(term, key, weight): what a term adds to a document's score. `docs` and `mean` are the number of documents with words
    and their mean size (`collection`). Built once, kept as a table, and asked many times."""
    idf = F.log(1 + (F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    near = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(float(mean))))
    return index.join(frequencies(index), "term").select("term", key, (idf * near).alias("weight"))


def collection(index: DataFrame, key: str) -> tuple[int, float]:
    """Number of documents and their mean size: one row."""
    row = index.select(key, "size").distinct().agg(F.count("*"), F.avg("size")).first()
    return int(row[0]), float(row[1] or 1.0)


def asked_terms(asked: DataFrame, text: str) -> DataFrame:
    """(term): the different words of all queries. An index that keeps these rows gives the same weights and answers."""
    return asked.select(F.explode(terms(F.col(text))).alias("term")).distinct()


QUERIES, DOCS = 256, 2048  # queries and documents that meet in one cell


def _best(asked: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, key, score) of one cell: what can be among the k best when scores are rounded to six places later.

    `asked` is (query, term), `found` (term, key, weight). Scores are kept as a matrix, a term's weights added to the rows of
    its queries. Of documents with one and the same score only the k smallest keys can be needed.
    """
    query, queries = pd.factorize(asked["query"])
    doc, docs = pd.factorize(found["key"], sort=True)
    term, names = pd.factorize(asked["term"])
    of = pd.Index(names).get_indexer(found["term"])
    order, turn = np.argsort(of, kind="stable"), np.argsort(term, kind="stable")
    doc, weight, query = doc[order], found["weight"].to_numpy()[order], query[turn]
    low, high = (np.searchsorted(of[order], np.arange(len(names)), side) for side in ("left", "right"))
    first, last = (np.searchsorted(term[turn], np.arange(len(names)), side) for side in ("left", "right"))
    scores = np.zeros((len(queries), len(docs)))
    for i in np.flatnonzero(high > low):
        at = slice(low[i], high[i])
        scores[query[first[i] : last[i]]] += np.bincount(doc[at], weight[at], len(docs))
    rows, best = [np.empty(0, "int64")], [np.empty(0, "int64")]
    for i, row in enumerate(scores):
        met = np.flatnonzero(row > 0)
        if len(met) > k:
            met = met[row[met] >= np.partition(row[met], len(met) - k)[len(met) - k] - 2e-6]
        met = met[np.lexsort((met, -row[met]))]
        alike = np.searchsorted(-row[met], -row[met])  # where the documents of the same score begin
        met = met[np.arange(len(met)) - alike < k]
        rows.append(np.full(len(met), i))
        best.append(met)
    at, of_doc = np.concatenate(rows), np.concatenate(best)
    return pd.DataFrame({"query": queries[at], "key": docs[of_doc], "score": scores[at, of_doc]})


def top_k(asked: DataFrame, query: str, text: str, weights: DataFrame, key: str, k: int, salts: int = 16) -> DataFrame:
    """(query, key, score, place): the k best documents of each query by BM25, ties by the smaller key.

    Queries and documents meet in cells of about `QUERIES` queries and one of `salts` parts of the documents (`parts`): a term
    that stands in a third of all documents is dealt over all cells, a document's terms meet in one and its score is summed
    there. A cell holds its own queries and documents only and hands on its best; rounding and the last choice are Spark's.
    Only postings of asked terms move; a repeated word of a query counts once.
    """
    words = asked.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).distinct()
    blocks = -(-words.select("query").distinct().count() // QUERIES)
    words = words.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))).cast("int"))
    dealt = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    part = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
    found = weights.select("term", F.col(key).alias("key"), "weight", part.alias("salt")).join(words.select("term", F.col("block").alias("to")).distinct(), "term")
    kinds = dict(asked.dtypes)[query], dict(weights.dtypes)[key]
    cells = dealt.groupBy("block", "salt").cogroup(found.groupBy("to", "salt"))
    best = cells.applyInPandas(lambda q, d: _best(q, d, k), f"query {kinds[0]}, key {kinds[1]}, score double")
    scored = best.select(F.col("query").alias(query), F.col("key").alias(key), F.round("score", 6).alias("score"))
    return top_per_group(scored, [query], [F.desc("score"), F.asc(key)], k)


def parts(docs: int) -> int:
    """Into how many parts to deal so many documents, so that a cell stays as large however many there are."""
    return max(16, -(-docs // DOCS))


#: Wording by which a found title is a call.
CALLS = ("call for proposal", "call for application", "request for proposal", "request for application", "request for expression", "expression of interest", "funding opportunity", "request for information", "notice of funding", "grant", "rfp", "rfa", "eoi", "tender")


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w))
    return found


def relevance(title: Column, snippet: Column, asked: Column, deadline: Column, page_date: Column) -> Column:
    """3 for each different word of three letters or more that the title contains, else 1 if the snippet does; 4 for a call's
    wording in the title; 3 for a deadline, else 1 for a page date."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(asked, F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1)))
    head, body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(snippet, F.lit("")))
    points = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(F.contains(head, w), 3.0).when(F.contains(body, w), 1.0).otherwise(0.0))
    return points + F.when(has_any(title, CALLS), 4.0).otherwise(0.0) + F.when(deadline.isNotNull(), 3.0).when(page_date.isNotNull(), 1.0).otherwise(0.0)


def discovered(found: DataFrame, known: DataFrame, republishers: Sequence[str], most: int | None = None) -> DataFrame:
    """New candidates from ranked answers (query, place, title, link): one row a link, its best place over all queries (ties by
    query); links without http go, as do those that the store refreshed lately (`known`: link). The funder is guessed from
    the host, but never from a republisher's, which is marked an aggregator. `most` bounds the sweep, best places first."""
    link = F.regexp_replace(F.regexp_replace(F.trim("link"), "#.*$", ""), "/$", "")
    rows = found.withColumn("link", link).where(F.lower("link").startswith("http"))
    best = rows.groupBy("link").agg(F.min_by(F.struct("place", "query", "title"), F.struct("place", "query")).alias("x")).select("link", "x.*")
    fresh = best.join(known.select(urls.uid(F.col("link")).alias("_uid")).distinct(), urls.uid(F.col("link")) == F.col("_uid"), "left_anti")
    second = urls.host_in(urls.host(F.col("link")), republishers)
    funder = F.when(~second, F.initcap(F.replace(F.split(urls.host(F.col("link")), r"\.")[0], F.lit("-"), F.lit(" "))))
    rows = fresh.select("link", "title", "query", "place", funder.alias("funder"), F.when(second, "aggregator").otherwise("primary").alias("class"))
    return rows.orderBy("place", "query", "link").limit(most) if most else rows
