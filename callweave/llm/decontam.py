"""Benchmark decontamination by spaced seeds.

A mask such as 110110111 looks at some tokens of a window and ignores the others, so a window still matches when
ignored tokens were substituted. All windows of the test items are hashed under every mask; documents are hashed
in the same way and looked up. Around each hit the whole item is laid over the document on the hit's diagonal,
and the overlap counts if some stretch of at least `least` tokens (or the whole of a shorter item) agrees in
`identity` of its tokens.

Tokens are lower-cased words without ASCII punctuation, compared by 64-bit hashes. The items are taken in blocks
of at most `block_chars` characters; each block's index is a bounded broadcast and all documents are read against
it, without any shuffle: a benchmark of several blocks costs as many reads of the documents.

Edge cases: null and empty texts and items match nothing; items of fewer tokens than a mask's span are sought
with a full mask of their own length, those of fewer than `shortest` tokens (too common within a text to tell a leak)
are found where they are a document's whole text; repeated items and documents are each reported; an empty benchmark reports nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, text_blocks

MASKS = ("110110111", "111011011", "101101111", "111100111")
LEAST, IDENTITY, SHORTEST = 13, 0.8, 5
BLOCK_CHARS = 4_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Index(NamedTuple):
    """Seeds of a block of items: per mask the sorted hashes with item and place; and the items' tokens."""

    ids: list
    tokens: np.ndarray
    starts: np.ndarray
    seeds: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]
    sieve: np.ndarray
    short: dict[tuple[int, ...], list[int]]


def _seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window start; windows may run over text ends, which callers leave out."""
    n = len(tokens) - len(mask) + 1
    total = np.full(max(n, 0), np.uint64(len(mask)))
    for i, bit in enumerate(mask):
        if bit == "1" and n > 0:
            total = total * _FACTOR + tokens[i : i + n]
    return mix(total)


def _inside(counts: np.ndarray, span: int, n: int) -> np.ndarray:
    """Whether the window at each of n starts stays within its text."""
    ends = np.cumsum(counts)
    return np.repeat(ends, counts)[:n] - np.arange(n) >= span


def build_index(items: list[tuple], masks: tuple[str, ...] = MASKS, shortest: int = SHORTEST) -> Index:
    """items: (id, text)."""
    texts = [t or "" for _, t in items]
    counts, tokens = hashed_words([t.lower() for t in texts]) if texts else (np.zeros(0, int), np.zeros(0, np.uint64))
    starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    span = max(map(len, masks))
    every = [(m, counts >= span) for m in masks] + [("1" * n, counts == n) for n in range(shortest, span)]
    seeds, sieve = [], np.zeros(1 << 20, bool)
    for mask, use in every:
        hashes = _seed_hashes(tokens, mask)
        ok = _inside(counts, len(mask), len(hashes)) & use[owner[: len(hashes)]]
        places = np.flatnonzero(ok)
        if len(places):
            order = np.argsort(hashes[places], kind="stable")
            places = places[order]
            seeds.append((mask, hashes[places], owner[places].astype(np.int32), (places - starts[owner[places]]).astype(np.int32)))
            sieve[(hashes[places] >> np.uint64(44)).astype(np.int64)] = True
    short: dict[tuple[int, ...], list[int]] = {}
    for k in np.flatnonzero((counts > 0) & (counts < shortest)):
        short.setdefault(tuple(tokens[starts[k] : starts[k + 1]].tolist()), []).append(int(k))
    return Index([i for i, _ in items], tokens, starts, seeds, sieve, short)


def _best_stretch(same: np.ndarray, least: int, identity: float) -> tuple[int, int] | None:
    """The longest stretch of at least `least` places that begins and ends with an agreement and agrees in `identity` of its places."""
    places = np.flatnonzero(same)
    # a stretch that a substitution cuts at its end counts with its agreeing part, if that is near the need
    most = max(1, int(np.ceil(identity * min(least, len(same)) - 1e-9)))
    if len(places) < most:
        return None
    # a stretch from the i-th to the j-th agreement holds j - i + 1 of places[j] - places[i] + 1: enough agree where
    # slack[i] <= slack[j] + 1 - identity; the running minimum falls, so it shows the first such i of every j
    last = np.arange(len(places))
    slack = last - identity * places
    first = np.searchsorted(-np.minimum.accumulate(slack), -(slack + 1 - identity + 1e-9), "left")
    j = int(np.argmax(last - first))
    i = int(first[j])
    if j - i + 1 < most:
        return None
    return int(places[i]), int(places[j]) + 1


def overlaps(texts: list[str], index: Index, least: int = LEAST, identity: float = IDENTITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, agreeing tokens, first and end token in the text) of the best overlap of each pair."""
    if not index.seeds and not index.short:
        return
    longest = max(map(len, index.short), default=0)
    for begin, end in text_blocks(texts):
        counts, tokens = hashed_words([t.lower() for t in texts[begin:end]])
        starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        found: set[tuple[int, int, int]] = set()
        for mask, hashes, item, place in index.seeds:
            have = _seed_hashes(tokens, mask)
            maybe = np.flatnonzero(index.sieve[(have >> np.uint64(44)).astype(np.int64)] & _inside(counts, len(mask), len(have)))
            low, high = np.searchsorted(hashes, have[maybe], "left"), np.searchsorted(hashes, have[maybe], "right")
            hit = high > low
            for at, a, b in zip(maybe[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                doc = int(owner[at])
                found.update((doc, int(item[k]), at - int(starts[doc]) - int(place[k])) for k in range(a, b))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, k, diagonal in found:
            wanted = index.tokens[index.starts[k] : index.starts[k + 1]]
            own = tokens[starts[doc] : starts[doc + 1]]
            first, last = max(0, -diagonal), min(len(wanted), len(own) - diagonal)
            same = np.zeros(len(wanted), bool)
            same[first:last] = wanted[first:last] == own[first + diagonal : last + diagonal]
            if stretch := _best_stretch(same, least, identity):
                agreed = int(same[stretch[0] : stretch[1]].sum())
                if agreed > best.get((doc, k), (0,))[0]:
                    best[doc, k] = (agreed, stretch[0] + diagonal, stretch[1] + diagonal)
        for doc in np.flatnonzero((counts > 0) & (counts <= longest)).tolist():
            n = int(counts[doc])
            best |= {(doc, k): (n, 0, n) for k in index.short.get(tuple(tokens[starts[doc] : starts[doc + 1]].tolist()), ())}
        for (doc, k), (agreed, a, b) in sorted(best.items()):
            yield begin + doc, k, agreed, a, b


def item_blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items, collected in blocks of bounded size; together they are the stated query set."""
    rows = benchmark.select(F.col(item).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars))
    for k in range(blocks):
        # dealt by hash, so blocks stay near half the bound
        yield [(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, identity: float = IDENTITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, agreed, first_word, end_word): one row per document and item that it holds."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out: DataFrame | None = None
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    for items in item_blocks(benchmark, item, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(items))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = list(overlaps([t or "" for t in batch.column("text").to_pylist()], index, least, identity))
                if rows:
                    at, k, agreed, a, b = map(list, zip(*rows, strict=True))
                    words = [int(index.starts[x + 1] - index.starts[x]) for x in k]
                    yield pa.RecordBatch.from_pydict({
                        "key": batch.column("key").take(pa.array(at)), "item": pa.array([index.ids[x] for x in k]), "item_words": pa.array(words, pa.int64()),
                        "agreed": pa.array(agreed, pa.int64()), "first_word": pa.array(a, pa.int64()), "end_word": pa.array(b, pa.int64()),
                    })

        part = slim.mapInArrow(scan, f"key {kinds[0]}, item {kinds[1]}, item_words long, agreed long, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item})


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, identity: float = IDENTITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item; they pass through whole, without a shuffle."""
    for items in item_blocks(benchmark, item, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(items))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaky = {x[0] for x in overlaps([t or "" for t in batch.column(text).to_pylist()], shared.value, least, identity)}
                yield batch.filter(pa.array([i not in leaky for i in range(batch.num_rows)])) if leaky else batch

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
