"""Periodic runs of words: every maximal stretch that repeats itself at least four times, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, times * q) that no
neighbouring word extends. Shifted by q, a run covers itself with an overlap of its length minus q, so all its words
lie in k-grams that occur twice in the document, where k is the least such overlap: min over q of
max(least, times * q) - q, which is 5 for 6 words and 4 times. Words outside of repeated k-grams are masked; they can
join no run. Main and Lorentz' search works on the segments that are left: a segment is halved again and again; a run
that crosses a middle holds two periods on one side of it, so equal neighbouring blocks that touch the middle give its
period, and its two ends are found by the longest common extensions. All segments of a batch are halved together, a
level at a time, so a step is a few array operations at n log n in all. Equal blocks are first found by hashes of
words, and each run is then compared word by word.

Each document is read once, in the task that scans it; nothing is shuffled, and a task holds one batch of texts.

Edge cases: a null or an empty text has no words, no run, and the digests of empty strings; rows that repeat are judged
each for itself; a null id is kept and plants nothing; of runs with equal exponent the one that starts first is shown,
then that of the smaller period; columns other than id and text do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, powers

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Words of one step of a task; a longer text is a step of its own.
STEP_WORDS = 1 << 19

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def least_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The smallest overlap of a run with itself when shifted by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start s and size n the numbers s .. s + n - 1, and the place of their range."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


class Words:
    """Word numbers of some documents one after the other, with hashes of any stretch."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.up, self.down = powers(len(ids) + 1)
        spread = mix(ids.astype(np.uint64) + np.uint64(0x51ED27))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * self.up[: len(ids)], dtype=np.uint64)))

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def extensions(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Longest common extension of the places a and b, forward (step 1) or backward from the words before them (-1)."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            back = mid if step < 0 else 0
            same = self.hashes(a[open_] - back, mid) == self.hashes(b[open_] - back, mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1


def surviving_segments(words: Words, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches that are covered by k-grams which their document repeats."""
    n = len(owner)
    if n <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    keys = mix(words.hashes(at, k) + mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.cumsum(np.bincount(at[again], minlength=n + 1) - np.bincount(at[again] + k, minlength=n + 1))[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    # two documents that touch are parted
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    inner = cuts[np.searchsorted(start, cuts, "right") - 1 >= 0] if len(start) else cuts[:0]
    inner = inner[inner < end[np.searchsorted(start, inner, "right") - 1]]
    inner = inner[~np.isin(inner, start)]
    return np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((end, inner)))


def crossing(words: Words, first: np.ndarray, last: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, segment) of equal neighbouring blocks that touch the middle of a part, as parts are halved level by level.

    A run of `times` >= 4 periods that crosses a middle has two whole periods on one of its sides.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may have no two periods on one side of a middle")
    low, high, segment = first, last, np.arange(len(first))
    while len(low):
        mid = (low + high) // 2
        for right in (True, False):
            room = (high - mid if right else mid - low) // 2
            period, part = _ranges(np.ones(len(low), np.int64), np.minimum(room, (last - first)[segment] // times))
            at = mid[part] if right else mid[part] - 2 * period
            same = words.hashes(at, period) == words.hashes(at + period, period)
            yield at[same], period[same], segment[part[same]]
        halves = np.concatenate((low, mid)), np.concatenate((mid, high)), np.concatenate((segment, segment))
        open_ = halves[1] - halves[0] > 2
        low, high, segment = (x[open_] for x in halves)


def maximal_runs(ids: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> Runs:
    """(start, length, period) of all runs of the documents, by start, then period; `owner` numbers the words' documents."""
    words = Words(ids)
    first, last = surviving_segments(words, owner, least_overlap(least, times))
    long = last - first >= least
    first, last = first[long], last[long]
    found = [np.zeros((0, 3), np.int64)]
    for at, period, segment in crossing(words, first, last, times):
        after = words.extensions(at, at + period, last[segment] - at - period, 1)
        before = words.extensions(at, at + period, at - first[segment], -1)
        start, length = at - before, before + after + period
        enough = length >= np.maximum(least, times * period)
        found.append(np.unique(np.stack((start[enough], length[enough], period[enough]), 1), axis=0))
    # a run is found by each multiple of its period, too: with the same ends, of which the least period stays
    rows = np.unique(np.concatenate(found), axis=0)
    one = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, bool)
    rows = rows[one]
    true = [np.array_equal(ids[s : s + n - q], ids[s + q : s + n]) for s, n, q in rows.tolist()]
    rows = rows[np.array(true, bool)]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def repeated(runs: Runs, n: int) -> np.ndarray:
    """Which of n words any run contains after its first period."""
    start, length, period = runs
    return np.cumsum(np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1))[:n] > 0


def word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal words, and the document of each word."""
    seen: dict[bytes, int] = {}
    counts = [len(t) for t in texts]
    number = seen.setdefault
    ids = np.fromiter((number(w, len(seen)) for t in texts for w in t), np.int64, sum(counts))
    return ids, np.repeat(np.arange(len(texts)), counts)


Rewrite = Callable[[int, list[bytes]], list[bytes]]

RUN_COLUMNS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(n: int, runs: Runs, collapsed: bytes) -> tuple:
    start, length, period = runs
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    shown: tuple = (None, None, None, None)
    if len(start):
        best = 0
        for i in range(1, len(start)):  # fractions compared exactly; the rows are in order of start and period
            if int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
                best = i
        s, m, q = int(start[best]), int(length[best]), int(period[best])
        shown = (s, m, q, 1000 * m // q)
    return n, len(start), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def _analysed(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[list[bytes], Runs, bytes]]:
    """The words, runs and collapsed text of each document, some documents a step."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= STEP_WORDS):
            size += len(texts[end])
            end += 1
        part = texts[begin:end]
        ids, owner = word_numbers(part)
        start, length, period = maximal_runs(ids, owner, least, times)
        offset = np.cumsum([0, *map(len, part)])
        cut = np.searchsorted(start, offset)
        for i, words in enumerate(part):
            own = slice(cut[i], cut[i + 1])
            runs = (start[own] - offset[i], length[own], period[own])
            gone = repeated(runs, len(words)) if cut[i + 1] > cut[i] else None
            kept = words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            yield words, runs, b" ".join(kept)
        begin = end


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: Column | None = None, rewrite: Rewrite | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """A row per document: its runs counted and digested, the one of greatest exponent, and the digest of the text without repeats.

    `rewrite` may change the words of a document by the number in `seed` before runs are sought (null: left as they are).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            if rewrite:
                texts = [t if s is None else rewrite(s, t) for s, t in zip(batch.column(2).to_pylist(), texts, strict=True)]
            rows = [_described(len(words), runs, collapsed) for words, runs, collapsed in _analysed(texts, least, times)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["key", *[x.split()[0] for x in RUN_COLUMNS.split(", ")]])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    return slim.mapInArrow(find, f"key {docs.schema[key].dataType.simpleString()}, {RUN_COLUMNS}").withColumnRenamed("key", key)


def collapsed(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with texts that have runs replaced by the words without repeats, one blank between; other texts stay as they are."""
    columns = docs.columns

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index(text)
            old = batch.column(at).to_pylist()
            found = _analysed([(t or "").encode("utf-8", "surrogatepass").split() for t in old], least, times)
            new = [short.decode("utf-8", "surrogatepass") if len(runs[0]) else t for t, (_, runs, short) in zip(old, found, strict=True)]
            arrays = [*batch.columns]
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(shorten, docs.schema)


def planted(seed: int, words: list[bytes]) -> list[bytes]:
    """Every tenth document repeats its words from some place on, so that runs of many lengths and periods are there."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
