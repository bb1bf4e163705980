"""Exact removal of repeated byte strings, with sparse suffix arrays sorted deep-shallow.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier (smaller id, or same document and
earlier start), judged on the input. Sorting every suffix of a corpus would move each byte many times, so only
some suffixes are sorted: every window of LENGTH bytes has one anchor, the SEED-byte string with the least hash
in it, which depends on the window's bytes alone. Equal windows thus have equal anchors at equal offsets, and the
windows of one anchor form a run.

1. Each text's runs become rows (hash of the anchor, hash of the run's bytes, document, place). Equal runs in one
   batch keep the first; the others are covered already (pre-aggregation, before any shuffle).
2. Sorted by these hashes, equal runs keep the first; the others are covered. Anchors left with different runs
   need their bytes compared.
3. For those, the suffixes that follow the anchor and the reversed prefixes before it are sorted: by ternary multikey
   quicksort to a shallow depth (all segments of a batch at once), then blind tries order the groups with a longer
   common prefix. With both orders'
   common prefix lengths, the windows at each offset fall into classes of equal bytes; all but the first of a
   class are covered.
4. An anchor with more than HOT_ROWS runs is not gathered: its windows become rows of their own, a map-side minimum
   finds the first of each, and the others are covered. No task holds a window's copies.

Runs of step 2 and windows of step 4 are told apart by 128 bits of hash; step 3 compares bytes.

Edge cases: null and empty texts have no bytes; identical rows (same id and text) are one document, and each
gets its result; rows with one id and different texts are ordered by a hash of the text; null ids come first;
texts shorter than LENGTH keep all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, powers, shuffle_partitions, stored

LENGTH, SEED = 100, 32
SPREAD = LENGTH - SEED  # bytes of a window outside its anchor
#: Windows of one text handled at a time, and bytes of a block of texts.
PIECE, BLOCK_BYTES = 1 << 20, 1 << 21
PLACE_BITS = np.uint64(28)
SHALLOW = 16
HOT_ROWS = 200_000
SEGMENT_ROWS = 50_000
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- anchors


def _seed_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at each place, by doubling."""
    h, width = _TABLE[raw], 1
    while width < SEED:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        h ^= h >> np.uint64(33)
        width *= 2
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` keys in a row."""
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(text, first window, bytes) with at most PIECE windows each; together they hold every window once."""
    for i, t in enumerate(texts):
        for start in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            yield i, start, t[start : start + PIECE + LENGTH - 1]


def anchor_runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, first window, windows, anchor's offset, hashes of anchor and run."""
    parts: list[list[np.ndarray]] = []
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for piece in pieces(texts):
        block.append(piece)
        size += len(piece[2])
        if size >= BLOCK_BYTES:
            parts.append(_block_runs(block))
            block, size = [], 0
    if block:
        parts.append(_block_runs(block))
    names = ("row", "start", "n", "offset", "h", "c")
    kinds = (np.int64, np.int64, np.int32, np.int32, np.uint64, np.uint64)
    return {k: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i, k in enumerate(names)}


def _block_runs(block: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(b for _, _, b in block), np.uint8)
    lengths = np.array([len(b) for _, _, b in block])
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    h = mix(_seed_hashes(raw))
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    anchor = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), SPREAD + 1) & low).astype(np.int64)
    # windows that stay within their piece, then runs of one anchor
    windows = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begins, lengths, strict=True)])
    owner = np.repeat(np.arange(len(block)), lengths - LENGTH + 1)
    a = anchor[windows]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]))))
    n = np.diff(np.concatenate((first, [len(a)])))
    start, own, at = windows[first], owner[first], a[first]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64)))
    run = (sums[start + n + LENGTH - 1] - sums[start]) * down[start]
    run = mix(run ^ mix((n.astype(np.uint64) << np.uint64(8)) + (at - start).astype(np.uint64)))
    rows, shifts = np.array([i for i, _, _ in block]), np.array([s for _, s, _ in block])
    return [rows[own], start - begins[own] + shifts[own], n.astype(np.int32), (at - start).astype(np.int32), h[at], run]


RUNS = "h long, c long, doc long, start long, n int, offset int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of a batch of (doc, text); equal runs after the first come as covered, with n below 0."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        r = anchor_runs([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)])
        doc = docs[r["row"]] if len(r["row"]) else np.zeros(0, np.int64)
        h, c = r["h"].view(np.int64), r["c"].view(np.int64)
        order = np.lexsort((r["start"], doc, c, h))
        same = np.zeros(len(h), bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
        # the same windows of one document, met again in a repeated row, are no earlier copy
        again = np.zeros(len(h), bool)
        again[1:] = same[1:] & (doc[order][1:] == doc[order][:-1]) & (r["start"][order][1:] == r["start"][order][:-1])
        order, same = order[~again], same[~again]
        n = np.where(same, -r["n"][order], r["n"][order]).astype(np.int32)
        yield from pa.Table.from_pydict({"h": h[order], "c": c[order], "doc": doc[order].astype(np.int64), "start": r["start"][order], "n": n, "offset": r["offset"][order]}).to_batches(20_000)


FOUND = "kind int, h long, doc long, start long, n int, offset int"
COVERED, OPEN = 1, 2


def _equal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads RUNS in order of (h, c, doc, start); FOUND has the covered runs, and the open ones: first of their kind, beside others with their anchor.

    One row is held back between batches, so a group of any size needs no more memory.
    """
    held: tuple | None = None  # the last first-of-its-kind row: (h, c, doc, start, n, offset, whether already given out)
    last: tuple | None = None
    for batch in batches:
        h, c, doc, start, n, offset = (x.to_numpy() for x in batch.columns)
        if not len(h):
            continue
        known = n < 0
        out = [[COVERED, h[known], doc[known], start[known], -n[known], offset[known]]]
        h, c, doc, start, n, offset = (x[~known] for x in (h, c, doc, start, n, offset))
        if len(h):
            ph = np.concatenate(([last[0] if last else ~h[0]], h[:-1]))
            pc = np.concatenate(([last[1] if last else ~c[0]], c[:-1]))
            pd_ = np.concatenate(([last[2] if last else ~doc[0]], doc[:-1]))
            ps = np.concatenate(([last[3] if last else ~start[0]], start[:-1]))
            equal = (h == ph) & (c == pc)
            again = equal & (doc == pd_) & (start == ps)
            last = (h[-1], c[-1], doc[-1], start[-1])
            use = equal & ~again
            out.append([COVERED, h[use], doc[use], start[use], n[use], offset[use]])
            first = ~equal
            fh, rest = h[first], [x[first] for x in (doc, start, n, offset)]
            cf = c[first]
            if len(fh):
                if held:
                    fh, cf = np.concatenate(([held[0]], fh)), np.concatenate(([held[1]], cf))
                    rest = [np.concatenate(([v], x)) for v, x in zip(held[2:6], rest, strict=True)]
                shares = np.zeros(len(fh), bool)
                shares[1:] = fh[1:] == fh[:-1]
                shares[:-1] |= fh[:-1] == fh[1:]
                given = bool(held and held[6])
                tail = (fh[-1], cf[-1], *(x[-1] for x in rest), bool(shares[-1]) or (given and len(fh) == 1))
                if given:
                    shares[0] = False
                held = tail
                out.append([OPEN, fh[shares], *(x[shares] for x in rest)])
        for kind, *columns in out:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(x.astype(t)) for x, t in zip(columns, (np.int64, np.int64, np.int64, np.int32, np.int32), strict=True))], names=[x.split()[0] for x in FOUND.split(", ")])


# ---------------------------------------------------------------- deep-shallow sorting


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    if a == b:
        return len(a)
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching places and branching bytes only; a string is compared once, with the leaf it is led to.

    A node is a pair (place, children by byte), a leaf a list of equal strings' numbers.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: tuple | list = [0]
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while isinstance(node, tuple):  # blind to all bytes between the branching ones
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = _common(s, other)
        if depth == len(s):
            node.append(k)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [k]
        elif above is None:
            self.root = (depth, {other[depth]: node, s[depth]: [k]})
        else:
            above[1][s[above[0]]] = (depth, {other[depth]: node, s[depth]: [k]})

    def order(self) -> Iterator[tuple[int, int]]:
        """(string, length of its common prefix with the one before) in order."""
        stack: list[tuple[int, tuple | list]] = [(0, self.root)]
        while stack:
            lcp, node = stack.pop()
            if isinstance(node, list):
                for i, k in enumerate(node):
                    yield k, len(self.strings[k]) if i else lcp
            else:
                depth, children = node
                stack += [(depth if i else lcp, children[byte]) for i, byte in reversed(list(enumerate(sorted(children))))]


def multikey_quicksort(group: np.ndarray, strings: np.ndarray, depth: int) -> np.ndarray:
    """The order of rows of bytes within groups by their first `depth` bytes.

    A segment is parted by one byte into those below, at and above its middle row's byte; the middle part goes on with
    the next byte. All segments of a round are parted together, so a round is a few array steps, whatever their number.
    """
    order = np.argsort(group, kind="stable")
    places = np.arange(len(order))
    segment = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(group[order]) != 0)), places, 0)) if len(order) else places
    at = np.zeros(len(order), np.int64)  # the byte that each row's segment is parted by next
    live = places
    while True:
        size = np.bincount(segment[live], minlength=len(order))[segment[live]]
        live, size = live[keep := (size > 1) & (at[live] < depth)], size[keep]
        if not len(live):
            return order
        rows, own = order[live], segment[live]
        middle = own + size // 2
        byte, pivot = strings[rows, at[live]], strings[order[middle], at[middle]]
        side = (byte >= pivot).astype(np.int8) + (byte > pivot)
        parted = np.lexsort((side, own))  # stable: rows keep their order within a part
        order[live], side = rows[parted], side[parted]
        at[live] += side == 1
        new = np.concatenate(([True], (np.diff(own) != 0) | (np.diff(side) != 0)))
        segment[live] = np.maximum.accumulate(np.where(new, live, 0))


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of equal-length strings (bytes, n x width) within groups.

    Returns the order, and for each place the common prefix length with the one before (-1 at a group's start).
    """
    n, width = strings.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shallow = min(SHALLOW, width)
    order = multikey_quicksort(group, strings, shallow)
    g, w = group[order], strings[order]
    lcp = np.full(n, -1, np.int64)
    new = np.flatnonzero(g[1:] == g[:-1]) + 1
    differ = w[new, :shallow] != w[new - 1, :shallow]
    lcp[new] = np.where(differ.any(axis=1), differ.argmax(axis=1), shallow)
    # groups that agree to the shallow depth go to blind tries
    deep = np.concatenate(([0], lcp == shallow, [0])).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(deep) == 1) - 1, np.flatnonzero(np.diff(deep) == -1)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        rows = [x.tobytes() for x in w[a:b]]
        placed = list(BlindTrie(rows).order())
        order[a:b] = order[a:b][[k for k, _ in placed]]
        lcp[a + 1 : b] = [x for _, x in placed[1:]]
    return order, lcp


def covered_windows(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, offset: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window) of all windows of the runs that an earlier window of the same anchor equals.

    before: the bytes before each anchor, reversed; after: those after it; both SPREAD wide, padded.
    """
    size = len(h)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((start + offset, doc))] = np.arange(size)
    classes = []
    for side in (before, after):
        order, lcp = deep_shallow(h, side)
        classes.append((order, lcp))
    docs, places = [], []
    for s in range(SPREAD + 1):
        # windows that begin s bytes before the anchor
        have = np.flatnonzero((offset >= s) & (offset - n < s))
        if len(have) < 2:
            continue
        key = np.zeros(size, np.int64)
        for (order, lcp), depth in zip(classes, (s, SPREAD - s), strict=True):
            label = np.empty(size, np.int64)
            label[order] = np.cumsum(lcp < depth)
            key = key * (size + 1) + label
        order = have[np.lexsort((rank[have], key[have]))]
        late = order[1:][key[order][1:] == key[order][:-1]]
        docs.append(doc[late])
        places.append(start[late] + offset[late] - s)
    return (np.concatenate(docs), np.concatenate(places)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


CONTEXTS = "h long, doc long, start long, n int, offset int, context binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CONTEXTS in order of h -> covered (doc, a, b); works off whole anchors, some at a time."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= SEGMENT_ROWS:
            whole = pa.Table.from_batches(kept)
            h = whole.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield from _compare_segment(whole.slice(0, last))
                kept = whole.slice(last).to_batches()
                rows = len(h) - last
    if rows:
        yield from _compare_segment(pa.Table.from_batches(kept))


def _compare_segment(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    h, doc, start, n, offset = (rows.column(i).to_numpy() for i in range(5))
    before, after = np.zeros((len(h), SPREAD), np.uint8), np.zeros((len(h), SPREAD), np.uint8)
    for i, context in enumerate(rows.column(5)):
        raw = np.frombuffer(context.as_py(), np.uint8)
        o = offset[i]
        before[i, :o] = raw[:o][::-1]
        after[i, : len(raw) - o - SEED] = raw[o + SEED :]
    doc, place = covered_windows(h, doc, start, n, offset, before, after)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    if len(doc):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + LENGTH)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(doc)])) - 1
        yield from pa.Table.from_pydict({"doc": doc[first], "a": place[first], "b": place[last] + LENGTH}).to_batches(20_000)


# ---------------------------------------------------------------- on DataFrames


def _with_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs) -> CONTEXTS."""
    for batch in batches:
        out: dict[str, list] = {k.split()[0]: [] for k in CONTEXTS.split(", ")}
        for doc, text, runs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for r in runs:
                start, n = r["start"], r["n"]
                for name, value in zip(out, (r["h"], doc, start, n, r["offset"], raw[start : start + n + LENGTH - 1]), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield from pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out)).to_batches(5_000)


WINDOWS = "w binary, doc long, start long"


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs) -> WINDOWS: the hash of each window of the runs."""
    for batch in batches:
        for doc, text, runs in zip(*batch.columns, strict=True):
            raw, doc = (text.as_py() or "").encode("utf-8", "surrogatepass"), doc.as_py()
            places = [r["start"] + k for r in runs.as_py() for k in range(r["n"])]
            for a in range(0, len(places), 20_000):
                part = places[a : a + 20_000]
                w = [hashlib.blake2b(raw[p : p + LENGTH], digest_size=16).digest() for p in part]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([doc] * len(part), pa.int64()), pa.array(part, pa.int64())], names=["w", "doc", "start"])


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with a long id for each different row, in the order of ids; and the ids' meaning, if they are new."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows, known, kinds = slim.agg(F.count("*"), F.count("id"), F.count_distinct("id")).first()
    if rows == known == kinds and dict(slim.dtypes)["id"] in ("bigint", "int"):
        return slim.select(F.col("id").cast("long").alias("doc"), "text"), None
    marked = slim.withColumn("mark", F.xxhash64("text"))
    ids = stored(marked.select("id", "mark").distinct().orderBy(F.col("id").asc_nulls_first(), "mark").withColumn("doc", F.monotonically_increasing_id()), "ids")
    joined = marked.join(ids.withColumnsRenamed({"id": "__id", "mark": "__mark"}), F.col("id").eqNullSafe(F.col("__id")) & F.col("mark").eqNullSafe(F.col("__mark")))
    return joined.select("doc", "text"), ids


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """keyed: (doc, text). Covered byte spans (doc, a, b), which may overlap."""
    n = shuffle_partitions(keyed.sparkSession)
    runs = keyed.mapInArrow(_runs, RUNS)
    # runs that are covered already are only passed on, so they are dealt by document: of a hot anchor, a row for each
    # different run of a batch meets the others
    place = F.when(F.col("n") > 0, F.xxhash64("h")).otherwise(F.xxhash64("doc", "start"))
    found = stored(runs.repartition(n, place).sortWithinPartitions("h", "c", "doc", "start").mapInArrow(_equal_runs, FOUND), "runs")
    covered = found.where(F.col("kind") == COVERED).select("doc", F.col("start").alias("a"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("b"))
    open_ = found.where(F.col("kind") == OPEN)
    # at most all rows / HOT_ROWS anchors are hot
    hot = [r.h for r in open_.groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS).select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)

    def with_texts(runs: DataFrame) -> DataFrame:
        asked = runs.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "n", "offset")).alias("runs"))  # of one document
        return keyed.join(asked, "doc").select("doc", "text", "runs")

    contexts = with_texts(open_.where(~is_hot)).mapInArrow(_with_contexts, CONTEXTS)
    compared = contexts.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_compare, "doc long, a long, b long")
    spans = covered.unionByName(cut(compared))
    if not hot:
        return spans
    single = stored(with_texts(open_.where(is_hot)).mapInArrow(_single_windows, WINDOWS), "windows")
    firsts = single.groupBy("w").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("w", "first")
    late = single.join(firsts, "w").where(F.struct("doc", "start") > F.col("first"))
    return spans.unionByName(cut(late.select("doc", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))))


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    first = np.flatnonzero(new)
    return a[first], b[np.concatenate((first[1:], [len(a)])) - 1]


def _remaining(raw: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    edges = [0, *(x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    keyed, ids = _keyed(docs, key, text)
    spans = repeated_spans(keyed.distinct() if ids is not None else keyed).groupBy("doc").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, count, kept = [], [], [], []
            for value, a, b in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                if a.is_valid:
                    x, y = _merged(a.values.to_numpy(), b.values.to_numpy())
                    left = _remaining(raw, x, y)
                else:
                    x, left = (), raw
                size.append(len(raw))
                removed.append(len(raw) - len(left))
                count.append(len(x))
                kept.append(left)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, long), pa.array(removed, long), pa.array(count, long), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = keyed.join(spans, "doc", "left").select("doc", "text", "a", "b").mapInArrow(remove, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    if ids is not None:
        out = out.join(ids, "doc").withColumnRenamed("id", key).drop("mark", "doc")
        return out.select(key, "n_bytes", "n_removed", "n_spans", "kept")
    return out.withColumnRenamed("doc", key)
