"""N-gram Jaccard join: classes of documents whose sets of word n-grams are similar, through prefix trees.

All n-grams have one global order, rare before common (by a sketch of their numbers), then by hash. Two sets of a
Jaccard similarity of t share one of their first n - ceil(t * n) + 1 n-grams, so each set is posted under these, with its
size and the n-gram's place. An n-gram that only one set posts joins nothing and goes. What is left meets in cells of an
n-gram and two neighbouring classes of sizes, as similar sets are nearly of one size; a set goes from a cell where what
is left of it from that place on is too short even for the cell's smallest set. Of cells with the same sets one stays.
Cells deal the sets to shards, all with one least set to the same, so that the cells of a family meet; large cells have
shards of their own, and the largest are dealt in parts, two parts a shard. Before whole sets are dealt, small maps of
them are: bit b is the parity of the number of n-grams that fall on b, so two maps differ in no more bits than the sets
do in n-grams, and a set without a partner whose map is near enough goes.

A shard stores its ordered sets in a compressed trie: sets with the same beginning share its nodes. Sets are sought in
blocks: going down, a node's overlap with each sought set is its parent's and the n-grams of its own edge, counted once
for all sets below it. A subtree is left for a sought set when the overlap so far and the least of what remains, in the
sought set after the edge and in the longest set below, cannot reach what the smallest set below would need; and when
all sets below are joined with it already, so a dense family costs its first blocks only. What arrives at a leaf is the
whole overlap, and is compared exactly. A shard returns a forest, not pairs; classes are components in Spark.

Sets are told apart by 64-bit hashes, as are n-grams. Documents with the same set are one row before anything is dealt.

Edge cases: a null, an empty or a blank text has the empty set, which is linked with nothing; with fewer words than n
the whole sequence is the one n-gram; rows that repeat are linked with one another; a null id takes part, and the class
is named by the smallest id that is not null (null if there is none); an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, mix, powers, stored, text_blocks
from .components import connected_components

NGRAM = 4
#: Percent of the union that two sets share at least.
LEAST_PERCENT = 85
#: Places of the sketch of n-grams' numbers and of the map of dealt sets; a task reports places that it met so often, and four times more than the mean.
SKETCH_BITS, LIVE_BITS, LEAST_SEEN = 22, 23, 8
#: Sets of a shard of small families, and of a cell that shares its family's shard; sets of a cell, beyond which it is dealt in parts of half as many.
SHARD_ROWS, PART_ROWS = 1024, 8192
#: Sets sought together: a few first, so that dense families are joined before the rest is sought.
BLOCKS, STEP = (4, 16, 64), 1 << 22

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in SPACES]] = True
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


# ---------------------------------------------------------------- sets of n-grams


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the hashes of all words, A-Z in lower case."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[raw])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    upto = np.cumsum([len(c) + 1 for c in coded])
    return np.diff(np.concatenate(([0], np.searchsorted(starts, upto)))), mix((sums[ends] - sums[starts]) * down[starts])


def gram_sets(texts: list[str], n: int = NGRAM) -> list[np.ndarray]:
    """The distinct hashes of each text's n-grams, in order of hash."""
    counts, words = word_hashes(texts)
    whole = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        whole += words[k : k + len(whole)] * _TURNS[k]
    whole = mix(whole + np.uint64(n))
    out, at = [], 0
    for size in counts.tolist():
        if size >= n:
            out.append(np.unique(whole[at : at + size - n + 1]))
        elif size:
            out.append(mix((words[at : at + size] * _TURNS[:size]).sum(dtype=np.uint64, keepdims=True) + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def mark_of(grams: np.ndarray) -> int:
    """A number for a set, the same for equal sets."""
    return int(mix(mix(grams + np.uint64(0xA5A5)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def parity_map(grams: np.ndarray) -> bytes:
    """For each of 4 to 8 bits a n-gram, a power of two in all, the parity of the number of n-grams that fall on it."""
    bits = 1 << max(9, (4 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def near_maps(sizes: np.ndarray, maps: list[bytes], percent: int = LEAST_PERCENT) -> np.ndarray:
    """Which sets have another one whose map differs in no more bits than similar sets of the two sizes may. Maps of twice the bits are folded."""
    near, length = np.zeros(len(maps), bool), np.array([len(m) for m in maps])
    for size in np.unique(length).tolist():
        own, twice = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
        rows = np.frombuffer(b"".join(maps[i] for i in own), np.uint64).reshape(len(own), size // 8)
        larger = np.frombuffer(b"".join(maps[i] for i in twice), np.uint64).reshape(len(twice), 2, size // 8)
        every, at = np.concatenate((rows, larger[:, 0] ^ larger[:, 1])), np.concatenate((own, twice))
        strip = max(1, STEP // max(1, every.size))
        for a in range(0, len(own), strip):
            apart = np.bitwise_count(rows[a : a + strip, None] ^ every[None]).sum(axis=2, dtype=np.int64)
            mine = own[a : a + strip]
            i, j = np.nonzero(((100 + percent) * apart <= (100 - percent) * (sizes[mine][:, None] + sizes[at][None, :])) & (mine[:, None] != at[None, :]))
            near[mine[i]] = True
            near[at[j]] = True
    return near


def in_order(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The n-grams of a set in the global order: by the sketch's class of their number, then by hash."""
    return grams[np.argsort(sketch[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def prefix_size(n: int, percent: int = LEAST_PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in text_blocks(texts):
            yield batch.slice(a, b - a), texts[a:b]


def marked_sets(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """(key, n_shingles, mark, map) of every document; and the sketch, a class (log2) of the number of n-grams at each place."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        kind = None
        for part, texts in _texts(batches, 1):
            sets = gram_sets(texts, n)
            seen += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=len(seen))
            kind = part.column(0).type
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([mark_of(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int64()), pa.array([parity_map(s) if len(s) else None for s in sets], pa.binary())], names=["key", "n_shingles", "mark", "seen", "map"])
        if kind is not None:
            often = np.flatnonzero(seen >= LEAST_SEEN + 4 * seen.mean())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), kind), pa.nulls(len(often), pa.int64()), pa.array(often, pa.int64()), pa.array(seen[often]), pa.nulls(len(often), pa.binary())], names=["key", "n_shingles", "mark", "seen", "map"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(slim.mapInArrow(mark, f"key {docs.schema[key].dataType.simpleString()}, n_shingles long, mark long, seen long, map binary"), "sets")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    counted = rows.where("seen is not null").groupBy("mark").agg(F.sum("seen").alias("seen")).toArrow()  # a row for each place of the sketch at most
    sketch[counted["mark"].to_numpy()] = np.log2(counted["seen"].to_numpy() + 1).astype(np.uint8)
    return rows.where("seen is null").drop("seen"), sketch


def postings(docs: DataFrame, text: str, n: int, percent: int, sketch: Broadcast) -> DataFrame:
    """(gram, mark, size, at) for each n-gram of each set's prefix; sets that a step meets again are left out."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            sets = {mark_of(s): s for s in gram_sets(texts, n) if len(s)}
            heads = [in_order(s, sketch.value)[: prefix_size(len(s), percent)] for s in sets.values()]
            if heads:
                per = [len(x) for x in heads]
                marks, sizes = np.repeat(np.fromiter(sets, np.int64, len(sets)), per), np.repeat([len(s) for s in sets.values()], per)
                at = np.concatenate([np.arange(k) for k in per])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(marks), pa.array(sizes, pa.int64()), pa.array(at, pa.int64())], names=["gram", "mark", "size", "at"])

    return docs.select(F.col(text).alias("text")).mapInArrow(post, "gram long, mark long, size long, at long")


def posted_sets(docs: DataFrame, text: str, n: int, sketch: Broadcast, live: Broadcast) -> DataFrame:
    """(mark, grams) of the sets whose mark meets the map: all that are dealt, and some that are not."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            found = {m: s for s in gram_sets(texts, n) if live.value[(m := mark_of(s)) & ((1 << LIVE_BITS) - 1)]}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([in_order(s, sketch.value).tobytes() for s in found.values()], pa.binary())], names=["mark", "grams"])

    return docs.select(F.col(text).alias("text")).mapInArrow(read, "mark long, grams binary")


# ---------------------------------------------------------------- the trie of a shard


class Trie:
    """Ordered sets as a compressed trie: nodes with an edge of n-grams, level by level; each set has a leaf of its own.

    N-grams of one set only are in no edge: they add to no overlap. `sizes` counts them all the same.
    """

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray) -> None:
        lengths = np.array([len(s) for s in sets], np.int64)
        grams, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(sketch[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
        rank = np.empty(len(grams), np.int64)
        rank[order[count[order] > 1]] = np.arange((count > 1).sum())
        rank[order[count[order] == 1]] = -1
        self.width = int((count > 1).sum())
        numbers = rank[place]
        shared = numbers >= 0
        owner = np.repeat(np.arange(len(sets)), lengths)
        parts = np.split(numbers[shared], np.cumsum(np.bincount(owner[shared], minlength=len(sets)))[:-1])
        by_word = sorted(range(len(sets)), key=lambda i: parts[i].astype(">u4").tobytes())
        self.at = np.array(by_word)  # set of each leaf
        self.sets = [parts[i] for i in by_word]
        self.sizes = lengths[by_word]
        self._grow()

    def _grow(self) -> None:
        common = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        common.append(0)
        # an open node is (depth, first leaf, children); closing one fixes its range of leaves
        nodes: list[list[int]] = []  # depth, first leaf, end leaf, parent
        stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
        for i, s in enumerate(self.sets):
            nodes.append([len(s), i, i + 1, -1])
            last, depth = len(nodes) - 1, common[i + 1]
            first = i
            while stack[-1][0] > depth:
                d, first, children = stack.pop()
                children.append(last)
                nodes.append([d, first, i + 1, -1])
                last = len(nodes) - 1
                for c in children:
                    nodes[c][3] = last
            if stack[-1][0] < depth:
                stack.append((depth, first, [last]))
            else:
                stack[-1][2].append(last)
        table = np.array([*nodes, [0, 0, len(self.sets), -1]], np.int64)
        root = len(nodes)
        for c in stack[0][2]:
            table[c, 3] = root
        depth, self.low, self.high, self.parent = (table[:, k] for k in range(4))
        # parents close after their children: going back over them gives levels from the root
        level = np.zeros(root + 1, np.int64)
        for i in range(root - 1, -1, -1):
            level[i] = level[self.parent[i]] + 1
        begin = depth[self.parent]
        lengths = np.array([len(s) for s in self.sets])
        ranges = np.stack((self.low, np.minimum(self.high, len(self.sets))), 1).ravel()
        over = lambda f, x, end: f.reduceat(np.append(x, end), ranges)[0::2]
        self.least_size, self.rest = over(np.minimum, self.sizes, 1 << 40), over(np.maximum, lengths, 0) - depth
        self._over = over
        self.levels = []
        for k in range(1, int(level.max()) + 1):
            own = np.flatnonzero(level == k)
            pieces = [self.sets[a][b:c] for a, b, c in zip(self.low[own].tolist(), begin[own].tolist(), depth[own].tolist(), strict=True)]
            size = np.array([len(p) for p in pieces])
            final = np.array([int(self.sets[a][c - 1]) if c else -1 for a, c in zip(self.low[own].tolist(), depth[own].tolist(), strict=True)])
            self.levels.append((own, np.concatenate(pieces), np.cumsum(size) - size, size, final))
        self.slot = np.zeros(root + 1, np.int64)
        for own, *_ in self.levels:
            self.slot[own] = np.arange(len(own))

    def joined(self, label: np.ndarray) -> np.ndarray:
        """The label that all sets below a node have, -1 if they differ."""
        low, high = self._over(np.minimum, label, 1 << 40), self._over(np.maximum, label, -1)
        return np.where(low == high, low, -1)

    def seek(self, asked: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, leaf) of linked sets, the second one asked for; links within one label may be left out."""
        block = np.zeros((self.width, len(asked)), np.uint8)
        for k, leaf in enumerate(asked.tolist()):
            block[self.sets[leaf], k] = 1
        upto = np.concatenate((np.zeros((1, len(asked)), np.int32), np.cumsum(block, axis=0, dtype=np.int32)))
        total, size, one = upto[-1], self.sizes[asked], self.joined(label)
        above = np.zeros((1, len(asked)), np.int32)
        kept = np.array([-1])
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        where = np.full(len(self.parent), -1)
        where[-1] = 0
        for own, grams, start, length, final in self.levels:
            here = np.flatnonzero(where[self.parent[own]] >= 0)
            if not len(here):
                break
            nodes = own[here]
            overlap = above[where[self.parent[nodes]]] + self._edges(block, grams, start[here], length[here])
            needed = percent * (size[None, :] + self.least_size[nodes][:, None])  # times the union and the overlap, in percent
            rest = np.minimum(self.rest[nodes][:, None], (total[None, :] - upto[final[here] + 1]))
            alive = ((100 + percent) * (overlap + rest) >= needed) & (one[nodes][:, None] != label[asked][None, :])
            leaf = self.high[nodes] - self.low[nodes] == 1
            i, k = np.nonzero(alive & leaf[:, None])
            linked = (100 + percent) * overlap[i, k] >= percent * (size[k] + self.sizes[self.low[nodes[i]]])
            hits.append((self.low[nodes[i[linked]]], asked[k[linked]]))
            open_ = alive.any(axis=1) & ~leaf
            kept, above = nodes[open_], overlap[open_]
            where[:] = -1
            where[kept] = np.arange(len(kept))
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])

    @staticmethod
    def _edges(block: np.ndarray, grams: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many n-grams of each edge each sought set has; some edges a step."""
        out = np.zeros((len(start), block.shape[1]), np.int32)
        some = np.flatnonzero(length)
        bounds = np.cumsum(length[some]) * block.shape[1] // STEP
        for step in np.split(some, np.flatnonzero(np.diff(bounds)) + 1):
            if len(step):
                first = np.cumsum(length[step]) - length[step]
                at = np.arange(int(length[step].sum())) - np.repeat(first, length[step]) + np.repeat(start[step], length[step])
                out[step] = np.add.reduceat(block[grams[at]], first, axis=0, dtype=np.int32)
        return out


def forest(sets: list[np.ndarray], sketch: np.ndarray, percent: int = LEAST_PERCENT) -> list[tuple[int, int]]:
    """Links between sets, as places, that join all that are linked."""
    if len(sets) < 2:
        return []
    trie = Trie(sets, sketch)
    label = np.arange(len(sets))
    out, done, step = [], 0, 0
    order = np.argsort(mix(np.arange(len(sets)).astype(np.uint64)))
    while done < len(sets):
        most = max(1, min(BLOCKS[min(step, len(BLOCKS) - 1)], STEP // max(trie.width, 1)))
        asked = order[done : done + most]
        for a, b in zip(*(x.tolist() for x in trie.seek(asked, label, percent)), strict=True):
            if label[a] != label[b]:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
                out.append((int(trie.at[a]), int(trie.at[b])))
        done, step = done + len(asked), step + 1
    return out


# ---------------------------------------------------------------- on DataFrames


def _several(rows: DataFrame, *by: str) -> DataFrame:
    """The groups of rows with more than one set, by their least and largest mark; minima are taken map-side."""
    return rows.groupBy(*by).agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.min("size").alias("least")).where("a <> b")


def cells(posted: DataFrame, percent: int) -> DataFrame:
    """(a, n, gram, cell, mark): the sets of each cell that is left, with its least set and its number of sets."""
    shared = stored(_several(posted, "gram").select("gram"), "shared")  # of known size: broadcast below the threshold
    class_ = F.floor(F.log(F.col("size").cast("double")) / (math.log(100 / percent) + 1e-9))  # similar sizes are one class apart at most
    rows = posted.join(shared, "gram").distinct().withColumn("cell", F.explode(F.array(class_, class_ + 1)))
    rows = stored(rows, "cells")
    least = _several(rows, "gram", "cell").select("gram", "cell", "least")
    reach = lambda size, at, other: (100 + percent) * (size - at) >= percent * (size + other)
    rows = stored(rows.join(least, ["gram", "cell"]).where(reach(F.col("size"), F.col("at"), F.col("least"))), "reach")
    own = [F.sum(F.shiftright(F.xxhash64("mark"), 20 * i).bitwiseAND(F.lit((1 << 20) - 1))).alias(f"own{i}") for i in range(3)]
    ends = [f(F.struct("size", "at")).alias(name) for f, name in ((F.min, "p"), (F.max, "q"))]
    left = rows.groupBy("gram", "cell").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.count("*").alias("n"), *own, *ends).where("a <> b")
    pair = reach(F.col("p.size"), F.col("p.at"), F.col("q.size")) & reach(F.col("q.size"), F.col("q.at"), F.col("p.size"))
    one = left.where((F.col("n") > 2) | pair).groupBy("a", "b", "n", "own0", "own1", "own2").agg(F.min(F.struct("gram", "cell")).alias("c"))
    return rows.select("gram", "cell", "mark").join(one.select("a", "n", "c.gram", "c.cell"), ["gram", "cell"])


def _mark_map(dealt: DataFrame) -> np.ndarray:
    """A flag for each place that a dealt set's mark falls on; 2 ** LIVE_BITS of them at any size of the data."""
    low = F.col("mark").bitwiseAND(F.lit((1 << LIVE_BITS) - 1))
    words = dealt.select((low / 32).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(mark & {(1 << LIVE_BITS) - 1} as int) % 32)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << LIVE_BITS) // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _shard() -> Column:
    """The shards of a set in a cell: its family's, the cell's own for a large cell, or all that hold the set's part with another."""
    parts = F.when(F.col("n") > PART_ROWS, F.ceil(F.col("n") / (PART_ROWS // 2))).otherwise(F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("mark"), parts).cast("int")
    usual = F.array(F.when(F.col("n") > SHARD_ROWS, F.xxhash64("gram", "cell")).otherwise(F.xxhash64("a")))
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != own)
    return F.explode(F.when(parts > 1, F.transform(others, lambda j: F.xxhash64("gram", "cell", F.least(own, j), F.greatest(own, j)))).otherwise(usual))


def set_links(docs: DataFrame, text: str, maps: DataFrame, sketch: np.ndarray, n: int = NGRAM, percent: int = LEAST_PERCENT) -> DataFrame:
    """(a, b) of marks whose connected components are those of all similar sets. maps: (mark, n_shingles, map), rows may repeat."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS bytes
    posted = stored(postings(docs, text, n, percent, shared), "postings")
    families = stored(cells(posted, percent).select("mark", _shard().alias("family")).distinct(), "families")
    # small families share a shard: a trie of many sets costs less than many tries
    shards = max(1, -(-families.count() // SHARD_ROWS))
    size = families.groupBy("family").agg(F.count("*").alias("sets"))
    dealt = families.join(size, "family").select("mark", F.when(F.col("sets") < SHARD_ROWS // 8, F.pmod("family", F.lit(shards))).otherwise(F.col("family")).alias("shard")).distinct()

    def sieve(part: pd.DataFrame) -> pd.DataFrame:
        one = part.drop_duplicates("mark")
        return one.loc[near_maps(one["n_shingles"].to_numpy(), one["map"].tolist(), percent), ["shard", "mark"]]

    dealt = dealt.join(maps.dropDuplicates(["mark"]), "mark").groupBy("shard").applyInPandas(sieve, "shard long, mark long")
    dealt = stored(dealt, "dealt")
    live = spark.sparkContext.broadcast(_mark_map(dealt))
    sets = posted_sets(docs, text, n, shared, live).dropDuplicates(["mark"])

    def link(part: pd.DataFrame) -> pd.DataFrame:
        one = part.drop_duplicates("mark")
        marks = one["mark"].to_numpy()
        found = np.array(forest([np.frombuffer(x, np.uint64) for x in one["grams"]], shared.value, percent), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": marks[found[:, 0]], "b": marks[found[:, 1]]})

    return dealt.join(sets, "mark").select("shard", "mark", "grams").groupBy("shard").applyInPandas(link, "a long, b long")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable over links, the document's own included."""
    marked, sketch = marked_sets(docs, key, text, n)
    classes = cut(marked.where("n_shingles > 0").groupBy("mark").agg(F.min("key").alias("first")))
    maps = marked.where("n_shingles > 0").select("mark", "n_shingles", "map")
    roots = connected_components(set_links(docs, text, maps, sketch, n, percent)).withColumnRenamed("node", "mark")
    rooted = cut(classes.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("mark", "component_id")
    linked = marked.where("n_shingles > 0").join(named, "mark").select("key", "n_shingles", "component_id")
    alone = marked.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = LEAST_PERCENT) -> DataFrame:
    """One document of each class of similar texts: that with the smallest id, ids before nulls, then the smallest text hash.

    All pairs that meet the percentage link, as in similar_classes. Texts without words are copies of one another here, and
    rows that repeat both id and text are one document.
    """
    own = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("own"))
    classes = stored(similar_classes(docs.select(own.alias("key"), F.col(text).alias("text")), "key", "text", n, percent), "classes")
    blank = classes.where("n_shingles = 0")
    least = blank.agg(F.min("key").alias("kept"))  # one row
    seconds = blank.crossJoin(F.broadcast(least)).where("not (key <=> kept)").unionByName(classes.where("n_shingles > 0 and not (key <=> component_id)").withColumn("kept", F.col("component_id")))
    gone = stored(seconds.select(F.col("key.id").alias("__id"), F.col("key.own").alias("__own")).distinct(), "gone")
    packed = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = packed.join(gone, packed["id"].eqNullSafe(F.col("__id")) & (packed["own"] == F.col("__own")), "left_anti")
    # rows that repeat both id and text are told apart only if there are any
    repeated = not classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (kept.dropDuplicates(["id", "own"]) if repeated else kept).select("row.*")
