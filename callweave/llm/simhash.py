"""SimHash near-dedup: fingerprints of word shingles, linked through vantage-point trees.

A fingerprint bit is set if it is set in more than half of the shingles' hashes; Spark hashes the shingles, a task
counts the bits. Distinct fingerprints are dealt to shards by vantage-point trees, which are fitted on a sample
(hash-chosen, some per shard) but route all: at each node a fingerprint goes inside if its Hamming distance to the
vantage is at most the node's, else outside. In the metric of all 64 bits nearly all distances are about 32, so a
boundary as wide as the radius would be copied at every level, and copies grow with the data. So the bits are taken
as four blocks with a metric and a tree each: two fingerprints within three bits agree in one block, where the
triangle inequality puts them on one side of every boundary. Each fingerprint goes to four shards at any size, and
every pair meets in one of them. A group that agrees in a whole block is dealt on by the blocks of its other bits.
Within a shard a tree of all bits goes on until blocks are small, with the inner side's last distances copied outside
as the triangle inequality asks, and blocks are compared with popcounts. A shard returns a forest, not pairs;
components are found in Spark.

`near_duplicate_classes` links fingerprints within `radius` (exactly, by one table). `one_of_each` keeps one document
of each class of texts whose shingle sets have a Jaccard similarity of `similarity` or more: such pairs differ in ten
of 64 bits, too many to be sure to agree in a block. So some tables are dealt, four trees each; a pair stays together
in a tree unless a boundary parts it. Within a shard all pairs near in all tables together are candidates, of which
the least spanning forest and each text's busiest neighbour are kept, and the shingle sets of these are compared
exactly. Near pairs may be missed where all trees part them (`tests/llm/test_simhash.py` holds the recall against
brute force); no pair below the similarity is linked.

Edge cases: null and empty texts have fingerprint 0 and link like any other; texts shorter than a shingle are one
shingle; repeated rows share a fingerprint; an empty table gives an empty result. Ties go to the smallest id; null
ids are ignored as representatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, mix, stored
from .components import connected_components

RADIUS, SHINGLE = 3, 3
#: Near copies: words of a shingle, least Jaccard similarity, tables, and ring of boundary copies within a shard.
NEAR_SHINGLE, SIMILARITY, TABLES, RING = 5, 0.8, 4, 4
#: What is mixed into the hashes of each table after the first.
SALTS = mix(np.arange(1, 65, dtype=np.uint64))
#: Most differing bits of a candidate in one table, and in the mean over all tables. At similarity 0.8 a bit differs
#: with probability arccos(2 * 0.8 / 1.8) / pi = 0.1515: 9.7 of 64.
BITS_ONE, BITS_MEAN = 19, 14
SHARD_ROWS, BLOCK, SAMPLE_PER_SHARD, LEAST_SAMPLE = 12_000, 1_024, 24, 16_384


# ---------------------------------------------------------------- fingerprints


def shingles(words: Column, shingle: int) -> Column:
    """64-bit hashes (XXH64, seed 42) of all shingles of a column of words, repeats included; fewer words are one shingle."""
    n = F.size(words)
    at = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(shingle)]))
    many = F.transform(F.sequence(F.lit(0), n - shingle), at)
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= shingle, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(many)


def with_shingles(df: DataFrame, text: str, shingle: int, name: str = "hashes") -> DataFrame:
    """df with the hashes of its text's shingles: A-Z lower-cased, words parted by ASCII white space."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    worded = df.withColumn("__words", F.array_remove(F.split(low, f"{SPACE_CLASS}+"), ""))
    return worded.withColumn(name, shingles(F.col("__words"), shingle)).drop("__words")


def majority(hashes: np.ndarray, tables: int = 1) -> np.ndarray:
    """The fingerprint of some hashes in each table; the first is that of the plain hashes."""
    out = np.zeros(tables, np.uint64)
    if len(hashes):
        for t in range(tables):
            bits = np.unpackbits((mix(hashes ^ SALTS[t]) if t else hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[t] = np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, tables: int = 1) -> DataFrame:
    """(id, own, mark, fps): hashes of the text and of its words, and the fingerprints as signed longs."""
    kind = dict(docs.dtypes)[key]
    slim = with_shingles(docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("own"), F.col(text).alias("text")), "text", shingle)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            found = np.empty((batch.num_rows, tables), np.uint64)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                found[i] = majority(values[a:b], tables)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(found.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fps], names=["id", "own", "mark", "fps"])

    hashed = slim.select("id", "own", F.xxhash64("hashes").alias("mark"), "hashes")
    return hashed.mapInArrow(scan, f"id {kind}, own long, mark long, fps array<long>")


# ---------------------------------------------------------------- vantage-point trees


def distances(fps: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(vantage))


def choose(fps: np.ndarray, radius: int, tries: int = 12) -> tuple[int, int] | None:
    """The vantage and split distance that leave the least work; None if none makes both sides smaller."""
    best = None
    some = fps if len(fps) <= 4096 else fps[:: len(fps) // 4096]
    most = 0.95 if radius else 1.0
    for vantage in some[:: max(1, len(some) // tries)][:tries]:
        shares = np.bincount(distances(some, vantage), minlength=65) / len(some)
        inside = np.cumsum(shares)
        for mu in {int(np.searchsorted(inside, q)) for q in (0.3, 0.4, 0.5, 0.6)}:
            ring = inside[mu] - (inside[mu - radius] if mu >= radius else 0)
            outside = 1 - inside[mu] + ring
            work = inside[mu] ** 2 + outside**2
            if max(inside[mu], outside) < most - 1e-9 and (best is None or work < best[2]):
                best = (int(vantage), mu, work)
    return best and best[:2]


def bit_blocks(free: int) -> list[int]:
    """The free bits as four masks of about equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[k::4]) for k in range(4)]


def grow(fps: np.ndarray, scale: float, shard_rows: int = SHARD_ROWS, free: int = (1 << 64) - 1, mask: int = 0, ids: Iterator[int] | None = None) -> tuple | int:
    """A tree over a sample that stands for `scale` times its rows. A leaf is a number.

    ("blocks", trees) sends all to a tree for each block of the free bits; ("vantage", mask, vantage, distance, inner, outer)
    parts by the distance in the bits of the mask.
    """
    ids = count() if ids is None else ids
    if len(fps) * scale <= shard_rows or len(fps) < 8:
        return next(ids)
    if mask and (picked := choose(fps & np.uint64(mask), 0)):
        d = distances(fps & np.uint64(mask), picked[0])
        inner, outer = (grow(x, scale, shard_rows, free, mask, ids) for x in (fps[d <= picked[1]], fps[d > picked[1]]))
        return "vantage", mask, *picked, inner, outer
    free &= ~mask  # all agree in the mask
    if free.bit_count() < 8:
        return next(ids)
    return "blocks", [grow(fps, scale, shard_rows, free, m, ids) for m in bit_blocks(free)]


def route(fps: np.ndarray, tree: tuple | int, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places of the fingerprints that belong to it)."""
    at = np.arange(len(fps)) if at is None else at
    if not len(at):
        return
    if isinstance(tree, int):
        yield tree, at
    elif tree[0] == "blocks":
        for below in tree[1]:
            yield from route(fps, below, at)
    else:
        _, mask, vantage, mu, inner, outer = tree
        d = distances(fps[at] & np.uint64(mask), vantage)
        yield from route(fps, inner, at[d <= mu])
        yield from route(fps, outer, at[d > mu])


def local_blocks(fps: np.ndarray, radius: int, at: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Places of blocks of a shard; pairs within the radius are together in one of them. Dense groups stay whole."""
    at = np.arange(len(fps)) if at is None else at
    picked = choose(fps[at], radius) if len(at) > BLOCK else None
    if not picked:
        yield at
        return
    d = distances(fps[at], picked[0])
    inner, outer = at[d <= picked[1]], at[d > picked[1] - radius]
    if max(len(inner), len(outer)) > 0.97 * len(at):
        yield at
        return
    yield from local_blocks(fps, radius, inner)
    yield from local_blocks(fps, radius, outer)


def stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, place of the first of its group): searched outwards from each first one, against those not yet reached.

    Only a strip of distances is held, and each fingerprint is compared once with those that are left.
    """
    left, own, root = np.arange(len(fps)), [], []
    if len(fps) <= BLOCK:  # most blocks hold no pair at all
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        left = np.flatnonzero(near.sum(axis=1) > 1)
    while len(left):
        first, left = left[0], left[1:]
        front = np.array([first])
        while len(front) and len(left):
            step, front = front[:BLOCK], front[BLOCK:]
            hit = np.zeros(len(left), bool)
            for a in range(0, len(left), 1 << 14):
                hit[a : a + (1 << 14)] = (np.bitwise_count(fps[left[a : a + (1 << 14)], None] ^ fps[None, step]) <= radius).any(axis=1)
            new, left = left[hit], left[~hit]
            own.append(new)
            root.append(np.full(len(new), first))
            front = np.concatenate((front, new))
    return (np.concatenate(own), np.concatenate(root)) if own else (np.zeros(0, np.int64),) * 2


def local_stars(fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (fingerprint, one of its group) that join all groups of fingerprints within `radius`."""
    for at in local_blocks(fps, radius):
        own, root = stars(fps[at], radius)
        if len(own):
            yield fps[at][own], fps[at][root]


def nearest_forest(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """fps: rows of several tables. Edges of the least spanning forest of all pairs that differ in at most `most` bits (Prim)."""
    n = len(fps)
    best, parent, left = np.full(n, most + 1), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(fps ^ fps[at]).sum(axis=1)
        better = left & (d < best)
        best[better], parent[better] = d[better], at
        at = int(np.argmin(np.where(left, best, most + 2)))
        if best[at] <= most:
            yield at, int(parent[at])


def local_candidates(fps: np.ndarray, t: int, radius: int = RING, one: int = BITS_ONE, mean: float = BITS_MEAN) -> Iterator[tuple[int, int]]:
    """Pairs of places of a shard of table t: in each block, the least spanning forest of all candidates and each text's busiest neighbour."""
    most = int(mean * fps.shape[1])
    for at in local_blocks(fps[:, t], radius):
        rows = fps[at]
        busy, strip = np.zeros(len(rows), np.int64), max(1, (1 << 20) // max(len(rows), 1))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for passes in range(2):  # how many neighbours each has; then the busiest of them
            for a in range(0, len(rows), strip):
                i, j = np.nonzero(np.bitwise_count(rows[a : a + strip, None, t] ^ rows[None, :, t]) <= one)
                near = np.bitwise_count(rows[a + i] ^ rows[j]).sum(axis=1) <= most
                i, j = i[near] + a, j[near]
                if passes == 0:
                    busy += np.bincount(i, minlength=len(rows))
                    continue
                i, j = i[i != j], j[i != j]
                order = np.lexsort((j, -busy[j], i))
                i, j = i[order], j[order]
                first = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
                hits.append((i[first], j[first]))
            if busy.max(initial=0) < 2:
                break
        for i, j in hits:
            yield from zip(at[i].tolist(), at[j].tolist(), strict=True)
        some = np.flatnonzero(busy > 1)
        for i, j in nearest_forest(rows[some], most):
            yield int(at[some[i]]), int(at[some[j]])


# ---------------------------------------------------------------- on DataFrames


def _trees(nodes: DataFrame, tables: int) -> list[tuple | int]:
    """A tree for each table, grown on hash-chosen nodes: some for each shard there will be."""
    n = nodes.count()
    wanted = max(LEAST_SAMPLE, SAMPLE_PER_SHARD * n // SHARD_ROWS)
    share = min(1.0, wanted / max(n, 1))
    picked = nodes.where(F.pmod(F.xxhash64("m"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else nodes
    if n <= SHARD_ROWS:
        return [0] * tables
    columns = picked.select(*[F.col("fps")[t].alias(f"f{t}") for t in range(tables)]).toArrow()
    samples = [np.unique(columns[t].to_numpy().view(np.uint64)) for t in range(tables)]
    return [grow(s[np.argsort(mix(s))], n / max(len(s), 1)) for s in samples]


def _dealt(nodes: DataFrame, tables: int) -> DataFrame:
    """nodes: (m, fps). Rows (t, leaf, m, fps) for each shard that a node is dealt to."""
    shared = nodes.sparkSession.sparkContext.broadcast(_trees(nodes, tables))  # about two nodes for each shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, lists = batch.column(0), batch.column(1)
            fps = lists.flatten().to_numpy().view(np.uint64).reshape(-1, tables)
            for t, tree in enumerate(shared.value):
                found = list(route(fps[:, t], tree))
                if not found:
                    continue
                at = np.concatenate([x for _, x in found])
                leaf = np.repeat([k for k, _ in found], [len(x) for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(leaf.astype(np.int64)), m.take(pa.array(at)), lists.take(pa.array(at))], names=["t", "leaf", "m", "fps"])

    return nodes.mapInArrow(deal, "t int, leaf long, m long, fps array<long>")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: (fp), distinct. Rows (a, b) whose connected components are those of all pairs within `radius`."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        found = list(local_stars(np.unique(group["m"].to_numpy()).view(np.uint64), radius))
        a, b = (np.concatenate([x[k] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    dealt = _dealt(nodes.select(F.col("fp").alias("m"), F.array("fp").alias("fps")), 1)
    return dealt.select("leaf", "m").groupBy("leaf").applyInPandas(link, "a long, b long")


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links, the document's own included."""
    marked = stored(fingerprints(docs, key, text, shingle).select("id", F.col("fps")[0].alias("fp")), "fingerprints")
    # smallest ids per fingerprint, with map-side minima, then per class; a hot fingerprint is one row by then
    firsts = cut(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(fingerprint_links(firsts.select("fp"), radius))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)  # fingerprints without a link are their own root
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(key), "fp", "component_id")


def candidates(nodes: DataFrame, tables: int = TABLES, radius: int = RING) -> DataFrame:
    """nodes: (m, fps), of distinct fingerprints. Pairs (a, b) of m that may be similar, a < b: few for each node."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        one = group.drop_duplicates("m")
        m, fps = one["m"].to_numpy(), np.stack(one["fps"].to_numpy()).view(np.uint64)
        found = np.array(list(local_candidates(fps, int(one["t"].iloc[0]), radius)), np.int64).reshape(-1, 2)
        a, b = m[found[:, 0]], m[found[:, 1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return _dealt(nodes, tables).groupBy("t", "leaf").applyInPandas(link, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) of the marks of sets (mark, hashes) that have the similarity."""
    left = pairs.join(sets.select(F.col("mark").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("mark").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(common >= F.lit(similarity) * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, tables: int = TABLES) -> DataFrame:
    """One document of each class of similar texts: that with the smallest id, ids before nulls, then the smallest text hash."""
    marked = stored(fingerprints(docs, key, text, shingle, tables), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("own").alias("own"))
    # a row for each different sequence of words, then for each different tuple of fingerprints
    kinds = cut(marked.groupBy("mark").agg(F.min(order).alias("first"), F.min("fps").alias("fps")))
    tuples = cut(kinds.groupBy("fps").agg(F.min("mark").alias("m")))
    mates = kinds.join(tuples, "fps").where("mark <> m").select(F.least("mark", "m").alias("a"), F.greatest("mark", "m").alias("b"))
    pairs = cut(candidates(tuples.select("m", "fps"), tables).unionByName(mates).distinct())
    # the shingles of those texts only that stand in a pair, read again by their rows' ids and hashes
    asked = pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct()
    rows = kinds.join(asked, "mark").select("mark", F.col("first.id").alias("__id"), F.col("first.own").alias("__own"))
    slim = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("own"), F.col(text).alias("text"))
    texts = slim.join(rows, slim["id"].eqNullSafe(F.col("__id")) & (slim["own"] == F.col("__own"))).dropDuplicates(["mark"]).select("mark", "text")
    sets = stored(with_shingles(texts, "text", shingle).select("mark", F.array_distinct("hashes").alias("hashes")), "shingles")
    links = verified(pairs, sets, similarity)
    roots = connected_components(links).withColumnRenamed("node", "mark")
    rooted = kinds.select("mark", "first").join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    # what goes: rows of other kinds than their class's first, and of its kind those with another id or text
    chosen = rooted.join(keep, "root").select("mark", "kept")
    gone = marked.join(chosen, "mark").where(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("own") == F.col("kept.own"))))
    gone = stored(gone.select(F.col("id").alias("__id"), F.col("own").alias("__own")).distinct(), "gone")
    packed = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = packed.join(gone, packed["id"].eqNullSafe(F.col("__id")) & (packed["own"] == F.col("__own")), "left_anti")
    # rows that repeat both id and text are told apart only if there are any
    repeated = not marked.groupBy("id", "own").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (kept.dropDuplicates(["id", "own"]) if repeated else kept).select("row.*")
