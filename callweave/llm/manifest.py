"""Merkle manifest of a dataset: a hash tree per group of rows, a tree over the groups, and a proof for every row.

The place of a row among its group's rows, by key, is found without a global sort. Digits of the key are counted per
group: sums over the counts of smaller digits give each digit's first rank exactly. A digit with more than
`BUCKET_ROWS` rows is counted again by its next digits, and so on through key, digest and row number, until each
bucket is small enough to be put in order by itself; a bucket's first rank and the order inside it give exact ranks,
whether one group holds a third of all rows or many rows share a key.

A rank's digits to the base of the fanout are the row's way through the tree: a node is keyed by its group and the
leading digits that its rows have in common. `LEVELS` trailing digits are reduced in one exchange: rows that share the
prefix before them form a subtree of at most fanout ** LEVELS leaves, whose root is keyed by that prefix. Going down,
each subtree's root hands the siblings of its way to the top on to its members (cogrouped, one row per subtree), so
proofs are folded where their leaves are, and are never moved.

Edge cases: null groups are a group of their own, first in order; null keys come before all others of their group; any
null field counts as `-`; rows with one key are in order of their digests, and equal rows have ranks of their own; a
group of one row has its leaf as its root; an empty table gives an empty result; other columns do not matter. Rows
without a key are never tampered with by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT, LEVELS = 3, 7
#: Rows that one bucket may hold before it is counted by further digits; most digits of one count, and bits of the later ones.
BUCKET_ROWS, FIRST_DIGITS, NEXT_BITS = 4096, 1 << 16, 12


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256 of the fields, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# ---------------------------------------------------------------- ranks


def number_digits(column: Column, low: int, high: int, rows: int) -> list[Column]:
    """Digits of a whole number between low and high, the first one with about a bucket's rows or finer."""
    wanted = min(FIRST_DIGITS, max(16, 4 * rows // BUCKET_ROWS))
    shift = 0
    while (high >> shift) - (low >> shift) >= wanted:
        shift += 1
    found = [F.shiftright(column, shift)]
    while shift:
        width = min(NEXT_BITS, shift)
        shift -= width
        found.append(F.shiftright(column, shift).bitwiseAND(F.lit((1 << width) - 1)))
    return found


def text_digits(column: Column, size: int) -> list[Column]:
    """Two bytes a digit of a text of at most `size` bytes; an ended text comes before all others with its prefix."""
    raw = column.cast("binary")
    pair = lambda i: F.rpad(F.hex(F.substring(raw, 2 * i + 1, 2)), 4, "0")
    place = lambda i: F.conv(pair(i), 16, 10).cast("long") * 3 + F.least(F.greatest(F.octet_length(raw) - 2 * i, F.lit(0)), F.lit(2))
    return [place(i) for i in range((size + 1) // 2)]


def ranked(rows: DataFrame, group: str, digits: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """rows with `rank`, the place from 0 in their group by digits and then `order`; rows must be stored or read, for they are read again.

    `group` holds no null. A count per digit, made with map-side sums, is all that is exchanged until the buckets are small.
    """
    level = Window.partitionBy(group, "__base").orderBy(F.col("__digit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed, done = rows.withColumn("__base", F.lit(0).cast("long")), []
    for digit in digits:
        open_ = placed.withColumn("__digit", digit)
        counts = open_.groupBy(group, "__base", "__digit").agg(F.count("*").alias("__n"))
        counts = stored(counts.withColumn("__first", F.col("__base") + F.coalesce(F.sum("__n").over(level), F.lit(0))), "digits")
        names = {c: f"_{c}" for c in (group, "__base", "__digit")}
        keys = counts.select(*[F.col(c).alias(n) for c, n in names.items()], "__first", "__n")
        same = (F.col(group) == F.col(names[group])) & (F.col("__base") == F.col("___base")) & F.col("__digit").eqNullSafe(F.col("___digit"))
        joined = open_.join(keys, same).drop(*names.values(), "__base", "__digit").withColumnRenamed("__first", "__base")
        done.append(joined.where(F.col("__n") <= BUCKET_ROWS).drop("__n"))
        if counts.where(F.col("__n") > BUCKET_ROWS).isEmpty():
            break
        placed = joined.where(F.col("__n") > BUCKET_ROWS).drop("__n")
    else:
        done.append(placed)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    inside = Window.partitionBy(group, "__base").orderBy(*order)
    return out.withColumn("rank", F.col("__base") + F.row_number().over(inside) - 1).drop("__base")


# ---------------------------------------------------------------- trees


def joined_digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth_of(n: int, fanout: int = FANOUT) -> int:
    depth, size = 0, 1
    while size < n:
        depth, size = depth + 1, size * fanout
    return depth


def subtree(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from the given ones upwards."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([joined_digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def way(tree: list[list[str]], i: int, fanout: int) -> list[str]:
    """Left and right siblings, joined, of each level on the way from place i to the top."""
    out = []
    for level in tree[:-1]:
        first = i - i % fanout
        out += ["".join(level[first:i]), "".join(level[i + 1 : first + fanout])]
        i //= fanout
    return out


def folded(digest: str, siblings: Sequence[str]) -> str:
    """The root that a digest and the siblings on its way give."""
    for left, right in zip(siblings[0::2], siblings[1::2], strict=True):
        digest = joined_digest((left, digest, right))
    return digest


def _levels(n: int, below: int, fanout: int, levels: int) -> int:
    return max(0, min(levels, depth_of(n, fanout) - below))


def _prefix(fanout: int, levels: int) -> Column:
    return F.expr(f"rank div {fanout**levels}").alias("prefix")


def reduced(nodes: DataFrame, below: int, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, n, rank, digest) of the level `below` -> the same columns, `levels` levels further up."""

    def reduce(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        n = int(part["n"].iloc[0])
        top = subtree(part["digest"].tolist(), _levels(n, below, fanout, levels), fanout)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "n": [n], "rank": [key[1]], "digest": [top]})

    return nodes.groupBy("tree", _prefix(fanout, levels)).applyInPandas(reduce, "tree long, n long, rank long, digest string")


def ways(nodes: DataFrame, above: DataFrame, below: int, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, n, rank, digest) and above (tree, rank, siblings, top) of the level that they reduce to -> (tree, rank, siblings, top)."""

    def hand_on(key: tuple, part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        tree = subtree(part["digest"].tolist(), _levels(int(part["n"].iloc[0]), below, fanout, levels), fanout)
        rest, tops = list(top["siblings"].iloc[0]), list(top["top"].iloc[0])
        found = [way(tree, i, fanout) + rest for i in range(len(part))]
        return pd.DataFrame({"tree": part["tree"], "rank": part["rank"], "siblings": found, "top": [tops] * len(part)})

    left, right = nodes.groupBy("tree", _prefix(fanout, levels)), above.groupBy("tree", F.col("rank").alias("prefix"))
    return left.cogroup(right).applyInPandas(hand_on, "tree long, rank long, siblings array<string>, top array<string>")


def grown(nodes: DataFrame, deepest: int, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes at each exchanged level, the given ones first; the last, never the given one, has one node for each tree."""
    out = [nodes]
    for below in range(0, max(deepest, 1), levels):
        out.append(stored(reduced(out[-1], below, fanout, levels), "nodes"))
    return out


def manifest(docs: DataFrame, key: str, group: str, leaf: Column, altered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `altered` is the digest that a row shows when it is checked, null where it is the leaf itself.
    """
    shown = F.lit(None).cast("string") if altered is None else altered
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(group).alias("group"), leaf.alias("leaf"), shown.alias("altered"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "leaves")  # row numbers are as written from here on
    ends = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    groups = stored(rows.groupBy("group").agg(F.count("*").alias("n")).withColumn("all", F.lit(0).cast("long")), "groups")
    sizes = groups.agg(F.max(F.octet_length(F.col("group").cast("binary"))), F.max("n"), F.count("*")).first()
    trees = ranked(groups, "all", text_digits(F.col("group"), sizes[0] or 1), [F.col("group").asc_nulls_first()])
    trees = stored(trees.select("group", "n", F.col("rank").alias("tree")), "trees")  # of known size: broadcast below the threshold
    named = rows.join(trees.withColumnRenamed("group", "__group"), F.col("group").eqNullSafe(F.col("__group"))).select("tree", "n", "key", "leaf", "altered", "row")
    digits = number_digits(F.col("key"), ends[0] or 0, ends[1] or 0, ends[2])
    digits += [F.conv(F.substring("leaf", i, 4), 16, 10).cast("long") for i in range(1, 65, 4)]
    digits += [F.shiftright("row", s).bitwiseAND(F.lit((1 << NEXT_BITS) - 1)) for s in range(60, -1, -NEXT_BITS)]
    leaves = ranked(named, "tree", digits, [F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")])
    leaves = stored(leaves.withColumnRenamed("leaf", "digest"), "ranked")
    nodes = grown(leaves, depth_of(sizes[1] or 0, fanout), fanout, levels)
    # the tree over the groups has their roots as its leaves
    roots = nodes[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(sizes[2]).cast("long").alias("n"), F.col("tree").alias("rank"), "digest")
    over = grown(roots, depth_of(sizes[2], fanout), fanout, levels)
    way_up = over[-1].select("tree", "rank", F.array().cast("array<string>").alias("siblings"), F.array("digest").alias("top"))
    for i in range(len(over) - 2, -1, -1):
        way_up = ways(over[i], way_up, i * levels, fanout, levels)
    firsts = way_up.select(F.col("rank").alias("__tree"), "siblings", F.col("top")[0].alias("root"))
    way_up = nodes[-1].join(firsts, F.col("tree") == F.col("__tree")).select("tree", "rank", "siblings", F.array("digest", "root").alias("top"))
    for i in range(len(nodes) - 2, 0, -1):
        way_up = ways(nodes[i], way_up, i * levels, fanout, levels)
    schema = f"`{key}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(_: tuple, part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        tree = subtree(part["digest"].tolist(), _levels(int(part["n"].iloc[0]), 0, fanout, levels), fanout)
        rest, (subroot, root) = list(top["siblings"].iloc[0]), top["top"].iloc[0]
        proofs = [way(tree, i, fanout) + rest for i in range(len(part))]
        roots = [folded(a or d, p) for a, d, p in zip(part["altered"], part["digest"], proofs, strict=True)]
        out = {key: part["key"].astype("Int64"), "leaf": part["digest"], "subroot": subroot, "root": root}
        return pd.DataFrame(out | {"proof_sha256": [joined_digest(p) for p in proofs], "folded_root": roots, "verified": [r == root for r in roots]})

    left, right = leaves.groupBy("tree", _prefix(fanout, levels)), way_up.groupBy("tree", F.col("rank").alias("prefix"))
    return left.cogroup(right).applyInPandas(prove, schema)
