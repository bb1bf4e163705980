"""Joins beyond plain keys: overlays, key ladders, longest containment, hierarchies, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder_join(left: DataFrame, right: DataFrame, left_key: Column, keys: Sequence[Column], id_: str, name: str = "match") -> DataFrame:
    """left with the right id found by the first of several keys; among equals the smallest id.

    The right side becomes one row per key value, so it is one equi-join, whatever the number of keys.
    """
    spread = right.select(F.col(id_).alias("__id"), F.posexplode(F.array(*keys))).where(F.coalesce(F.col("col"), F.lit("")) != "")
    best = spread.groupBy(F.col("col").alias("__key")).agg(F.min(F.struct(F.col("pos"), F.col("__id"))).alias("__best"))
    return left.join(best, left_key == F.col("__key"), "left").select(left["*"], F.col("__best.__id").alias(name))


def longest_contained(left: DataFrame, right: DataFrame, key: str, text: str, term: str, id_: str, shortest: int = 5) -> DataFrame:
    """left with the longest right term that its text holds as whole words, ties by term; one row for each key of the left.

    Terms meet texts on their first word, an equi-join; containment is verified after it. Texts are joined by key once.
    """
    terms = right.where(F.length(term) >= shortest).select(F.lower(term).alias("__term"), F.col(id_).alias("__id")).groupBy("__term").agg(F.min("__id").alias("__id"))
    terms = terms.withColumn("__first", F.regexp_extract("__term", r"^(\S+)", 1))
    words = left.select(F.col(key).alias("__k"), F.lower(text).alias("__text"), F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("__word"))
    hits = words.join(terms, F.col("__word") == F.col("__first")).where(F.contains(F.concat(F.lit(" "), F.col("__text"), F.lit(" ")), F.concat(F.lit(" "), F.col("__term"), F.lit(" "))))
    return _with_longest(left, hits, key)


def _with_longest(left: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    best = hits.groupBy("__k").agg(F.max(F.struct(F.length("__term").alias("n"), F.col("__term").alias("t"), F.col("__id").alias("i"))).alias("__best"))
    return left.join(best, F.col(key) == F.col("__k"), "left").select(*[left[c] for c in left.columns], F.col("__best.t").alias("term"), F.col("__best.i").alias("match"))


def contained_either_way(left: DataFrame, right: DataFrame, key: str, text: str, term: str, id_: str, shortest: int = 5) -> DataFrame:
    """left with the longest right term that holds its text, or is held by it, letter by letter from `shortest` characters on.

    Whichever is held begins with `shortest` characters that are a run of the holder: the join is on these runs of
    distinct names, never of all pairs.
    """
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (shortest - 1)), lambda i: F.substr(F.col(c), i, F.lit(shortest)))))
    terms = right.where(F.length(term) >= shortest).select(F.lower(term).alias("__term"), F.col(id_).alias("__id")).groupBy("__term").agg(F.min("__id").alias("__id"))
    texts = left.select(F.col(key).alias("__k"), F.lower(text).alias("__text")).where(F.length("__text") >= shortest)
    head = lambda c: F.left(c, F.lit(shortest)).alias("__run")
    holds = texts.select("*", runs("__text").alias("__run")).join(terms.select("*", head("__term")), "__run").where(F.contains("__text", "__term"))
    held = texts.select("*", head("__text")).join(terms.select("*", runs("__term").alias("__run")), "__run").where(F.contains("__term", "__text"))
    cols = ["__k", "__term", "__id"]
    return _with_longest(left, holds.select(*cols).unionByName(held.select(*cols)), key)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. max(struct) combines on the map side, where a window would shuffle every row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows, and the existing ones without a successor."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def gap_fill(existing: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], frozen: Sequence[str] = ()) -> DataFrame:
    """Blanks of existing rows filled from incoming ones, nothing overwritten; contradictions are listed.

    New keys are added; `frozen` fields of known keys never change, not even when blank.
    """
    empty = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    old, new = existing.select(F.col(key), F.lit(True).alias("__known"), *[F.col(f).alias(f"o_{f}") for f in fields]), incoming.select(F.col(key), *[F.col(f).alias(f"n_{f}") for f in fields])
    both = old.join(new, key, "full")
    known = F.col("__known").isNotNull()
    out = [F.when(~known, F.col(f"n_{f}")).when(empty(F.col(f"o_{f}")) & F.lit(f not in frozen), F.col(f"n_{f}")).otherwise(F.col(f"o_{f}")).alias(f) for f in fields]
    clash = [F.when(known & ~empty(F.col(f"o_{f}")) & ~empty(F.col(f"n_{f}")) & ~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(f)) for f in fields]
    return both.select(key, *out, F.array_join(F.array_compact(F.array(*clash)), ",").alias("conflicts"))


def chain(edges: DataFrame, child: str, parent: str, most: int = 100) -> DataFrame:
    """(node, ancestor, hops) for every ancestor; a cycle raises. By doubling: log2(most) joins instead of one per hop."""
    step = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("hops"))
    reached, span, before = step.checkpoint(), 1, -1
    while True:
        n, loops, one = reached.agg(F.count("*"), F.count_if(F.col("node") == F.col("ancestor")), F.min(F.when(F.col("node") == F.col("ancestor"), F.col("node")))).first()
        if loops:
            raise ValueError(f"the parents of {one} form a cycle")
        if n == before or span >= most:
            return reached
        far = reached.where(F.col("hops") == span)  # what is further lies beyond these, so that a row meets few
        further = far.alias("a").join(reached.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        reached = reached.unionByName(further).groupBy("node", "ancestor").agg(F.min("hops").alias("hops")).checkpoint()
        span, before = span * 2, n


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """Adds `session`, counted per key; a new one begins after a pause longer than the gap."""
    order = Window.partitionBy(*keys).orderBy(time, *[c for c in df.columns if c.endswith("_id")])
    at = F.unix_micros(F.col(time).cast("timestamp"))
    pause = at - F.lag(at).over(order)
    marked = df.withColumn("__new", F.coalesce(pause > gap_seconds * 1_000_000, F.lit(True)).cast("int"))
    return marked.withColumn("session", F.sum("__new").over(order)).drop("__new")
