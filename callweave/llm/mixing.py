"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source asks for its weight's share of the budget and stops at `max_epochs` times its own size; what the
stopped ones leave is shared by weight among the others until none is above its cap. A source with ratio
r = target / size takes every document floor(r) times and, for the fraction, the documents first in a seeded
order until the missing words are reached. The cut in that order is one key per source, so the documents are
only joined with one small row per source and their texts are never shuffled.

Edge cases: a null source is a source of its own, ordered last; null and empty texts have size 0 and are taken
as often as the ratio says, with 0 words; a source of size 0 has target 0; repeated rows share one key and are
taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, word_count

SEED = 20240607
#: Rows per histogram bucket aimed at, and the most buckets of one source.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1 << 16


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) -> one row per source with its weight and its capped, water-filled target.

    In the order of cap / weight the stopped sources come first, so one pass over running sums finds the level.
    The windows span the sources, one row each, not the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = named.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("stopped"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the level of the first source that stays below its cap; none: all stop
    first = levels.withColumn("fill", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return first.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("fill") * F.col("weight")), F.col("cap")).alias("target"))


def _order_key(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def repetition_plan(slim: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int = SEED) -> DataFrame:
    """slim: (key, source, size). One row per source: source_size, target, whole repetitions, and the last key taken once more."""
    rows = slim.withColumn("h", _order_key(F.col("key"), seed))
    sizes = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    targets = cut(source_targets(sizes.drop("rows"), weights, share, max_epochs))
    n = F.greatest(F.lit(16), F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("rows") / BUCKET_ROWS)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    params = targets.join(sizes.select(F.col("source").alias("__s"), n.alias("buckets")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    params = params.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    params = cut(params)
    # the hash as a number from 0 to 1 falls into one of the source's buckets; map-side sums make a histogram
    place = lambda h, b: F.least(F.floor((h.cast("double") / F.lit(float(1 << 64)) + 0.5) * b), b - 1)
    keyed = rows.join(params.select(F.col("source").alias("__s"), "buckets", "need"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    keyed = keyed.withColumn("bucket", place(F.col("h"), F.col("buckets")))
    histogram = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    running = Window.partitionBy("source").orderBy("bucket")
    crossing = histogram.withColumn("upto", F.sum("words").over(running)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")) & (F.col("words") > 0))
    crossing = crossing.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), (F.col("upto") - F.col("words")).alias("base"))
    # only the documents of the one bucket in which a source's sum is reached are put in order
    inside = keyed.join(crossing, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    ordered = Window.partitionBy("source").orderBy("h", "key")
    sums = inside.groupBy("source", "h", "key", "base", "need").agg(F.sum("size").alias("size"))  # repeated rows share a key
    sums = sums.withColumn("upto", F.col("base") + F.sum("size").over(ordered))
    # up to the document that brings the sum nearest to the need
    taken = sums.where(F.col("upto") - F.col("size") / 2 <= F.col("need"))
    last = taken.groupBy(F.col("source").alias("__s")).agg(F.max(F.struct("h", "key")).alias("last"))
    none = crossing.groupBy("__s").agg((F.min("__b")).alias("first_bucket"))
    out = params.join(last, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    out = out.join(none, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return out.select("source", "source_size", "target", "whole", "last", "first_bucket", "buckets")


def with_repetitions(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED, name: str = "copies") -> DataFrame:
    """docs with the number of times each is taken, and its source's size and target."""
    h = _order_key(F.col(key), seed)
    bucket = F.least(F.floor((h.cast("double") / F.lit(float(1 << 64)) + 0.5) * F.col("__buckets")), F.col("__buckets") - 1)
    p = plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("last").alias("__last"), F.col("first_bucket").alias("__first"), F.col("buckets").alias("__buckets"))
    joined = docs.join(p, docs[source].eqNullSafe(F.col("__source")), "left")
    before = bucket < F.col("__first")
    here = (bucket == F.col("__first")) & F.coalesce(F.struct(h.alias("h"), F.col(key).alias("key")) <= F.col("__last"), F.lit(False))
    extra = F.coalesce(before | here, F.lit(False)).cast("int")
    return joined.withColumn(name, (F.coalesce(F.col("__whole"), F.lit(0)) + extra).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    slim = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    plan = stored(repetition_plan(slim, weights, share, max_epochs, seed), "mix")  # a file of known size: a broadcast below the threshold, a join beyond it
    out = with_repetitions(slim, plan, "key", "source", seed)
    return out.select(F.col("key").alias(key), F.col("source"), "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    slim = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    plan = stored(repetition_plan(slim, weights, share, max_epochs, seed), "mix")
    packed = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counted = with_repetitions(packed, plan, "key", "source", seed).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
