"""Top-k, rails and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_bucket(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first bucket whose condition holds; so buckets are exclusive."""
    out = F.when(F.lit(False), F.lit(""))
    for name, condition in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows of each group, with their place. Spark keeps n rows per group and task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn("place", place).where(F.col("place") <= n)


def capped_top(df: DataFrame, key: str, order: Sequence[Column], cap: int, n: int) -> DataFrame:
    """The n first rows with at most `cap` of a key; if too few, the others follow in order.

    Only n rows of either kind can be needed, so the last window sees 2 n rows.
    """
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    within = ranked.where(F.col("__k") <= cap).orderBy(*order).limit(n).withColumn("__late", F.lit(0))
    beyond = ranked.where(F.col("__k") > cap).orderBy(*order).limit(n).withColumn("__late", F.lit(1))
    both = within.unionByName(beyond)
    place = F.row_number().over(Window.orderBy("__late", *order)).cast("long")
    return both.withColumn("place", place).where(F.col("place") <= n).drop("__k", "__late")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def dense_ids(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Numbers 1, 2, ... in a global order: a range-partitioned sort, partition counts, and offsets.

    The ranges come from a sample, so the ranged rows are kept: counts and numbers must see the same partitions.
    """
    ordered = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    numbered = ordered.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = ordered.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    return numbered.join(offsets, "__p").withColumn(name, (F.col("__n") + F.col("__o")).cast("long")).drop("__p", "__n", "__o", "__c")
