"""Aggregations: gap-filled buckets, funnels, concentration, cross-tabs. All combine on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket_range, bucket_start


def bucketed(df: DataFrame, date: str, kind: str, value: Column | None = None) -> DataFrame:
    """(bucket, n[, total]) with a row for every bucket from the first to the last; empty ones hold 0.

    The calendar is made from the aggregated bounds, one row, so only aggregates are joined.
    """
    sums = {"n": F.count("*")} | ({"total": F.sum(value)} if value is not None else {})
    counts = df.where(F.col(date).isNotNull()).groupBy(bucket_start(F.col(date), kind).alias("bucket")).agg(*[c.alias(k) for k, c in sums.items()])
    calendar = counts.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low is not null").select(F.explode(bucket_range(F.col("low"), F.col("high"), kind)).alias("bucket"))
    return calendar.join(counts, "bucket", "left").select("bucket", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in sums])


def intake(df: DataFrame, key: str, duplicate: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(duplicate).alias("dups")).withColumn("unique_rows", F.col("total") - F.col("dups"))


def mode_label(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Rows per key with the most frequent spelling; ties go to the alphabetically first."""
    counts = df.groupBy(key.alias("key"), F.col(label)).agg(F.count("*").alias("n"))
    # the least of (-count, label) is one aggregate, no window over the key
    best = counts.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("minus"), F.col(label).alias("label"))).alias("best"))
    return best.select("key", "n", F.col("best.label").alias("label"))


def funnel(df: DataFrame, keys: Sequence[str], stages: Mapping[str, Column], values: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts of nested stages (each holds only where all before it do), and sums of a value per stage."""
    reached, out = F.lit(True), []
    for name, condition in stages.items():
        reached = reached & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(reached).alias(name))
        if values and name in values:
            out.append(F.coalesce(F.sum(F.when(reached, values[name])), F.lit(0)).alias(f"{name}_value"))
    return df.groupBy(*keys).agg(*out)


def fixed_order(df: DataFrame, value: str, vocabulary: Sequence[str]) -> DataFrame:
    """Counts over a vocabulary in its order, 0 where a value is missing; other values are left out."""
    terms = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(vocabulary)], "place int, value string")
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return terms.join(counts, "value", "left").select("place", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: sum, share of all in per cent (one decimal) and rank. The windows span aggregated keys."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    all_ = Window.partitionBy(F.lit(1))
    return sums.select(key, "total", F.round(100 * F.col("total") / F.sum("total").over(all_), 1).alias("share"), F.row_number().over(Window.orderBy(F.desc("total"), key)).cast("long").alias("place"))


def risk_band(share: Column) -> Column:
    return F.when(share >= 70, "High").when(share >= 40, "Medium").otherwise("Low")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of pairs with margins, as rows; margins are called ALL."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    counts = df.groupBy(name(rows).alias("r"), name(columns).alias("c")).agg(F.count("*").alias("n"))  # pairs first, then their margins
    return counts.cube("r", "c").agg(F.sum("n").alias("n")).select(F.coalesce("r", F.lit("ALL")).alias("row_value"), F.coalesce("c", F.lit("ALL")).alias("column_value"), "n")


def missingness(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, share missing in per cent); blank counts as missing."""
    lost = [F.count_if(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").alias(f) for f in fields]
    wide = df.groupBy(key).agg(F.count("*").alias("rows"), *lost)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("lost")) for f in fields]))
    return wide.select(key, "rows", pairs.alias("x")).select(key, F.col("x.field").alias("field"), F.round(100 * F.col("x.lost") / F.col("rows"), 1).alias("missing"))


def signed_outcome(decision: Column, secured: Column, requested: Column) -> Column:
    """Won money counts up, declined requests down, pending ones as asked."""
    asked = F.coalesce(requested, F.lit(0))
    return F.when(decision == "approved", F.coalesce(secured, asked)).when(decision == "declined", -asked).when(decision == "awaiting", asked).otherwise(F.lit(0))


def submission_weight(progress: Column, submissions: Column) -> Column:
    """A completed row counts its submissions, one at least; others count 0."""
    return F.when(F.coalesce(progress == "completed", F.lit(False)), F.greatest(F.coalesce(submissions.try_cast("long"), F.lit(1)), F.lit(1))).otherwise(F.lit(0)).cast("long")
