"""Sinks and state on plain files: shared folders, upserts, watermarked backups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import upsert


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local master that has none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return (folder or f"file://{tempfile.mkdtemp(prefix='callweave-')}").rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/callweave-{label}-{uuid.uuid4().hex}"


def upsert_parquet(spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str], next_path: str) -> DataFrame:
    """Writes the merged table beside the old one: a reader never sees half a rewrite. Returns the new table."""
    old = spark.read.parquet(path)
    upsert(old, incoming, keys).write.mode("errorifexists").parquet(next_path)
    return spark.read.parquet(next_path)


def newer_than(df: DataFrame, stamps: Sequence[str], watermark: str) -> DataFrame:
    """Rows with any of their time stamps past the watermark."""
    mark: Column = F.lit(watermark).cast("timestamp")
    return df.where(reduce(or_, (F.coalesce(F.col(c) > mark, F.lit(False)) for c in stamps)))


def backup(df: DataFrame, stamps: Sequence[str], watermark: str, path: str) -> int:
    """Writes what is new since the watermark and returns its row count; nothing new writes nothing."""
    rows = newer_than(df, stamps, watermark)
    n = rows.count()
    if n:
        rows.write.mode("errorifexists").parquet(path)
    return n


def export_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; nested columns as JSON text."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.option("header", True).option("quoteAll", True).csv(path)


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header names made comparable: lower case, blanks and dashes as underscores; blanks stay blank."""
    df = spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").csv(path)
    return df.toDF(*["_".join(c.lower().replace("-", " ").split()) for c in df.columns]).fillna("")


def changed_pages(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed or changed, by content hash; only hashes are shuffled."""
    old = before.select(key, F.sha2(content, 256).alias("old"))
    new = after.select(key, F.sha2(content, 256).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return old.join(new, key, "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, kind.alias("change"))
