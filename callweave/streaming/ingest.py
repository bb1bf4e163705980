"""Two-phase runs: candidates are prepared in parallel, then taken in, a micro-batch at a time, against all that is stored.

Each batch is judged against the calls kept by earlier batches and by itself, and lands in a folder of its own number.
A batch that is run again reads only what earlier batches stored and overwrites itself, so a replay changes nothing. If
rows land in the order of their ids, any cut into batches ends in the rows of one run over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import RATIO, kept_and_dropped

CALL = "id long, oid string, link string, title string, funder string, deadline date, value long, countries array<string>"


def stored_rows(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """All judged rows with batch, verdict, lead and rule; only those of batches before a number, if one is given."""
    whole = f"{schema}, verdict string, lead long, rule string, batch int"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(folder)
    return rows if before is None else rows.where(F.col("batch") < before)


def take_in(batch: DataFrame, number: int, folder: str, schema: str = CALL, tombstones: DataFrame | None = None, least: float = RATIO) -> None:
    """Judges one batch and stores it: inserted, duplicate (with lead and rule) or suppressed (like a tombstone).

    A row whose id was stored before, or comes twice in a batch, is taken once. Stored calls are asked before tombstones.
    """
    spark = batch.sparkSession
    before = stored_rows(spark, folder, schema, number)
    rows = batch.dropDuplicates(["id"]).join(before.select("id"), "id", "left_anti").checkpoint()
    known = before.where("verdict = 'inserted'").select(rows.columns)
    verdicts = kept_and_dropped(rows, known, least, None if tombstones is None else tombstones.select(rows.columns))
    named = {c: f"_{c}" for c in ("id", "lead", "rule")}
    out = rows.join(verdicts.withColumnsRenamed(named), F.col("id") == F.col("_id"))
    verdict = F.when(F.col("_rule").isNull(), "inserted").when(F.startswith("_rule", F.lit("seen")), "suppressed").otherwise("duplicate")
    out.select(*rows.columns, verdict.alias("verdict"), F.col("_lead").alias("lead"), F.col("_rule").alias("rule")).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run(candidates: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, schema: str = CALL, tombstones: DataFrame | None = None) -> None:
    """Takes in all that has landed, batch by batch; a restart goes on where the checkpoint says."""
    ready = prepare(candidates) if prepare else candidates
    stream = ready.writeStream.foreachBatch(lambda batch, number: take_in(batch, number, folder, schema, tombstones))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def catalogue(rows: DataFrame, fill: Mapping[str, str] | None = None) -> DataFrame:
    """The inserted rows; the columns of `fill` (column -> condition for blank) take what their first duplicate has to say."""
    kept = rows.where("verdict = 'inserted'").drop("verdict", "lead", "rule", "batch")
    if not fill:
        return kept
    first = [F.min(F.when(~F.expr(blank), F.struct("id", F.col(c).alias("v")))).alias(f"_{c}") for c, blank in fill.items()]
    more = rows.where("verdict = 'duplicate'").groupBy(F.col("lead").alias("_lead")).agg(*first)
    joined = kept.join(more, F.col("id") == F.col("_lead"), "left")
    return joined.withColumns({c: F.when(F.expr(blank), F.coalesce(F.col(f"_{c}.v"), F.col(c))).otherwise(F.col(c)) for c, blank in fill.items()}).select(kept.columns)
