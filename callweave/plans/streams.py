"""Streams over landed event files, run to their end; the result is what the sink holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import ensure_checkpoints
from ..streaming import ingest, jobs, ledger
from .carriers import read
from .dedup import titled_calls

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATE = "40 days"


def _sink(spark: SparkSession, sf_dir: str, stream: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Runs a stream over the events with a last, far later row that lets the watermark close all windows."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").write.parquet(f"{folder}/in")
    jobs.run_to_end(stream(jobs.landed(spark, f"{folder}/in", SCHEMA)), f"{folder}/out", f"{folder}/state", mode)
    # a second file moves the watermark on; the query goes on from its checkpoint
    end = spark.createDataFrame([(-1,)], "event_id long").select("event_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    end.write.mode("append").parquet(f"{folder}/in")
    jobs.run_to_end(stream(jobs.landed(spark, f"{folder}/in", SCHEMA)), f"{folder}/out", f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sink(spark, sf_dir, lambda e: jobs.tumbling(e, "ts", ["event_type"], "1 day", LATE)).where("event_type <> 'end'")


@query("""SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sink(spark, sf_dir, lambda e: jobs.session_counts(e, "ts", "user_id", "6 hours", LATE)).where("user_id >= 0")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _sink(spark, sf_dir, lambda e: jobs.once_within(e, "ts", ["user_id", "event_type"], LATE).select("user_id", "event_type"))
    return kept.where("user_id >= 0")


@query()
def two_phase_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls in two landings, each taken in as a batch: the second is judged against what the first has stored."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ingest-{uuid.uuid4().hex}"
    rows = titled_calls(spark, sf_dir)
    (half,) = read(spark, sf_dir, "orders").approxQuantile("o_orderkey", [0.5], 0.01)
    for part in (F.col("id") < half, F.col("id") >= half):  # as many files as tasks wrote; all that has landed is a batch
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        ingest.run(jobs.landed(spark, f"{folder}/in", ingest.CALL, per_trigger=1 << 30), f"{folder}/out", f"{folder}/state")
    return ingest.stored_rows(spark, f"{folder}/out", ingest.CALL).select("id", "verdict", "lead", "rule")


#: Sightings and tombstones from the events; others than tombstones arrive up to two days late.
_DEADLINE, _POSTED = "CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + CAST(floor(value) AS INT) % 25 END", "CASE WHEN event_id % 4 = 1 THEN CAST(ts AS DATE) - CAST(floor(value) AS INT) % 9 END"
_SIGHTINGS = f"""SELECT user_id * 7 + event_id % 7 AS uid, event_id, ts, CASE WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'tombstone' ELSE 'seen' END AS kind,
 {_DEADLINE} AS deadline, {_POSTED} AS posted, CASE WHEN event_id % 5 = 2 THEN event_id % 2 = 0 END AS rolling FROM events"""
STALE, LEDGER_AS_OF, LEDGER_LATE = 6, "2024-01-28", "3 days"


@query(f"""WITH e AS ({_SIGHTINGS}), t AS (SELECT uid, min(ts) FILTER (kind = 'tombstone') AS tomb FROM e GROUP BY 1), s AS (SELECT e.*, tomb FROM e JOIN t USING (uid) WHERE kind = 'seen'),
 a AS (SELECT uid, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(deadline, (ts, event_id)) FILTER (deadline IS NOT NULL) AS deadline, arg_min(posted, (ts, event_id)) FILTER (posted IS NOT NULL) AS posted, arg_min(rolling, (ts, event_id)) FILTER (rolling IS NOT NULL) AS rolling FROM s WHERE tomb IS NULL OR ts < tomb GROUP BY 1),
 c AS (SELECT t.uid, tomb, first_seen, last_seen, deadline, posted, rolling, (SELECT count(*) FROM s WHERE s.uid = t.uid AND s.ts >= t.tomb) AS suppressed,
  CASE WHEN tomb IS NOT NULL THEN NULL WHEN deadline IS NOT NULL THEN CAST(deadline + 1 AS TIMESTAMP) ELSE least(last_seen + INTERVAL {STALE} DAY, CASE WHEN posted IS NOT NULL AND NOT coalesce(rolling, false) THEN CAST(posted + {STALE} AS TIMESTAMP) END) END AS ends FROM t LEFT JOIN a USING (uid))
 SELECT uid, CASE WHEN tomb IS NOT NULL THEN 'tombstoned' WHEN ends <= TIMESTAMP '{LEDGER_AS_OF}' THEN 'closed' ELSE 'open' END AS status, date_trunc('second', first_seen) AS first_seen, date_trunc('second', last_seen) AS last_seen, deadline, posted, rolling, suppressed, date_trunc('second', CASE WHEN ends <= TIMESTAMP '{LEDGER_AS_OF}' THEN ends END) AS closed_at FROM c""")
def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing of all calls after late sightings, tombstones and timers, as of the watermark."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ledger-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").createOrReplaceTempView("ledger_events")
    events = spark.sql(_SIGHTINGS.replace("FROM events", "FROM ledger_events"))
    spark.catalog.dropTempView("ledger_events")
    arrival = F.to_date("ts") + F.when(F.col("kind") == "tombstone", 0).otherwise(F.col("event_id") % 3).cast("int")
    days = events.withColumn("week", F.floor(F.datediff(arrival, F.lit("2024-01-01")) / 7))
    for week in range(5):  # by the day of arrival, some days a file
        days.where(F.col("week") == week if week < 4 else F.col("week") >= week).drop("week").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    mark = spark.range(1).selectExpr("-id - 1 uid", "-id - 1 event_id", f"timestamp '{LEDGER_AS_OF}' + interval {LEDGER_LATE} ts", "'mark' kind", "cast(null as date) deadline", "cast(null as date) posted", "cast(null as boolean) rolling")
    for _ in range(2):  # the watermark arrives with the first and acts with the second
        mark.write.mode("append").parquet(f"{folder}/in")
    kept = {k: spark.conf.get(k, None) for k in ledger.STORE}
    for k, v in ledger.STORE.items():
        spark.conf.set(k, v)
    try:
        schema = "uid long, event_id long, ts timestamp, kind string, deadline date, posted date, rolling boolean"
        jobs.run_changes(ledger.call_changes(jobs.landed(spark, f"{folder}/in", schema, per_trigger=1), LEDGER_LATE, STALE), f"{folder}/out", f"{folder}/state")
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = ledger.standing(spark.read.parquet(f"{folder}/out").drop("batch")).where("uid >= 0")
    return out.withColumns({c: F.date_trunc("second", c) for c in ("first_seen", "last_seen", "closed_at")})
