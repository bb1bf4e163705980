"""State kept between runs: memoised scores, ledgers, diffs, job states."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memoised(rows: DataFrame, memo: DataFrame, key: str, content: Sequence[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new memo (key, hash, score): only rows whose content hash is new are scored; keys that are gone leave.

    Joins carry hashes and scores; the scored rows alone carry content.
    """
    hashed = rows.withColumn("hash", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content]), 256))
    known = hashed.select(key, "hash").join(memo, [key, "hash"]).select(key, "hash", "score")
    fresh = hashed.join(memo.select(key, "hash"), [key, "hash"], "left_anti")
    return known.unionByName(score(fresh).select(key, "hash", "score"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) where normalised values differ; blank and null are alike."""
    norm = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    both = before.select(key, F.struct(*fields).alias("o")).join(after.select(key, F.struct(*fields).alias("n")), key)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), norm(F.col(f"o.{f}")).alias("old"), norm(F.col(f"n.{f}")).alias("new")) for f in fields]))
    return both.select(key, rows.alias("x")).select(key, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


def blank_filled(rows: DataFrame, donor: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """rows with blanks filled from the donor's columns, and the names of those filled."""
    side = donor.select(key, *[F.col(f).alias(f"d_{f}") for f in fields])
    joined = rows.join(side, key, "left")
    blank = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
    source = F.array_join(F.array_compact(F.array(*[F.when(blank(f) & F.col(f"d_{f}").isNotNull(), F.lit(f)) for f in fields])), ",")
    return joined.select(key, *[F.when(blank(f), F.col(f"d_{f}")).otherwise(F.col(f)).alias(f) for f in fields], source.alias("from_donor"))


#: Which state a job may go to.
MOVES = {"queued": ("dispatched", "failed"), "dispatched": ("running", "failed"), "running": ("done", "failed"), "done": (), "failed": ("queued",)}


def may_move(now: Column, wanted: Column) -> Column:
    out = F.lit(False)
    for state, nexts in MOVES.items():
        if nexts:
            out = out | ((now == state) & wanted.isin(*nexts))
    return F.coalesce(out, F.lit(False))
