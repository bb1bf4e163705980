"""Scoring and gates over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as op
from ..registry import query
from .carriers import AS_OF, calls, read, with_calls

WEIGHTS = {"a": 3.0, "b": 2.0, "c": 1.0}
_SCORES_SQL = "CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END AS a, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END AS b, CASE (p_partkey // 4) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS c"
_PARTS = f"WITH s AS (SELECT p_partkey, p_size, {_SCORES_SQL} FROM part), x AS (SELECT *, 100 * (3.0 * coalesce(CAST(a AS DOUBLE), 0.5) + 2.0 * coalesce(CAST(b AS DOUBLE), 0.5) + coalesce(CAST(c AS DOUBLE), 0.5)) / 6.0 AS raw FROM s)"


def _scores() -> dict:
    k, s = F.col("p_partkey"), F.col("p_size")
    third = F.floor(k / 4) % 3
    return {
        "a": F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 0.5).when(k % 4 == 2, 0.0),
        "b": F.when(s % 3 == 0, 1.0).when(s % 3 == 1, 0.0),
        "c": F.when(third == 0, 1.0).when(third == 1, 0.5).otherwise(0.0),
    }


@query(f"{_PARTS} SELECT p_partkey, round_even(raw, 1) AS score FROM x")
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", op.alignment(_scores(), WEIGHTS).alias("score"))


@query(f"{_PARTS} SELECT p_partkey, CASE WHEN coalesce(a = 0, false) THEN 'Decline' WHEN round_even(raw, 1) >= 90 AND p_size < 10 THEN 'Park' WHEN round_even(raw, 1) >= 90 THEN 'Proceed' WHEN round_even(raw, 1) >= 70 THEN 'Park' ELSE 'Decline' END AS verdict, CASE WHEN coalesce(a = 0, false) THEN 'Decline' WHEN round_even(raw, 1) >= 70 THEN 'Proceed' WHEN round_even(raw, 1) >= 45 THEN 'Park' ELSE 'Decline' END AS legacy FROM x")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores()
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", op.alignment(s, WEIGHTS).alias("score"), (s["a"] == 0).alias("fatal"))
    return rows.select("p_partkey", op.recommend(F.col("score"), F.col("fatal"), floor=F.col("p_size") >= 10).alias("verdict"), op.legacy_recommend(F.col("score"), F.col("fatal")).alias("legacy"))


@query(f"{_PARTS} SELECT p_partkey, coalesce(a = 0, false) OR (coalesce(b = 0, false) AND c = 0) AS declined FROM x")
def decline_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores()
    return read(spark, sf_dir, "part").select("p_partkey", op.decline_flag([s["a"]], [s["b"], s["c"]]).alias("declined"))


@query(f"{_PARTS} SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN NULL ELSE a END AS DOUBLE) AS a FROM x")
def override_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    overrides = F.when(k == 0, F.create_map(F.lit("a"), F.lit(1.0))).when(k == 1, F.create_map(F.lit("a"), F.lit(None).cast("double"))).when(k == 2, F.create_map(F.lit("b"), F.lit(0.0)))
    return read(spark, sf_dir, "part").select("p_partkey", op.overridden("a", _scores()["a"], overrides).alias("a"))


@query(with_calls(f"""SELECT uid, CASE WHEN l AND b THEN 'Ample' WHEN l THEN 'Comfortable' WHEN s AND b THEN 'Tight' WHEN s THEN 'Very tight' WHEN b THEN 'Rushed' ELSE 'Not feasible' END AS effort FROM
 (SELECT uid, coalesce(date_diff('day', DATE '{AS_OF}', deadline) >= 14, true) AS l, coalesce(date_diff('day', DATE '{AS_OF}', deadline) >= 7, true) AS s, coalesce(nullif(submissions, 0) >= 3, true) AS b FROM calls)"""))
def bid_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.date_diff("deadline", F.to_date(F.lit(AS_OF)))
    return calls(spark, sf_dir).select("uid", op.bid_effort(days, F.nullif("submissions", F.lit(0))).alias("effort"))


@query(with_calls("SELECT uid, CAST(CASE WHEN cents IS NULL THEN NULL WHEN cents <= 5000000 + uid THEN 1.0 WHEN cents <= (5000000 + uid) * (2 + submissions) THEN 0.5 ELSE 0.0 END AS DOUBLE) AS fit FROM calls"))
def capacity_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", op.capacity(F.col("cents"), F.lit(5_000_000) + F.col("uid"), F.lit(2) + F.col("submissions")).alias("fit"))


@query(with_calls("SELECT uid, CAST(CASE WHEN cents < sqrt(1e6 * 1e7) THEN 0.0 WHEN cents < sqrt(1e7 * 3e7) THEN 0.5 WHEN cents IS NOT NULL THEN 1.0 END AS DOUBLE) AS quality FROM calls"))
def funding_quality_geomid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("uid", op.geometric_bands(F.col("cents"), F.lit(1e6), F.lit(1e7), F.lit(3e7)).alias("quality"))


@query(f"{_PARTS} SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'Not sure' WHEN coalesce(a = 0, false) OR coalesce(b = 0, false) THEN 'No' WHEN coalesce(a = 0.5, false) OR coalesce(b = 0.5, false) THEN 'Mostly' ELSE 'Yes' END AS label FROM x")
def must_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores()
    return read(spark, sf_dir, "part").select("p_partkey", op.qualification([s["a"], s["b"]]).alias("label"))


@query("SELECT p_partkey, CAST(round_even(0.6 * (p_size * 2) + 0.4 * (p_partkey % 101), 0) AS DOUBLE) AS score, CASE WHEN round_even(0.6 * (p_size * 2) + 0.4 * (p_partkey % 101), 0) >= 75 THEN 'High' WHEN round_even(0.6 * (p_size * 2) + 0.4 * (p_partkey % 101), 0) >= 45 THEN 'Medium' ELSE 'Low' END AS band FROM part")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, band = op.confidence((F.col("p_size") * 2).cast("decimal(10,1)"), (F.col("p_partkey") % 101).cast("decimal(10,1)"))
    return read(spark, sf_dir, "part").select("p_partkey", score.cast("double").alias("score"), band.alias("band"))


@query(f"""SELECT doc_id, CASE WHEN length(trim(text)) < 60 THEN 'stub: too short' WHEN contains(lower(text), 'license') THEN 'shape: licence text' WHEN lang = 'de' THEN 'language: de'
 WHEN contains(text, '@') THEN 'person: contact page' WHEN CAST(doc_id % 400 AS INTEGER) < 100 THEN 'deadline: passed' END AS reason FROM documents""")
def gate_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered chain of rejections; the deadline is read from text composed from the key."""
    text = F.col("text")
    deadline = F.date_add(F.to_date(F.lit(AS_OF)), (F.col("doc_id") % 400).cast("int") - 100)
    rules = [
        ("stub: too short", F.length(F.trim(text)) < 60),
        ("shape: licence text", F.contains(F.lower(text), F.lit("license"))),
        ("language: de", F.col("lang") == "de"),
        ("person: contact page", F.contains(text, F.lit("@"))),
        ("deadline: passed", deadline < F.to_date(F.lit(AS_OF))),
    ]
    return read(spark, sf_dir, "documents").select("doc_id", op.first_reason(rules).alias("reason"))


@query("SELECT doc_id, foreign_share > 0.3 AS rejected FROM (SELECT doc_id, length(regexp_replace(t, '[^\\x{0250}-\\x{FFFF}]', '', 'g')) * 1.0 / greatest(length(t), 1) AS foreign_share FROM (SELECT doc_id, regexp_replace(left(text, 2500), '\\s+', '', 'g') AS t FROM documents)) WHERE true")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of letters beyond Latin among the first 2500 characters, as the rule defines it."""
    head = F.regexp_replace(F.left("text", F.lit(2500)), r"\s+", "")
    share = F.length(F.regexp_replace(head, "[^ɐ-￿]", "")) / F.greatest(F.length(head), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", ((share > 0.3) & (F.length(head) >= 80)).alias("rejected"))


@query("""WITH w AS (SELECT vec_id, list_transform(range(3), lambda k: list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (((i + k) % 5) - 2) / 2.0))) AS z FROM embeddings),
 e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS p FROM w) SELECT vec_id, round(p[1] / list_sum(p), 6) AS p0, round(p[2] / list_sum(p), 6) AS p1, round(p[3] / list_sum(p), 6) AS p2 FROM e""")
def softmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    logit = lambda k: F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * ((i + 1 + k) % 5 - 2) / 2.0), F.lit(0.0), lambda s, x: s + x)
    p = v.select("vec_id", op.softmax(F.array(logit(0), logit(1), logit(2))).alias("p"))
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])
