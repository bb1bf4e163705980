"""Vectors and models over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as op
from ..operators.scoring import cosine
from ..registry import query
from .carriers import read

_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE))) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"""WITH c AS (SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
 SELECT query, id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS place FROM c QUALIFY place <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set (ids divisible by 100) against all rows."""
    v = read(spark, sf_dir, "embeddings")
    return op.cosine_topk(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH b AS (SELECT [i + 1 FOR i IN range(64)] AS embedding) SELECT a.vec_id, round({_COS}, 6) AS fit FROM embeddings a, b""")
def priority_vector_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.array(*[F.lit(float(i + 1)) for i in range(64)])
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), profile), 6).alias("fit"))


@query()
def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of a model trained on three quarters of the vectors and held against the rest."""
    v = read(spark, sf_dir, "embeddings")
    wide = v.select("vec_id", F.col("label").cast("double").alias("label"), *[F.when((F.col("vec_id") + i) % 97 != 0, F.col("embedding")[i].cast("double")).alias(f"f{i}") for i in range(16)])
    model = op.train_logistic(wide.where("vec_id % 4 <> 0"), [f"f{i}" for i in range(16)], "label")
    return model.transform(wide.where("vec_id % 4 = 0")).groupBy("label", "prediction").agg(F.count("*").alias("n"))
